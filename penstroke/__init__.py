"""Stylometry and text analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value: a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
