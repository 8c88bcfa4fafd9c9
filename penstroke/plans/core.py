"""All queries of the library proper, and their SQL."""

from penstroke.plans import calibration, cleaning, critics, exact, ingest, lexical, metres, models, references, rhetoric, spans  # noqa: F401  (each adds its queries)
from penstroke.plans.lexical import ORACLES, QUERIES  # noqa: F401
