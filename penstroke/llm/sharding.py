"""Operator 6, sharding: placement by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in the order offset, offset + skip, offset + 2 skip, ...
(modulo the size); shards take turns, each claiming its first preferred slot that is still free, until the
table is full. Shards then hold nearly the same number of slots, and a change of the shard list moves few
slots. The table has a fixed size whatever the data, so it is broadcast and a row is placed by one lookup
of the hash of its key.

A key that holds more than its even share of rows (`spread` over one shard's share) would overfill a shard:
its rows are dealt over as many consecutive slots as it has quarters of such shares, by the hash of the whole row.

Degenerate rows: a null key is one key of its own; repeated rows go to one shard unless their key is spread;
an empty table gives no rows; further columns are kept, `slot` and `shard` replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.llm.common import table

#: A prime, over 100 times the number of shards.
SLOTS = 65_537
SHARDS = tuple(f"shard-{k:03d}" for k in range(256))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """Number of the shard that owns each slot."""
    offset = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    turn, owner, left = [0] * len(shards), [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while owner[at := (offset[k] + turn[k] * skip[k]) % slots] >= 0:
                turn[k] += 1
            owner[at] = k
            left -= 1
            if not left:
                return owner


def lookup_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard): `slots` rows."""
    owners = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    return spark.range(1).select(F.posexplode(owners)).select(F.col("pos").cast("long").alias("slot"), F.element_at(F.array(*map(F.lit, shards)), F.col("col").cast("int") + 1).alias("shard"))


def place(rows: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, spread: float | None = None) -> DataFrame:
    """All columns of rows, then slot and shard. spread: deal out keys with more rows than this many even shares."""
    rows = rows.drop("slot", "shard")
    slot = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(slots))
    if spread is not None:
        counted = rows.groupBy(key).count()
        share = F.lit(spread) * counted.select(F.sum("count")).first()[0] / len(shards) if counted.head(1) else F.lit(1.0)
        hot = counted.where(F.col("count") > share).select(F.col(key).alias("__key"), F.ceil(4 * F.col("count") / share).alias("__ways"))
        # Keys above a share are fewer than the shards / spread: a bounded table.
        rows = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__key")), "left")
        slot = F.pmod(slot + F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns if not c.startswith("__"))), F.coalesce("__ways", F.lit(1))), F.lit(slots))
    placed = rows.withColumn("slot", slot).drop("__key", "__ways")
    return placed.join(F.broadcast(lookup_table(rows.sparkSession, shards, slots)), "slot", "left").select(*placed.columns, "shard")


def op6_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
