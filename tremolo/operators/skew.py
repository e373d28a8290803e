"""Joining a lookup table without gathering a hot key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.materialize import materialize, written

#: Rows of one key that one salt carries, about.
SALT_ROWS = 50_000
#: Entries of the table of salts: a fixed bound, whatever the number of keys.
SALT_BUCKETS = 1 << 16


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    frequency: str,
    spread: list[str],
    *,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """Inner join of ``rows`` with the one-row-per-key ``table``.

    ``table[frequency]`` says how many rows carry the key.  A key gets a salt for
    every ``salt_rows`` of them: its rows take one by a hash of ``spread``, and its
    entry of the table is copied once per salt, so no partition holds more of a key
    than that.  Both sides read the number of salts from a table of ``SALT_BUCKETS``
    hashed keys, each with the largest number that one of its keys needs; buckets of
    one salt are left out.  The plan is the same for all keys and sizes.
    """
    values = [c for c in table.columns if c != key]
    if not written(table):
        table = materialize(table, "lookup")
    needed = F.max(F.ceil(F.col(frequency) / salt_rows)).cast("int").alias("_salts")
    salts = materialize(table.groupBy(_bucket(key).alias("_bucket")).agg(needed).where("_salts > 1"), "salts")

    def salted(side: DataFrame) -> DataFrame:
        # At most SALT_BUCKETS rows of two integers.
        found = side.withColumn("_bucket", _bucket(key)).join(F.broadcast(salts), "_bucket", "left")
        return found.withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    own = F.pmod(F.xxhash64(*spread, F.lit("salt")), F.col("_salts").cast("long")).cast("int")
    left = salted(rows).withColumn("_salt", own).select(*rows.columns, "_salt")
    right = salted(table).select(
        F.col(key).alias("_key"), *[F.col(c).alias(f"_v_{c}") for c in values],
        F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_copy"),
    )
    joined = left.join(right, (left[key] == right["_key"]) & (left["_salt"] == right["_copy"]))
    return joined.select(*rows.columns, *[F.col(f"_v_{c}").alias(c) for c in values])


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SALT_BUCKETS)).cast("int")
