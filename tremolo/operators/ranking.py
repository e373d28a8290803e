"""Exact positions in a hash order, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 4096  # a bucket holds about this many rows, or fewer


def hash_rank(rows: DataFrame, group: list[str], order: str, id_col: str, sizes: DataFrame) -> DataFrame:
    """Add ``rank`` (1, 2, …) of each row inside its group by (order, id).

    ``order`` holds hexadecimal digests.  Their first digits cut a group into
    even buckets; bucket counts give the offsets, and only rows of one bucket
    are sorted together.  How many digits follows from the group's own size, so a
    small group is one bucket and the buckets of a group with a third of all rows
    are no larger than others.  ``sizes`` has some of the columns of ``group`` and
    ``_rows``, the rows of each group with these values.
    """
    known = [c for c in sizes.columns if c != "_rows"]
    sizes = sizes.withColumnRenamed("_rows", "_size")
    digits = F.ceil(F.log(16.0, F.col("_size") / F.lit(float(BUCKET_ROWS))))
    bucketed = rows.join(sizes, known).withColumn(
        "_bucket", F.substring(order, F.lit(1), F.greatest(F.lit(0), digits).cast("int"))
    ).drop("_size")
    pieces = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        bucketed.groupBy(*pieces)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*pieces, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    inside = Window.partitionBy(*pieces).orderBy(order, id_col)
    return (
        bucketed.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, pieces)
        .withColumn("rank", F.col("_off") + F.col("_rn"))
        .drop("_bucket", "_rn", "_off")
    )
