"""Result tables as CSV with a header; an undefined metric is written ``-``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

UNDEFINED = "-"


def write_results(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").csv(
        path, header=True, nullValue=UNDEFINED
    )


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, nullValue=UNDEFINED)
