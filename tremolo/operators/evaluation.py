"""Precision, recall, F1 and supports; averages over splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))


def evaluate(
    predictions: DataFrame,
    by: list[str] | None = None,
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """One row per group: ``precision, recall, f1`` (NULL where undefined) and
    ``n_flaky, n_non_flaky, n_predicted_flaky`` plus the confusion counts."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = predictions.groupBy(*(by or [])).agg(
        _count(y & p).alias("tp"),
        _count(~y & p).alias("fp"),
        _count(y & ~p).alias("fn"),
        _count(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
            "f1": F.try_divide(2.0 * tp, 2.0 * tp + fp + fn),
            "n_flaky": F.col("tp") + F.col("fn"),
            "n_non_flaky": F.col("fp") + F.col("tn"),
            "n_predicted_flaky": F.col("tp") + F.col("fp"),
        }
    )


def average_over_splits(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro averages over the usable splits: precision over those that define
    it (``avg`` skips NULL), recall and class counts over all of them."""
    counts = ["train_pos", "train_neg", "test_pos", "test_neg"]
    present = [c for c in counts if c in metrics.columns]
    return metrics.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_splits"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        *[F.avg(c).alias(c) for c in present],
    )
