"""From neighbour lists to predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.decisions import (
    confidence,
    decide,
    decide_with_prior,
    vote_ratio,
    vote_weight,
)


def tally(
    neighbours: DataFrame,
    keys: list[str],
    weights: str = "distance",
    class_weights: dict[int, float] | None = None,
) -> DataFrame:
    """Sums of positive (phi) and negative (psi) votes per query.

    The neighbour join leaves its rows partitioned by query, so this
    aggregate adds no exchange.
    """
    vote = vote_weight(F.col("distance"), weights)
    positive = F.col("label") == 1
    if class_weights is not None:
        vote = vote * F.when(positive, F.lit(float(class_weights[1]))).otherwise(
            F.lit(float(class_weights[0]))
        )
    return neighbours.groupBy(*keys).agg(
        F.sum(F.when(positive, vote).otherwise(0.0)).alias("phi"),
        F.sum(F.when(positive, 0.0).otherwise(vote)).alias("psi"),
    )


def tally_for_each_k(
    neighbours: DataFrame, keys: list[str], ks: list[int], weights: str = "distance"
) -> DataFrame:
    """Tallies for several k from one neighbour table ranked to the largest."""
    wanted = F.array(*[F.lit(k) for k in sorted(ks)])
    rank = F.col("rank")
    rows = neighbours.withColumn(
        "k", F.explode(F.filter(wanted, lambda k: k >= rank))
    )
    return tally(rows, [*keys, "k"], weights)


def with_predictions(tallies: DataFrame, sigma: float) -> DataFrame:
    """Base decision at one threshold; adds ``score`` and ``prediction``."""
    phi, psi = F.col("phi"), F.col("psi")
    return tallies.withColumns(
        {"score": vote_ratio(phi, psi), "prediction": decide(phi, psi, F.lit(sigma))}
    )


def predictions_for_each_sigma(tallies: DataFrame, sigmas: list[float]) -> DataFrame:
    """The base decision for several thresholds: a fixed list per row."""
    values = F.array(*[F.lit(float(s)) for s in sigmas])
    rows = tallies.withColumn("sigma", F.explode(values))
    return rows.withColumn(
        "prediction", decide(F.col("phi"), F.col("psi"), F.col("sigma"))
    )


def with_prior_predictions(
    tallies: DataFrame, sigma: float, prior: float, use_prior: bool = True
) -> DataFrame:
    """Enhanced decision: ties go to the prior; adds ``score``,
    ``prediction`` and ``confidence``."""
    phi, psi = F.col("phi"), F.col("psi")
    prior_c, use_c = F.lit(float(prior)), F.lit(bool(use_prior))
    return tallies.withColumns(
        {
            "score": vote_ratio(phi, psi),
            "prediction": decide_with_prior(phi, psi, F.lit(sigma), prior_c, use_c),
            "confidence": confidence(phi, psi, prior_c, use_c),
        }
    )
