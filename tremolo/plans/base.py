"""The base algorithm: counts, projection, nearest neighbours, vote."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import neighbors, postings, projection, voting
from ..sources.materialize import materialize


@dataclass(frozen=True)
class Vectors:
    """A vector table and how it came about."""

    table: DataFrame  # (id, terms, weights), or (id, slots, weights) if projected
    dim: int | None  # None: raw counts
    n_features: int
    n_rows: int


def vectorize(
    docs: DataFrame, dim: int = 0, eps: float = 0.3, seed: int = 0
) -> Vectors:
    """Bag of words of ``docs (id, text)``, projected unless ``eps`` is 0.

    The vocabulary is that of all rows given: hand in training and test rows
    together for the base algorithm's ``fit on everything``, or use
    :func:`vectorize_split` to fit on the training rows.
    """
    rows = materialize(count_vectors(docs), "vectors")
    return _projected(rows, rows, dim, eps, seed)


def vectorize_split(
    train: DataFrame, test: DataFrame, dim: int = 0, eps: float = 0.3, seed: int = 0
) -> tuple[Vectors, Vectors]:
    """Fit on ``train`` alone; ``test`` keeps only terms seen in training."""
    fitted = materialize(count_vectors(train), "vectors")
    terms = fitted.select("id", F.explode("terms").alias("term"))
    other = postings.term_counts(test, ["id"])
    known = postings.in_vocabulary(other, postings.vocabulary(terms), ["id"])
    empty = test.select(
        "id", F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf")
    )
    rows = postings.sparse_vectors(known.unionByName(empty), ["id"], "tf")
    return (
        _projected(fitted, fitted, dim, eps, seed),
        _projected(materialize(rows, "vectors"), fitted, dim, eps, seed),
    )


def count_vectors(docs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return postings.count_vectors(docs, keys or ["id"])


def _projected(
    rows: DataFrame, fitted: DataFrame, dim: int, eps: float, seed: int
) -> Vectors:
    n_rows = fitted.count()
    n_terms = fitted.select(F.explode("terms").alias("term")).distinct().count()
    if n_terms == 0:
        raise ValueError("empty vocabulary: no text has a token")
    target = projection.target_dim(n_rows, eps, dim)
    if target is not None:
        rows = projection.project_vectors(
            projection.spread(rows), target, n_terms, seed
        )
    return Vectors(rows, target, n_terms, n_rows)


def classify(
    train: DataFrame,
    test: DataFrame,
    sigma: float,
    k: int,
    metric: str = "cosine",
    weights: str = "distance",
    strict_k: bool = True,
) -> DataFrame:
    """``(id, [label,] phi, psi, score, prediction)`` of the test vectors.

    ``train`` is a vector table with ``label``.  ``strict_k`` raises when k
    exceeds the training rows, as the base algorithm does.
    """
    if strict_k:
        neighbors.require_k(train, k)
    near = neighbors.knn_join(test, train, k, metric=metric)
    truth = ["query_label"] if "label" in test.columns else []
    voted = voting.tally(near, ["query_id", *truth], weights)
    out = voting.with_predictions(voted, sigma).withColumnRenamed("query_id", "id")
    return out.withColumnRenamed("query_label", "label")
