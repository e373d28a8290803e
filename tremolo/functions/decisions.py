"""Votes, decisions and confidences as ``CASE`` chains.

Two Spark traps shape these: ANSI mode raises on ``1/0``, and NaN compares
greater than every number, so the infinite cases come before any ratio.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def vote_weight(distance: Column, weights: str) -> Column:
    """One neighbour's vote: 1, or 1/distance with infinity at zero."""
    if weights == "uniform":
        return F.lit(1.0)
    if weights != "distance":
        raise ValueError(f"weights must be 'uniform' or 'distance', not {weights!r}")
    return F.when(distance == 0, F.lit(INFINITY)).otherwise(
        F.lit(1.0) / F.when(distance != 0, distance)
    )


def vote_ratio(phi: Column, psi: Column) -> Column:
    """phi / (phi + psi); NULL where it is undefined."""
    inf = F.lit(INFINITY)
    finite = (phi != inf) & (psi != inf) & ((phi + psi) != 0)
    return F.when(finite, phi / F.when(finite, phi + psi))


def decide(phi: Column, psi: Column, sigma: Column) -> Column:
    """Base decision rule, in its order: psi infinite, phi infinite, no votes,
    then the threshold."""
    inf = F.lit(INFINITY)
    return (
        F.when(psi == inf, 0)
        .when(phi == inf, 1)
        .when((phi + psi) == 0, 0)
        .when(vote_ratio(phi, psi) >= sigma, 1)
        .otherwise(0)
    )


def _tied(phi: Column, psi: Column) -> Column:
    inf = F.lit(INFINITY)
    return ((phi == inf) & (psi == inf)) | ((phi == 0) & (psi == 0))


def decide_with_prior(
    phi: Column, psi: Column, sigma: Column, prior: Column, use_prior: Column
) -> Column:
    """Decision rule that settles ties (both infinite, both zero) by the
    training prior when asked to."""
    inf = F.lit(INFINITY)
    by_prior = F.when(use_prior & (prior >= sigma), 1).otherwise(0)
    return (
        F.when(_tied(phi, psi), by_prior)
        .when(psi == inf, 0)
        .when(phi == inf, 1)
        .when(vote_ratio(phi, psi) >= sigma, 1)
        .otherwise(0)
    )


def confidence(phi: Column, psi: Column, prior: Column, use_prior: Column) -> Column:
    """How sure the vote is.  Note that this is not P(positive): a tie reports
    the prior itself, and the rest report the larger share of the vote."""
    inf = F.lit(INFINITY)
    ratio = vote_ratio(phi, psi)
    return (
        F.when(_tied(phi, psi), F.when(use_prior, prior).otherwise(F.lit(0.5)))
        .when((psi == inf) | (phi == inf), F.lit(1.0))
        .otherwise(F.when(ratio >= 0.5, ratio).otherwise(F.lit(1.0) - ratio))
    )
