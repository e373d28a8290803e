"""Sparse random projection.

Every term has a 60-bit code, its hash.  A *draw* is a pair of linear functions
of both halves of the code modulo a prime: one picks the term's slot, the other
its sign.  A term makes ``m = max(1, round(dim / sqrt(features)))`` draws of
weight ``1 / sqrt(m)``: the non-zeros per term that a matrix of density
``1 / sqrt(features)`` has on average (there the number varies by term).

A fitted projection is therefore nothing but the seed, the dimension and the
number of features: new rows meet the same entries, and another projection (one
per split, say) costs a few multiplications per term instead of new hashes.

:func:`cell_tests` is the classical variant that tests every (term, slot) cell,
at ``dim`` hashes per term.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import HASH_RANGE, digest, hash32_of
from .skew import lookup

CODE_DIGITS = 15  # hexadecimal digits of a term's code: 60 bits
HALF = 1 << 30
PRIME = 2147483647  # larger than both halves of a code


def jl_dim(n_rows: int, eps: float) -> int:
    """Dimensions that keep pairwise distances within 1 ± eps (the
    Johnson-Lindenstrauss bound): ``floor(4 ln n / (eps²/2 - eps³/3))``."""
    if not 0.0 < eps < 1.0:
        raise ValueError(f"eps must be inside (0, 1), not {eps}")
    if n_rows < 1:
        raise ValueError("the bound needs at least one row")
    return max(1, int(4.0 * math.log(n_rows) / (eps**2 / 2 - eps**3 / 3)))


def jl_dim_column(n_rows: Column, eps: Column) -> Column:
    bound = F.lit(4.0) * F.log(n_rows) / (eps * eps / 2 - eps * eps * eps / 3)
    return F.greatest(F.lit(1), F.floor(bound).cast("int"))


def target_dim(
    n_rows: int, eps: float, dim: int = 0, n_features: int | None = None
) -> int | None:
    """Explicit ``dim`` wins over the bound; ``eps = 0`` means no projection
    (None).  ``n_features`` caps the result (the enhanced pipeline does this,
    the base one does not)."""
    if eps == 0:
        return None
    chosen = dim if dim > 0 else jl_dim(n_rows, eps)
    return min(chosen, n_features) if n_features else chosen


def draws_per_term(dim: Column, n_features: Column) -> Column:
    per_term = F.floor(dim / F.sqrt(n_features.cast("double")) + 0.5)
    return F.greatest(F.lit(1), per_term.cast("int"))


def n_draws(dim: int, n_features: int) -> int:
    return max(1, math.floor(dim / math.sqrt(n_features) + 0.5))


def draw_functions(seed: int, key: int, count: int) -> list[tuple[int, ...]]:
    """``count`` draws ``(a, b, c, d, e, f)`` of the projection named ``key``: slot
    ``(a·high + e·low + b) mod PRIME mod dim`` and sign ``(c·low + f·high + d) mod
    PRIME mod 2``.  Any two codes meet in a slot about once in ``dim`` draws."""
    out = []
    for i in range(count):
        h = hashlib.sha256(f"{seed}|{key}|{i}".encode()).hexdigest()
        a, b, c, d, e, f = (int(h[j : j + 8], 16) for j in range(0, 48, 8))
        out.append((a % (PRIME - 1) + 1, b % PRIME, c % (PRIME - 1) + 1, d % PRIME,
                    e % (PRIME - 1) + 1, f % (PRIME - 1) + 1))
    return out


def term_code(term: Column) -> Column:
    return F.conv(F.substring(F.md5(term), 1, CODE_DIGITS), 16, 10).cast("bigint")


def with_codes(vectors: DataFrame) -> DataFrame:
    """Sparse vectors with codes in the place of their terms."""
    return vectors.withColumn("codes", F.transform("terms", term_code)).drop("terms")


def project_vectors(
    vectors: DataFrame, dim: int, n_features: int, seed: int, key: int = 0
) -> DataFrame:
    """Replace ``terms, weights`` by ``slots ARRAY<INT>, weights``.

    A slot may occur more than once in a row; its value is the sum.  This is a
    projection of each row by itself: no shuffle.
    """
    m = n_draws(dim, n_features)
    draws = F.array(
        *[
            F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip("abcdef", f)])
            for f in draw_functions(seed, key, m)
        ]
    )

    def halves(code: Column) -> tuple[Column, Column]:
        return F.shiftright(code, 30), code.bitwiseAND(F.lit(HALF - 1))

    def slot(f: Column, code: Column) -> Column:
        high, low = halves(code)
        return ((f["a"] * high + f["e"] * low + f["b"]) % PRIME % dim).cast("int")

    def signed(f: Column, code: Column, w: Column) -> Column:
        high, low = halves(code)
        odd = (f["c"] * low + f["f"] * high + f["d"]) % PRIME % 2 == 1
        return F.when(odd, -w).otherwise(w) * F.lit(1.0 / math.sqrt(m))

    rows = with_codes(vectors).withColumn("_draws", draws)
    slots = F.flatten(
        F.transform("_draws", lambda f: F.transform("codes", lambda x: slot(f, x)))
    )
    weights = F.flatten(
        F.transform(
            "_draws",
            lambda f: F.zip_with("codes", "weights", lambda x, w: signed(f, x, w)),
        )
    )
    return rows.withColumns({"slots": slots, "weights": weights}).drop("codes", "_draws")


def spread(rows: DataFrame) -> DataFrame:
    """As many partitions as the session's shuffles have.  The work per row of
    a vector table is large, so partitions sized by bytes would be too few."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n)


def slot_values(projected: DataFrame, keys: list[str]) -> DataFrame:
    """Projected rows in long form: ``(*keys, slot, value)``."""
    entry = F.inline(F.arrays_zip("slots", "weights")).alias("slot", "_w")
    rows = projected.select(*keys, entry)
    return rows.groupBy(*keys, "slot").agg(F.sum("_w").alias("value"))


def cell_tests(
    postings: DataFrame, keys: list[str], weight: str, dim: int, n_features: int,
    seed: int,
) -> DataFrame:
    """``(*keys, slot, value)`` of the classical sparse projection: every cell
    is non-zero with probability ``1 / sqrt(features)`` and then has the value
    ``± sqrt(sqrt(features) / dim)``."""
    rows = postings.where(F.col("term").isNotNull())
    # Each term is tested once, however many rows hold it; few cells pass.
    terms = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    tested = terms.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))))
    tested = tested.withColumn("_h", digest(seed, F.col("term"), F.col("_slot")))
    kept = hash32_of(F.col("_h")).cast("double") < HASH_RANGE / math.sqrt(n_features)
    sign = F.when(F.substring("_h", 9, 1) < "8", 1.0).otherwise(-1.0)
    cell = F.struct(F.col("_slot").alias("slot"), sign.alias("_sign"))
    cells = tested.where(kept).groupBy("term", "df").agg(F.collect_list(cell).alias("_cells"))
    found = lookup(rows.select(*keys, "term", weight), cells, "term", "df", keys)
    entries = found.select(*keys, weight, F.inline("_cells"))
    scale = math.sqrt(math.sqrt(n_features) / dim)
    return entries.groupBy(*keys, "slot").agg(
        (F.sum(F.col("_sign") * F.col(weight)) * F.lit(scale)).alias("value")
    )


def project_dense(
    vectors: DataFrame, vec: str, dim: int, n_features: int, seed: int
) -> DataFrame:
    """Projection of dense arrays: position numbers take the place of terms."""
    positions = F.transform(
        F.sequence(F.lit(0), F.size(vec) - 1), lambda i: i.cast("string")
    )
    sparse = vectors.withColumns(
        {"terms": positions, "weights": F.col(vec).cast("array<double>")}
    )
    return project_vectors(sparse.drop(vec), dim, n_features, seed)
