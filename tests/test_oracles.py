"""Registered queries against their SQL twins on the smallest tables.

``python tests/check_oracles.py`` runs all of them at any scale.
"""

from __future__ import annotations

from pathlib import Path

import pytest

from tests.check_oracles import connect, differences
from tremolo.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
CHECKED = [
    "s4_combine_classes", "s6_paired_samples", "s7_results_csv", "s8_footprint", "t2_ngrams",
    "t5_unseen_terms", "t7_tfidf", "p1_pattern_counts", "p3_patterns_long",
    "x1_x8_structure_documents", "x5_structure_code", "h3_missing_is_mean", "n2_scaled_pages",
    "d4_projection", "d4_projection_dense", "k1_k3_cosine_counts", "k2_k3_euclidean_counts",
    "k3_embeddings_cosine", "k4_clamped_k", "v6_v7_prior_decision", "v8_base_classification",
    "b4_smote", "e5_stratified_splits", "e14_effectiveness_grid", "e20_comparison",
]


@pytest.fixture(scope="module")
def duck():
    if not Path(SF).exists():
        pytest.skip("no test data here")
    return connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert differences(got, duck.execute(ORACLES[name]).df()) is None


def test_every_query_is_known():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) <= {"a3_smote_model_default_projection"}
