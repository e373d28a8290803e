"""Reading texts takes all documents, labelled or not."""

from __future__ import annotations

from pathlib import Path

import pytest

from tests.check_oracles import connect, differences
from tremolo.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_texts_are_read(spark):
    if not Path(SF).exists():
        pytest.skip("no test data here")
    name = "s1_read_all_texts"
    got = QUERIES[name](spark, SF).toPandas()
    assert got.n_texts[0] == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert differences(got, connect(SF).execute(ORACLES[name]).df()) is None
