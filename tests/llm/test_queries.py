import os

import pytest

from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def test_all_text_queries_run(spark):
    from tidemark.llm.queries import QUERIES

    counts = {n: q[0](spark, DATA).count() for n, q in QUERIES.items()}
    spark.catalog.clearCache()
    assert counts["p8_plan"] == 10 and counts["p9_redacted"] > 0
    assert {f"p{i}_found" for i in (7, 8, 9)} <= set(counts)


def test_shares_meet_targets(spark):
    from tidemark.llm.queries import p8_shares

    for r in p8_shares(spark, DATA).collect():
        assert r.used <= r.max_repeats * r.tokens and r.epochs <= r.max_repeats
