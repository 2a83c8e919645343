"""Plans: filters and columns reach the scan, one shuffle where one is enough, no nested loops."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.engine.asof import AsOfView
from tidemark.engine.catalog import Catalog
from tidemark.engine.sqlviews import explain_text
from tidemark.operators.asof_join import asof_join

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def test_asof_filter_is_pushed_and_columns_pruned(spark):
    v = AsOfView.at(Catalog(spark, DATA), dt.datetime(2022, 12, 1, tzinfo=dt.UTC))
    text = explain_text(v.table("player_match", ["player_key", "minutes"]))
    assert "LessThan(available_at" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"player_key", "minutes", "available_at"}


def test_asof_join_is_one_shuffle_without_nested_loops(spark):
    e = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    text = explain_text(asof_join(e, e.select("user_id", F.col("t").alias("rt"), F.col("event_id").alias("rid")), "t", "rt", ["user_id"], ["rid"], strict=True))
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 1


def test_no_query_plans_a_cartesian_product(spark):
    from tidemark.plans import catalogue

    for name in ("p1_found", "p2_found", "p5_found", "p6_found", "range_join_near_views", "skyline"):
        assert "CartesianProduct" not in explain_text(catalogue()[name][0](spark, DATA)), name
    spark.catalog.clearCache()
