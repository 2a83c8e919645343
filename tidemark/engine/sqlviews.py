"""SQL access: temporary views over a directory and the library's functions by name."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from tidemark.engine.asof import AsOfView
from tidemark.engine.catalog import Catalog


def register_views(spark: SparkSession, directory: str, tables: list[str], prefix: str = "") -> None:
    for t in tables:
        spark.read.parquet(f"{directory}/{t}.parquet").createOrReplaceTempView(f"{prefix}{t}")


def register_asof_views(spark: SparkSession, catalog: Catalog, cutoff: dt.datetime, prefix: str) -> None:
    """Every non-static table as it was known strictly before the cutoff, for plain SQL."""
    view = AsOfView.at(catalog, cutoff)
    for name, spec in catalog.specs.items():
        if spec.kind != "static":
            view.table(name).createOrReplaceTempView(f"{prefix}{name}")


def register_functions(spark: SparkSession) -> None:
    """Arrow functions under SQL names, and SQL functions that are plain expressions."""
    from tidemark.functions.market import market_rates
    from tidemark.functions.strings import html_unescape, token_set_ratio

    for name, fn in (("token_set_ratio", token_set_ratio), ("html_unescape", html_unescape), ("market_rates", market_rates)):
        spark.udf.register(name, fn)
    spark.sql("create or replace temporary function season_start(t timestamp) returns int return year(t) - if(month(t) < 7, 1, 0)")
    spark.sql("create or replace temporary function elo_expected(h double, a double) returns double return 1 / (1 + power(10, -(h + 60 - a) / 400))")


def explain_text(df: DataFrame) -> str:
    """The formatted physical plan as text, for tests of pushed filters and pruned columns."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


