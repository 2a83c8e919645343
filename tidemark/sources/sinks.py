"""Validated, sorted Parquet sinks, constraint reports, incremental loads and a dependency-ordered build."""

from __future__ import annotations

import graphlib
import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConstraintError(ValueError):
    pass


@dataclass(frozen=True)
class Check:
    name: str
    ok: Column


def not_null(c: str) -> Check:
    return Check(f"{c} not null", F.col(c).isNotNull())


def in_range(c: str, lo, hi) -> Check:
    return Check(f"{c} in [{lo}, {hi}]", F.col(c).isNull() | F.col(c).between(lo, hi))


def one_of(c: str, values: list) -> Check:
    return Check(f"{c} in set", F.col(c).isNull() | F.col(c).isin(values))


def constraint_report(df: DataFrame, checks: list[Check], key: list[str] | None = None) -> DataFrame:
    """(check, failures) of all checks in one pass, and of key uniqueness in one partial aggregation."""
    one = df.agg(*[F.sum(F.when(~F.coalesce(c.ok, F.lit(False)), 1).otherwise(0)).alias(f"c{i}") for i, c in enumerate(checks)]) if checks else None
    parts = []
    if one is not None:
        pairs = F.array(*[F.struct(F.lit(c.name).alias("check"), F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("long").alias("failures")) for i, c in enumerate(checks)])
        parts.append(one.select(F.explode(pairs).alias("p")).select("p.*"))
    if key:
        extra = df.groupBy(*key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("failures"))
        parts.append(extra.select(F.lit(f"unique {', '.join(key)}").alias("check"), "failures"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def schema_problems(df: DataFrame, schema: T.StructType) -> list[str]:
    """Missing, extra, misplaced or mistyped columns; all of them."""
    have, want = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in schema]
    names = dict(have)
    out = [f"missing {n}" for n, _ in want if n not in names] + [f"extra {n}" for n, _ in have if n not in dict(want)]
    out += [f"{n} is {names[n].simpleString()}, not {t.simpleString()}" for n, t in want if n in names and names[n] != t]
    if not out and [n for n, _ in have] != [n for n, _ in want]:
        out.append("columns are in another order")
    return out


def write_table(df: DataFrame, path: str, schema: T.StructType | None = None, checks: list[Check] = (), key: list[str] | None = None, partition_by: list[str] = ()) -> None:
    """Validate (all failures are named), sort by key within files and write zstd Parquet; the committer makes
    it all or nothing. Files are range-partitioned on the key, so scans skip row groups."""
    problems = schema_problems(df, schema) if schema else []
    if checks or key:
        problems += [f"{r['check']}: {r.failures}" for r in constraint_report(df, list(checks), key).filter("failures > 0").collect()]
    if problems:
        raise ConstraintError("; ".join(problems))
    out = df.repartitionByRange(*key).sortWithinPartitions(*key) if key else df
    writer = out.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_new(spark: SparkSession, path: str, batch: DataFrame, key: list[str]) -> None:
    """Idempotent increment: only rows whose key isn't there yet are appended, once each."""
    new = batch.dropDuplicates(key)
    try:
        new = new.join(spark.read.parquet(path).select(*key), key, "left_anti")
    except Exception as e:  # noqa: BLE001  nothing there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").option("compression", "zstd").parquet(path)


def due(now: Column, deadlines: DataFrame, taken: DataFrame, at: str, lead: str) -> DataFrame:
    """Deadlines with ``now`` in [deadline - lead, deadline) for which nothing was taken yet in that window."""
    d = deadlines.filter((now >= F.col(at) - F.expr(f"interval {lead}")) & (now < F.col(at)))
    t = taken.select(F.col("snapshot_at").alias("__t"))
    return d.join(t, (F.col("__t") >= F.col(at) - F.expr(f"interval {lead}")) & (F.col("__t") < F.col(at)), "left_anti")


def freshness(df: DataFrame, at: str, now: Column, max_age: str, by: list[str]) -> DataFrame:
    """Newest time per group and whether it is older than allowed."""
    g = df.groupBy(*by).agg(F.max(at).alias("newest"))
    return g.withColumn("stale", F.col("newest") < now - F.expr(f"interval {max_age}"))


def build_order(depends: dict[str, list[str]], wanted: list[str] | None = None) -> list[str]:
    """Topological order of the wanted tables and everything that depends on them; 'all' by default."""
    order = list(graphlib.TopologicalSorter(depends).static_order())
    if wanted is None or wanted == ["all"]:
        return order
    unknown = set(wanted) - set(order)
    if unknown:
        raise KeyError(f"unknown tables {sorted(unknown)}")
    chosen = set(wanted)
    for t in order:
        if chosen & set(depends.get(t, [])):
            chosen.add(t)
    return [t for t in order if t in chosen]


def run_independently(steps: dict[str, Callable[[], None]]) -> None:
    """Run every step, then raise one error that names all that failed."""
    failed = {}
    for name, step in steps.items():
        try:
            step()
        except Exception as e:  # noqa: BLE001
            failed[name] = e
    if failed:
        raise RuntimeError("; ".join(f"{n}: {e}" for n, e in failed.items()))


def log_run(path: str, record: dict) -> None:
    """Append one JSON line."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, sort_keys=True, default=str, allow_nan=False) + "\n")


def keep_newest(df: DataFrame, by: list[str], at: str, n: int) -> DataFrame:
    """Retention: rows of the ``n`` newest distinct times per group."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.desc(at))
    return df.withColumn("__r", F.dense_rank().over(w)).filter(F.col("__r") <= n).drop("__r")


def content_fingerprint(paths: DataFrame, column: str = "path") -> DataFrame:
    """sha256 over the sorted distinct paths (a listing of files, one row each)."""
    return paths.agg(F.sha2(F.array_join(F.array_sort(F.collect_set(column)), "\n"), 256).alias("fingerprint"))
