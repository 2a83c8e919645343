import datetime as dt
import lzma

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.models import Boosted, WalkForward
from tidemark.sources import raw_store as RS
from tidemark.sources import sinks as K
from tidemark.streaming import streams as X

AT = dt.datetime(2023, 5, 1, 2, 30, tzinfo=dt.UTC)


def test_raw_store_is_write_once_and_safe(spark, rows, tmp_path):
    rel = RS.path_for("feed", "boot", AT, ".json.gz")
    assert rel == "feed/boot/2023-05-01T023000Z.json.gz"
    RS.write_once(str(tmp_path), rel, RS.deterministic_gzip(b'{"elements": [{"id": 1}]}'))
    with pytest.raises(FileExistsError):
        RS.write_once(str(tmp_path), rel, b"x")
    RS.write_once(str(tmp_path), RS.path_for("feed", "boot", AT + dt.timedelta(hours=1), ".json.xz", "part"), lzma.compress(b"not json"))
    for bad in (("..", "a"), ("a", "b/c"), ("", "a")):
        with pytest.raises(ValueError):
            RS.path_for(*bad, AT, ".json")
    with pytest.raises(ValueError):
        RS.path_for("a", "b", dt.datetime(2023, 1, 1), ".json")
    e = RS.entries(spark, f"file://{tmp_path}", "feed", "boot")
    assert rows(e, "name", "suffix") == [("", ".json.gz"), ("part", ".json.xz")]
    assert RS.newest(e, ["source"]).first().name == "part"
    x = RS.read_json_elements(spark, f"file://{tmp_path}", "elements array<struct<id:long>>", "elements")
    assert rows(x.select("broken", "element.id")) == [(False, 1), (True, None)]
    assert RS.deterministic_gzip(b"a") == RS.deterministic_gzip(b"a")
    assert RS.decode_text(b"\xef\xbb\xbfa") == "a" and RS.decode_text(b"\xe9") == "é"


def test_csv_names_are_trimmed(spark, rows, tmp_path):
    (tmp_path / "a.csv").write_text("﻿ id , name\n1,x\n", encoding="utf-8")
    assert rows(RS.read_csv(spark, str(tmp_path), ["id"])) == [("1",)]


def test_validated_write_names_all_failures(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, 5.0), (1, -1.0), (None, 2.0)], "k long, v double")
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType())])
    with pytest.raises(K.ConstraintError) as e:
        K.write_table(df, str(tmp_path / "t"), schema, [K.not_null("k"), K.in_range("v", 0, 4)], ["k"])
    assert "k not null: 1" in str(e.value) and "v in [0, 4]: 2" in str(e.value) and "unique k: 1" in str(e.value)
    assert K.schema_problems(df.select("v"), schema) == ["missing k"]
    assert K.schema_problems(df.select("v", "k"), schema) == ["columns are in another order"]
    K.write_table(df.filter("v = 5"), str(tmp_path / "t"), schema, [], ["k"])
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == [(1, 5.0)]
    K.append_new(spark, str(tmp_path / "t"), df.filter("k = 1").unionByName(spark.createDataFrame([(2, 1.0), (2, 1.0)], df.schema)), ["k"])
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == [(1, 5.0), (2, 1.0)]
    assert rows(K.constraint_report(df.filter("false"), [K.not_null("k")], ["k"])) == [("k not null", 0), ("unique k", 0)]


def test_build_order_and_independent_steps(tmp_path):
    deps = {"c": ["b"], "b": ["a"], "a": [], "z": []}
    order = K.build_order(deps)
    assert order.index("a") < order.index("b") < order.index("c")
    assert K.build_order(deps, ["b"]) == ["b", "c"]
    with pytest.raises(KeyError):
        K.build_order(deps, ["nope"])
    done = []
    with pytest.raises(RuntimeError, match="x: boom"):
        K.run_independently({"x": lambda: (_ for _ in ()).throw(ValueError("boom")), "y": lambda: done.append(1)})
    assert done == [1]
    K.log_run(str(tmp_path / "log" / "runs.jsonl"), {"b": 1, "a": 2})
    assert (tmp_path / "log" / "runs.jsonl").read_text() == '{"a": 2, "b": 1}\n'


def test_stream_state_over_several_batches(spark, rows, tmp_path):
    for i in range(3):
        spark.createDataFrame([(1, i, 1.0), (2, i, 2.0)], "k long, o long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = X.file_stream(spark, str(tmp_path / "in"), max_files=1)
    out = X.run_once(X.keyed_fold(s, "k", "long", "o", "v", lambda a, b: a + b, 0.0), str(tmp_path / "run"), "update")
    assert rows(out.groupBy("k").agg(F.max("n"), F.max("state"))) == [(1, 3, 3.0), (2, 3, 6.0)]
    late = X.dedup(X.file_stream(spark, str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("o")), ["k"], "ts", "1 hour")
    assert X.run_once(late.select("k"), str(tmp_path / "run2"), "append").count() == 2


def test_walk_forward_sees_only_the_past(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 2)) for i in range(1, 41)], "r long, x long, y double")
    wf = WalkForward(lambda: Boosted(["x"], "y", rounds=2, depth=1), every=4)
    p = wf.predict(df, "r", [21, 22, 26])
    assert sorted(wf.fits) == [21, 25] and p.count() == 3
    assert all((q.pred > 0.5) == (q.y == 1.0) for q in p.collect())
