import math

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing as M


def docs(spark, spec):
    rows, i = [], 0
    for label, n, words in spec:
        for _ in range(n):
            rows.append((i, label, "alpha beta " * words))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, label string, text string")


def test_counts_labels_and_pieces(spark, rows):
    d = spark.createDataFrame([(1, " Forum-Thread", "hello world"), (2, None, None), (3, "x", "")], "doc_id long, label string, text string")
    c = M.count_tokens(d)
    assert rows(c, "doc_id", "tokens") == [(1, 2), (2, 0), (3, 0)]
    assert rows(d.select(M.label_key(F.col("label")).alias("k"))) == [("forumthread",), ("x",), (None,)]
    text = "ab cd\n" * 20_000 + "z" * 50_000
    assert "".join(M.pieces(text)) == text and len(list(M.pieces(text))) > 3
    enc = M.tokenizer(M.DEFAULT_VOCABULARY)
    blanks = ("word  \n\t  word, and 12 345 " + " " * 7) * 3_000
    for t in (text, blanks, "y" * 30_000, " " * 30_000):  # cut or not, the tokens are the text's
        assert sum(len(enc.encode_ordinary(p)) for p in M.pieces(t)) == len(enc.encode_ordinary(t))


def test_plan_limits_and_temperature():
    plan = {s.source: s for s in M.plan_mix(["a", "b", "c"], [900, 90, 10], [0.4, 0.4, 0.2], [2, 2, 3], 1000)}
    assert [plan[s].over_limit for s in "abc"] == [False, True, True]
    assert plan["b"].budget == 180 and plan["c"].budget == 30 and plan["a"].budget in (789, 790)  # what the limits cut goes to a
    assert sum(M.capped([0.5, 0.3, 0.2], [10, 400, 1e9], 1000)) == pytest.approx(1000) and M.capped([0.5, 0.5], [3, 4], 1000) == [3, 4]
    t = plan["a"].exponent
    assert 0 < t < 1
    assert all(s.tempered * 1000 <= s.limit * s.tokens * (1 + 1e-6) for s in plan.values())
    assert sum(s.tempered for s in plan.values()) == pytest.approx(1)
    even = M.plan_mix(["a", "b"], [600, 400], [0.5, 0.5], [2, 2], 1000)
    assert even[0].exponent == 1 and not any(s.over_limit for s in even)
    none = M.plan_mix(["a", "b"], [0, 0], [0.5, 0.5], [1, 1], 0)
    assert not any(s.over_limit for s in none) and all(s.budget == 0 for s in none)
    lone = M.plan_mix(["a", "b"], [0, 10], [0.5, 0.5], [1, 1], 10)
    assert lone[0].over_limit and lone[0].repeats_at_target == math.inf


def test_entropy_exponent():
    p = [0.7, 0.2, 0.1]
    for target in (1.05, 0.8, 0.5):
        a = M.exponent_for_entropy(p, target)
        assert M.entropy(M.exponentiated(p, a)) == pytest.approx(target, abs=1e-6)
    assert M.exponentiated([0.5, 0.0, 0.5], 0.0) == [0.5, 0.0, 0.5]


def test_realised_budgets_repeats_and_permutations(spark):
    d = docs(spark, [("A", 300, 30), ("b ", 40, 10), ("C", 5, 7), ("other", 50, 9)])
    c = M.count_tokens(d).unionByName(spark.createDataFrame([(None, "A", 50)], "doc_id long, label string, tokens long"))
    target = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.2, 4), (None, 0.1, 1)], "source string, weight double, max_repeats long")
    plan = {s.source: s for s in M.source_plan(c, target)}
    used = M.realise(c, list(plan.values()), block_tokens=400, seed=5).collect()
    biggest = {r.label: r.m for r in c.groupBy(M.label_key(F.col("label")).alias("label")).agg(F.max("tokens").alias("m")).collect()}
    for s in plan.values():
        mine = [r for r in used if r.source == s.source]
        total = sum(r.tokens for r in mine)
        assert s.budget - biggest[s.source] <= total <= s.budget or s.source == "a"
        per_doc = {}
        for r in mine:
            per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + 1
        assert max(per_doc.values()) <= plan[s.source].limit and max(per_doc.values()) - min(per_doc.values()) <= 1
        assert len({(r.epoch, r.doc_id) for r in mine}) == len(mine)
    first = [r.doc_id for r in sorted((r for r in used if r.source == "b" and r.epoch == 0), key=lambda r: (r.block, r.ordinal))]
    second = [r.doc_id for r in sorted((r for r in used if r.source == "b" and r.epoch == 1), key=lambda r: (r.block, r.ordinal))]
    assert first != sorted(first) and set(second) <= set(first) and first[: len(second)] != second
    assert M.realise(c.filter("false"), list(plan.values())).count() == 0


def test_tempered_shares_add_up_to_the_total_and_keep_limits(spark, tmp_path, monkeypatch):
    from tidemark.llm import queries

    c = spark.createDataFrame([(i, "a", 10) for i in range(90)] + [(i, "b", 10) for i in range(90, 100)], "doc_id long, label string, tokens long")
    monkeypatch.setattr(queries, "_counts", lambda s, d: c)
    spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, weight double, max_repeats long").write.parquet(f"{tmp_path}/mix_target.parquet")
    got = {r.source: r.used for r in queries.QUERIES["p8_tempered_shares"][0](spark, str(tmp_path)).collect()}
    assert got["b"] in (190, 200) and 980 <= sum(got.values()) <= 1000
    cut = {r.source: r.used for r in queries.QUERIES["p8_shares"][0](spark, str(tmp_path)).collect()}
    assert cut == {"a": 800, "b": 200}  # what b's limit cuts goes to a
    uses = queries.QUERIES["p8_tempered_mix"][0](spark, str(tmp_path))
    assert uses.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    spark.catalog.clearCache()
