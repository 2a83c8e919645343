"""Queries p7 to p9: the text problems, each through its operator. What SQL can't say is tested in tests/llm."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.engine.session import table
from tidemark.llm import contamination, mixing, pii, pii_examples
from tidemark.llm.pii_words import word_classes

# ---------------------------------------------------------------- problem 7


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).filter(contamination.kind_of() == "wording").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with their measures, re-parameterised copies included."""
    found = _leaks(spark, sf_dir).withColumn("kind", contamination.kind_of()).filter("kind is not null")
    return found.select(
        "doc_id", "item_id", "kind", *[F.round(c, 4).alias(c) for c in ("coverage", "template_coverage", "slot_consistency", "slots_same")]
    )


def p7_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in which an item's template stands with its numbers, names and units consistently replaced."""
    return p7_leaks(spark, sf_dir).filter("kind = 'reparameterised'").select("doc_id", "item_id", "template_coverage", "slot_consistency", "slots_same")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which evaluation items leaked, and into how many documents."""
    return p7_leaks(spark, sf_dir).groupBy("item_id").agg(
        F.count("*").alias("documents"), F.max("coverage").alias("coverage")
    )


# ---------------------------------------------------------------- problem 8


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label"), "text")
    return mixing.count_tokens(docs, mixing.vocabulary_path())


def _plan_frame(spark: SparkSession, plan: list[mixing.Source]) -> DataFrame:
    rows = [
        (s.source, s.tokens, s.target, s.limit, s.repeats_at_target, s.over_limit, round(s.exponent, 9), round(s.tempered, 9), s.budget)
        for s in plan
    ]
    return spark.createDataFrame(
        rows,
        "source string, tokens long, target_weight double, max_repeats double, repeats_at_target double,"
        " over_limit boolean, exponent double, tempered_weight double, budget long",
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.source_plan(_counts(spark, sf_dir), table(spark, sf_dir, "mix_target"))
    return _plan_frame(spark, plan).filter("over_limit").select("source")


# any usual tokenizer gives the same sources, so here a token is a word or a sign
P8_SQL = r"""
with want as (select regexp_replace(lower(source), '[\s[:punct:]\x{00A0}]+', '', 'g') k, source, weight / sum(weight) over () w, max_repeats from mix_target),
have as (select regexp_replace(lower(source), '[\s[:punct:]\x{00A0}]+', '', 'g') k, sum(len(regexp_extract_all(text, '\w+|[^\w\s]'))) n from documents group by 1),
j as (select source, w, max_repeats, coalesce(n, 0) n from want left join have using (k))
select source from j where w * (select sum(n) from j) > max_repeats * n
"""


def p8_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_frame(spark, mixing.source_plan(_counts(spark, sf_dir), table(spark, sf_dir, "mix_target"), tempered=True))


def _mix(spark: SparkSession, sf_dir: str, tempered: bool) -> DataFrame:
    counts = _counts(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    return mixing.realise(counts, mixing.source_plan(counts, table(spark, sf_dir, "mix_target"), tempered))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per use of a document, in the order (epoch, block, ordinal) of its source."""
    return _mix(spark, sf_dir, False)


def p8_tempered_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p8_mix`` by the tempered weights: all of T, at the greatest exponent that keeps every limit."""
    return _mix(spark, sf_dir, True)


def _shares(spark: SparkSession, sf_dir: str, tempered: bool) -> DataFrame:
    counts = _counts(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    plan = mixing.source_plan(counts, table(spark, sf_dir, "mix_target"), tempered)
    used = mixing.realise(counts, plan).groupBy("source").agg(F.sum("tokens").alias("used"), (F.max("epoch") + 1).alias("epochs"))
    total = sum(s.tokens for s in plan) or 1
    out = F.broadcast(_plan_frame(spark, plan)).join(used, "source", "left")
    mixed = F.sum("used").over(Window.partitionBy())  # one row per source
    return out.select(
        "source", "tokens", "target_weight", "max_repeats", "over_limit", "budget",
        F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("epochs", F.lit(0)).alias("epochs"),
        F.round(F.coalesce("used", F.lit(0)) / total, 6).alias("share_of_total"),
        F.round(F.coalesce("used", F.lit(0)) / mixed, 6).alias("share_of_mix"),
    )


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the realised mix."""
    return _shares(spark, sf_dir, False)


def p8_tempered_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the realised tempered mix."""
    return _shares(spark, sf_dir, True)


def p8_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exponent at which exponentiated token shares have the target mix's entropy, and those shares."""
    plan = mixing.source_plan(_counts(spark, sf_dir), table(spark, sf_dir, "mix_target"))
    have = sum(s.tokens for s in plan) or 1
    shares = [s.tokens / have for s in plan]
    a = mixing.exponent_for_entropy(shares, mixing.entropy([s.target for s in plan]))
    rows = [(s.source, p, round(a, 9), round(w, 9)) for s, p, w in zip(plan, shares, mixing.exponentiated(shares, a), strict=True)]
    return spark.createDataFrame(rows, "source string, natural_share double, exponent double, tempered_share double")


# ---------------------------------------------------------------- problem 9

_MODELS: dict[tuple, pii.Model] = {}


def _model(spark: SparkSession, sf_dir: str) -> pii.Model:
    """The segment model; its name likeness is fitted on at most ``pii.NAME_SAMPLE`` labelled names and public stocks."""
    sample = (
        table(spark, sf_dir, "player_dim").select("first_name", "second_name").distinct()
        .orderBy(F.xxhash64("first_name", "second_name"), "first_name", "second_name").limit(pii.NAME_SAMPLE).collect()
    )
    key = tuple(sorted((r.first_name or "", r.second_name or "") for r in sample))
    if key not in _MODELS:
        given = sorted({r.first_name for r in sample if r.first_name})
        family = sorted({r.second_name for r in sample if r.second_name})
        _MODELS.clear()
        _MODELS[key] = pii_examples.fit(given, family, word_classes(pii.vocabulary_paths()))
    return _MODELS[key]


def _public_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    players = table(spark, sf_dir, "player_dim").select(F.concat_ws(" ", F.trim("first_name"), F.trim("second_name")).alias("name"))
    teams = table(spark, sf_dir, "team_dim")
    return players.unionByName(teams.select(F.explode(F.array("fpl_names", "football_data_name", "understat_name", "odds_api_name")).alias("name")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_spans(table(spark, sf_dir, "documents"), _model(spark, sf_dir), _public_names(spark, sf_dir))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "documents"), _model(spark, sf_dir), _public_names(spark, sf_dir))


QUERIES = {
    "p7_found": (p7_found, None),
    "p7_leaks": (p7_leaks, None),
    "p7_reparameterised": (p7_reparameterised, None),
    "p7_items": (p7_items, None),
    "p8_found": (p8_found, P8_SQL),
    "p8_plan": (p8_plan, None),
    "p8_mix": (p8_mix, None),
    "p8_shares": (p8_shares, None),
    "p8_tempered_mix": (p8_tempered_mix, None),
    "p8_tempered_shares": (p8_tempered_shares, None),
    "p8_temperature": (p8_temperature, None),
    "p9_found": (p9_found, None),
    "p9_redacted": (p9_redacted, None),
}
