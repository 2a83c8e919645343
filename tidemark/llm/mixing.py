"""Mixing sources to target weights.

Method: temperature mixing. Source token shares are exponentiated, the exponent is bisected to
meet a target entropy or the repetition limits, and normalised weights are realised as budgeted
block permutations. With given target weights the tempered family is
w(t) ∝ p · (m / p)^t between the natural shares p (t = 0) and the targets m (t = 1); for equal
targets that is p^(1 - t), the usual temperature.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.engine.scale import broadcast_if_small, spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters handed to the tokenizer at once at least; longer texts are cut where a token begins anyway.
PIECE = 20_000
#: One blank between other characters: every token pattern used here begins a token with it.
_CUT = re.compile(r"(?<=\S) (?=\S)")

_CACHE: dict[str, object] = {}


def tokenizer(path: str):
    """A byte-level BPE read from a ranks file, kept per process."""
    if path not in _CACHE:
        import tiktoken

        try:
            from public_tokenizers import PATTERN as pattern
        except ImportError:
            pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CACHE[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _CACHE[path]


def pieces(text: str) -> Iterator[str]:
    """The whole text in pieces whose tokens are the text's: cut only before a lone blank, after at least PIECE characters.
    A text without such a place is one piece."""
    i = 0
    while len(text) - i > PIECE and (m := _CUT.search(text, i + PIECE)):
        yield text[i : m.start()]
        i = m.start()
    yield text[i:]


def count_tokens(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, label, tokens) of every document; a NULL or empty text has 0 tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(vocabulary)
        for pdf in batches:
            n = [sum(len(enc.encode_ordinary(p)) for p in pieces(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "tokens": n})

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label string, tokens long"
    return spread(docs.select("doc_id", "label", "text")).mapInPandas(run, schema)


def label_key(c: Column) -> Column:
    """A source label without case, blanks and separators, so that all spellings meet."""
    return F.regexp_replace(F.lower(c), r"[\s\p{Punct}\u00a0]+", "")


def plain_key(label: str) -> str:
    """Python twin of label_key."""
    return re.sub(r"[\s!-/:-@\[-`{-~]+", "", label.lower())


def bisect(f: Callable[[float], bool], lo: float, hi: float, steps: int = 60) -> float:
    """The greatest t in [lo, hi] with f(t), for an f that holds up to some t; lo if none."""
    if f(hi):
        return hi
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) else (lo, mid)
    return lo


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def exponentiated(shares: list[float], alpha: float) -> list[float]:
    """Shares to the power alpha, normalised; a source without tokens keeps none."""
    x = [s**alpha if s > 0 else 0.0 for s in shares]
    total = sum(x)
    return [v / total for v in x] if total else x


def exponent_for_entropy(shares: list[float], target: float) -> float:
    """The exponent in [0, 8] whose mix has the target entropy (nearest end if out of reach)."""
    return bisect(lambda a: entropy(exponentiated(shares, a)) >= target, 0.0, 8.0)


def capped(weights: list[float], most: list[float], total: float) -> list[float]:
    """Budgets in proportion to the weights that make up the total, none above its ``most``: each is min(most, λ × weight) with
    λ bisected; all of ``most`` if even that falls short."""
    use = [c if w > 0 else 0.0 for w, c in zip(weights, most, strict=True)]
    if sum(use) <= total:
        return use
    spent = lambda k: sum(min(c, k * w) for w, c in zip(weights, use, strict=True))
    k = bisect(lambda x: spent(x) <= total, 0.0, max(c / w for w, c in zip(weights, use, strict=True) if w > 0), 200)
    return [min(c, k * w) for w, c in zip(weights, use, strict=True)]


@dataclass(frozen=True)
class Source:
    source: str
    tokens: int
    target: float
    limit: float
    repeats_at_target: float
    over_limit: bool
    exponent: float
    tempered: float
    budget: int


def plan_mix(
    names: list[str], tokens: list[int], targets: list[float], limits: list[float], total: int, tempered: bool = False
) -> list[Source]:
    """Weights and token budgets per source.

    A source is over its limit if target × total exceeds limit × its own tokens. ``exponent`` is
    the greatest t at which the tempered mix keeps every limit and ``tempered`` that mix's
    weight. Budgets follow the targets (t = 1) or the tempered weights; what a limit cuts is shared out among the
    sources below theirs by the same weights, so budgets make up the total unless all limits bind.
    """
    norm = sum(targets) or 1.0
    m = [w / norm for w in targets]
    have = sum(tokens)
    p = [t / have if have else 0.0 for t in tokens]

    def mix(t: float) -> list[float]:
        x = [a * (b / a) ** t if a > 0 and b > 0 else 0.0 for a, b in zip(p, m, strict=True)]
        s = sum(x)
        return [v / s for v in x] if s else x

    def keeps(t: float) -> bool:
        return all(w * total <= lim * n * (1 + 1e-12) for w, n, lim in zip(mix(t), tokens, limits, strict=True))

    t = bisect(keeps, 0.0, 1.0)
    weights = mix(t)
    budgets = capped(weights if tempered else m, [lim * n for lim, n in zip(limits, tokens, strict=True)], total)
    out = []
    for i, name in enumerate(names):
        out.append(
            Source(
                name, tokens[i], m[i], limits[i],
                m[i] * total / tokens[i] if tokens[i] else math.inf,
                m[i] * total > limits[i] * tokens[i],
                t, weights[i], int(budgets[i]),
            )
        )
    return out


def source_plan(counts: DataFrame, mix_target: DataFrame, tempered: bool = False) -> list[Source]:
    """Plan for the sources of ``mix_target`` (source, weight, max_repeats); T is the tokens of the
    documents whose label names one of them, spelled any way. Rows without source or weight are
    left out, a missing limit counts as 1. Only one row per source reaches the driver."""
    target = mix_target.filter("source is not null and weight is not null").select(
        label_key(F.col("source")).alias("key"), "source", F.col("weight").cast("double"),
        F.coalesce(F.col("max_repeats").cast("double"), F.lit(1.0)).alias("limit"),
    )
    target = target.groupBy("key").agg(F.min("source").alias("source"), F.sum("weight").alias("weight"), F.min("limit").alias("limit"))
    sums = counts.groupBy(label_key(F.col("label")).alias("key")).agg(F.sum("tokens").alias("tokens"))
    rows = sorted(target.join(sums, "key", "left").collect(), key=lambda r: r.source)
    tokens = [int(r.tokens or 0) for r in rows]
    return plan_mix([r.source for r in rows], tokens, [r.weight for r in rows], [r.limit for r in rows], sum(tokens), tempered)


def realise(counts: DataFrame, plan: list[Source], block_tokens: int = 200_000, seed: int = 0, max_blocks: int = 65_536) -> DataFrame:
    """Uses of documents that meet each source's budget: (source, epoch, block, ordinal, doc_id, tokens).

    A source's documents fall into hash blocks of about ``block_tokens`` tokens, larger ones
    where there would be more than ``max_blocks``, so that a source's block sums stay few. Whole epochs take
    every document once; the last, partial one takes blocks in an order permuted by seed and
    epoch until the budget is met, and of the block on its edge a permuted beginning. Every epoch
    has its own permutation: read by (epoch, block, ordinal). A source misses its budget by
    less than one document. Documents without tokens are not used. The only windows run over
    one source's blocks' sums and over single blocks.
    """
    spark = counts.sparkSession
    rows = []
    for s in plan:
        full, rest = divmod(s.budget, s.tokens) if s.tokens else (0, 0)
        rows.append((plain_key(s.source), s.source, int(full), int(rest), min(max_blocks, max(1, -(-s.tokens // block_tokens)))))
    p = F.broadcast(spark.createDataFrame(rows, "key string, source string, full long, rest long, blocks long"))
    d = counts.filter("tokens > 0 and doc_id is not null").withColumn("key", label_key(F.col("label"))).join(p, "key")
    d = d.withColumn("hb", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))
    sums = d.groupBy("key", "source", "full", "rest", "hb").agg(F.sum("tokens").alias("bt"))
    w = Window.partitionBy("key").orderBy(F.xxhash64("hb", F.lit(seed), F.col("full")), "hb")
    sums = sums.withColumn("before", F.sum("bt").over(w) - F.col("bt")).select(
        "key", "hb", "before", (F.col("before") + F.col("bt") <= F.col("rest")).alias("inside"),
        ((F.col("before") < F.col("rest")) & (F.col("before") + F.col("bt") > F.col("rest"))).alias("edge"),
    )
    d = d.join(broadcast_if_small(sums), ["key", "hb"])
    order = F.xxhash64("doc_id", F.lit(seed), F.col("full"))
    we = Window.partitionBy("key", "hb").orderBy(order, "doc_id")
    edge = d.filter("edge").withColumn("upto", F.col("before") + F.sum("tokens").over(we.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("extra", (F.col("upto") <= F.col("rest")).cast("int")).drop("upto")
    d = d.filter("not edge").withColumn("extra", F.col("inside").cast("int")).unionByName(edge)
    d = d.withColumn("uses", F.col("full") + F.col("extra")).filter("uses > 0")
    d = d.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("uses") - 1)))
    return d.select(
        "source", "epoch", F.xxhash64("hb", F.lit(seed), "epoch").alias("block"),
        F.xxhash64("doc_id", F.lit(seed), "epoch").alias("ordinal"), "doc_id", "tokens",
    )


def vocabulary_path() -> str:
    return os.environ.get("TIDEMARK_VOCABULARY", DEFAULT_VOCABULARY)
