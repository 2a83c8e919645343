"""Passages of held-out evaluation texts inside a corpus.

Method: template canonicalisation. Numbers, names, days and units become typed placeholders; keys
of template tokens (two runs of three, at most one token between) are hash-joined with the keys
of the evaluation items; an alignment of the words then measures how much of an item's wording is
followed, and an alignment of the templates with a check of the slots' consistency tells
re-parameterised copies.

The evaluation set is the stated query set: it is taken in blocks of bounded size, each block's
index is broadcast, and the corpus is read once per block without any shuffle. A batch of
documents is handled in arrays; only pairs of a document and an item with enough keys along two
diagonals are aligned one by one.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.engine.scale import spread

#: Template tokens in a run; a key is two runs with one of GAPS tokens between, so that an edit after every third token leaves keys.
RUN, GAPS = 3, (0, 1)
#: Template tokens under a key at most.
SPAN = 2 * RUN + max(GAPS)
#: Items whose keys are broadcast at once (at ~200 keys each some 40 MB).
BLOCK_ITEMS = 10_000
#: Documents whose tokens are held in arrays at once.
SLICE = 400

# Words that stand for days and units.
DAYS = {"monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"}
UNITS = {"minute", "minutes", "hour", "hours", "second", "seconds", "day", "days", "million", "millions", "percent", "cent",
         "points", "goals", "metres", "meters", "miles", "km", "kg", "pounds", "euros", "dollars", "years"}

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕһԁԛԝгкмтвнАВЕКМНОРСТУХІЈЅαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧɑɡı",
    "aeopcyxijshdqwrkmtbhABEKMHOPCTYXIJSaopvikABEZHIKMNOPTYXagi",
)

_TAG = re.compile(r"<[^<>\s=][^<>]*>")
_DASH = r"[-\u2010-\u2012\u00ad]"
_HYPHEN = re.compile(_DASH + r"(?<=[^\W\d_]" + _DASH + r")[ \t]*(?:\r?\n[ \t]*)?(?=[^\W\d_])")
_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_APOSTROPHE = re.compile(r"['\u2019\u02bc`](?<=[^\W\d_]['\u2019\u02bc`])(?=[^\W\d_])")
_LOOKALIKE = re.compile("[" + "".join(map(chr, LOOKALIKES)) + "]")
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?;:\n]")


_STOPS = frozenset(".!?;:\n")


def clean(text: str) -> str:
    """Undo markup, entities, hyphenation, apostrophes, invisible characters and compatibility forms."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if _LOOKALIKE.search(text):
            text = _LOOKALIKE.sub(lambda m: chr(LOOKALIKES[ord(m.group())]), text)
        text = text.replace("\xad\n", "").replace("\xad", "")
        text = _INVISIBLE.sub("", text)
    return _APOSTROPHE.sub("", _HYPHEN.sub("", text))


def _fold(word: str) -> str:
    word = word.lower()
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


_HASH_BITS = 24
_NUM, _DAY, _UNIT, _NAME = (np.uint64(k) for k in (11, 13, 17, 19))
_WORD_SORT, _NUM_SORT, _DAY_SORT, _UNIT_SORT = 0, 1, 2, 3


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class NameBits:
    """Words that the items only ever write with a capital inside sentences, by hash: two bitmaps of fixed size, whatever
    the number of items. A chance hit makes a word a name in items and documents alike."""

    def __init__(self) -> None:
        self.upper = np.zeros(1 << _HASH_BITS >> 3, dtype=np.uint8)
        self.lower = np.zeros(1 << _HASH_BITS >> 3, dtype=np.uint8)

    def add(self, texts: Iterable[str]) -> NameBits:
        for t in texts:
            start = True
            for w in _TOKEN.findall(clean(t)):
                if w in _STOPS:
                    start = start or w != "\n"
                    continue
                if w[0].islower() or (not start and w[0].isupper() and not w.isupper()):
                    h = word_hash(_fold(w)) & ((1 << _HASH_BITS) - 1)
                    (self.lower if w[0].islower() else self.upper)[h >> 3] |= 1 << (h & 7)
                start = False
        return self

    def holds(self, h: int) -> bool:
        h &= (1 << _HASH_BITS) - 1
        return bool(self.upper[h >> 3] >> (h & 7) & 1) and not self.lower[h >> 3] >> (h & 7) & 1


class Vocabulary(dict):
    """Written token → its number; what the tokens are stands in arrays."""

    LIMIT = 500_000

    def __init__(self, names: NameBits) -> None:
        self.names = names
        self.fresh: list[tuple[int, int, int, bool, bool]] = []
        self.hash = np.zeros(0, dtype=np.uint64)
        self.stop, self.sort = np.zeros(0, dtype=np.int8), np.zeros(0, dtype=np.int8)
        self.cap, self.name = np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        if token in _STOPS:
            self.fresh.append((0, 2 if token == "\n" else 1, 0, False, False))
            return n
        w = _fold(token)
        h = word_hash(w)
        sort = _NUM_SORT if w[:1].isdigit() else (_DAY_SORT if w in DAYS else (_UNIT_SORT if w in UNITS else _WORD_SORT))
        self.fresh.append((h, 0, sort, token != w and token[0].isupper() and not token.isupper(), self.names.holds(h)))
        return n

    def numbers(self, tokens: list[str]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
            self.__init__(self.names)
        ids = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if self.fresh:
            h, stop, sort, cap, name = zip(*self.fresh, strict=True)
            self.hash = np.concatenate([self.hash, np.array(h, dtype=np.uint64)])
            self.stop = np.concatenate([self.stop, np.array(stop, dtype=np.int8)])
            self.sort = np.concatenate([self.sort, np.array(sort, dtype=np.int8)])
            self.cap = np.concatenate([self.cap, np.array(cap, dtype=bool)])
            self.name = np.concatenate([self.name, np.array(name, dtype=bool)])
            self.fresh = []
        return ids


@dataclass
class Texts:
    """Texts as arrays: the words' hashes and, over them, template tokens with the first word and the number of words behind
    each. ``word_at`` and ``tok_at`` are the texts' offsets."""

    words: np.ndarray
    word_at: np.ndarray
    toks: np.ndarray
    slot: np.ndarray
    first: np.ndarray
    count: np.ndarray
    text: np.ndarray
    tok_at: np.ndarray


def read_texts(texts: list[str], vocabulary: Vocabulary) -> Texts:
    tokens: list[str] = []
    sizes = []
    for t in texts:
        got = _TOKEN.findall(clean(t))
        tokens += got
        sizes.append(len(got))
    ids = vocabulary.numbers(tokens)
    of = np.repeat(np.arange(len(texts)), sizes)
    stop = vocabulary.stop[ids]
    at = np.flatnonzero(stop == 0)
    wid, wof, ends = ids[at], of[at], np.cumsum(stop == 1)[at]
    before = lambda x, empty: np.concatenate([[empty], x[:-1]]) if len(x) else x
    first = before(wof, -1) != wof
    start = first | (before(ends, -1) != ends)
    words, sort = vocabulary.hash[wid], vocabulary.sort[wid]
    num, day = sort == _NUM_SORT, sort == _DAY_SORT
    unit = (sort == _UNIT_SORT) & before(num, False).astype(bool) & ~first
    name = ~(num | day | unit) & (vocabulary.name[wid] | (~start & vocabulary.cap[wid]))
    code = np.where(num, _NUM, np.where(day, _DAY, np.where(unit, _UNIT, np.where(name, _NAME, words))))
    kept = np.flatnonzero(~(name & before(name, False).astype(bool) & ~first))
    count = np.diff(np.append(kept, len(words)))
    return Texts(
        words, np.searchsorted(wof, np.arange(len(texts) + 1)), code[kept], (num | day | unit | name)[kept], kept, count, wof[kept],
        np.searchsorted(wof[kept], np.arange(len(texts) + 1)),
    )


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def _grams(toks: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n tokens."""
    m = max(0, len(toks) - n + 1)
    h = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        h = _mix(h, toks[k : k + m])
    return h


def keys(t: Texts, short: Iterable[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the first token) of all keys inside single texts, and of whole runs of the lengths ``short``."""
    hs, ps = [], []
    runs = _grams(t.toks, RUN)
    for gap in GAPS:
        m = len(runs) - RUN - gap
        if m > 0:
            ok = np.flatnonzero(t.text[:m] == t.text[2 * RUN + gap - 1 : 2 * RUN + gap - 1 + m])
            hs.append(_mix(runs[ok], runs[ok + RUN + gap]))
            ps.append(ok)
    for n in short:
        h = _grams(t.toks, n)
        ok = np.flatnonzero(t.text[: len(h)] == t.text[n - 1 :]) if len(h) else np.zeros(0, dtype=np.int64)
        hs.append(h[ok])
        ps.append(ok)
    return (np.concatenate(hs), np.concatenate(ps)) if hs else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))


@dataclass
class Index:
    """A block of items and all their keys, as sorted hashes with postings by item. Items of fewer tokens than a key spans are
    looked for whole: ``short`` are their lengths."""

    ids: list[int]
    texts: Texts
    names: NameBits
    hashes: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    size: np.ndarray
    short: tuple[int, ...]


def build_index(items: list[tuple[int, str]], names: NameBits | None = None) -> Index:
    names = names if names is not None else NameBits().add(t for _, t in items)
    t = read_texts([x for _, x in items], Vocabulary(names))
    size = np.diff(t.tok_at)
    small = size < 2 * RUN
    short = tuple(sorted({int(n) for n in size[small] if n > 0}))
    h, p = keys(t)
    item = t.text[p]
    for n in short:
        i = np.flatnonzero(size == n)
        hs = [_grams(t.toks[t.tok_at[k] : t.tok_at[k + 1]], n) for k in i]
        h, p, item = np.concatenate([h, *hs]), np.concatenate([p, t.tok_at[i]]), np.concatenate([item, i])
    order = np.lexsort((item, h))
    uniq, starts = np.unique(h[order], return_index=True)
    return Index([i for i, _ in items], t, names, uniq, np.append(starts, len(h)), item[order], (p - t.tok_at[item])[order], size, short)


def _best_bands(of: np.ndarray, diag: np.ndarray) -> np.ndarray:
    """Mask of each pair's hits in its fullest two adjoining diagonal bands; ``of`` is the hit's pair."""
    low = diag.min()
    width = diag.max() - low + 2
    key = of * width + (diag - low)
    u, cnt = np.unique(key, return_counts=True)
    near, pair = cnt.copy(), u // width
    adj = np.flatnonzero(u[1:] == u[:-1] + 1)
    near[adj] += cnt[adj + 1]
    new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    most = np.repeat(np.maximum.reduceat(near, new), np.diff(np.append(new, len(u))))
    full = np.flatnonzero(near == most)
    owner, first = np.unique(pair[full], return_index=True)
    best = u[full[first]][np.searchsorted(owner, of)]
    return (key == best) | (key == best + 1)


def _covered(pos: np.ndarray) -> int:
    """Template tokens under keys at these positions, which are sorted."""
    return int(np.minimum(pos[1:] - pos[:-1], SPAN).sum()) + SPAN if len(pos) else 0


#: Share of an item's template tokens under keys along two diagonals below which a pair is not aligned: less than half of
#: the third of its words that a leak follows (recall by edits is measured in the tests).
UNDER = 0.2


#: Postings of keys that are held at once.
HITS = 1_000_000


def _hits(index: Index, docs: Texts, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document × number of items + item, item position, token) of all keys that documents and items share. A pair's stand
    in one batch: whole documents up to ``most`` hits, of a document with more a range of items at a time."""
    h, q = keys(docs, index.short)
    if not len(h) or not len(index.hashes):
        return
    at = np.searchsorted(index.hashes, h)
    at[at == len(index.hashes)] = 0
    hit = np.flatnonzero(index.hashes[at] == h)
    if not len(hit):
        return
    hit = hit[np.argsort(docs.text[q[hit]], kind="stable")]
    at, q = at[hit], q[hit]
    doc, items = docs.text[q], len(index.ids)
    s, e = index.starts[at], index.starts[at + 1]
    ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc))
    total = np.cumsum(e - s)[ends - 1]
    holders = np.repeat(np.arange(len(index.hashes)), np.diff(index.starts)) * items + index.item if total[-1] > most else None
    i = 0
    while i < len(ends):
        before = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, before + most, "right")))
        rows = slice(ends[i - 1] if i else 0, ends[j - 1])
        parts = min(items, -(-int(total[j - 1] - before) // most))
        for k in range(parts):
            lo, hi = s[rows], e[rows]
            if parts > 1:
                lo, hi = (np.searchsorted(holders, at[rows] * items + x * items // parts) for x in (k, k + 1))
            n = hi - lo
            flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            yield np.repeat(doc[rows], n) * items + index.item[flat], index.pos[flat], np.repeat(q[rows], n)
        i = j


def candidates(index: Index, docs: Texts, under: float = UNDER, band: int = 12, most: int = HITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(document, item, item positions, document positions) of pairs with enough keys along their best two bands of diagonals.
    An item shorter than a key needs its whole run."""
    for hits in _hits(index, docs, most):
        if len(hits[0]):
            yield from _enough(index, docs, *hits, under, band)


def _enough(index: Index, docs: Texts, pair: np.ndarray, p: np.ndarray, q: np.ndarray, under: float, band: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    # what all keys of a pair cover bounds what those along two diagonals do
    order = np.lexsort((p, pair))
    pair, p, q = pair[order], p[order], q[order]
    new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    step = np.minimum(np.diff(p, prepend=0), SPAN)
    step[new] = SPAN
    bound = np.add.reduceat(step, new)
    long = np.diff(np.append(new, len(pair)))
    kept = bound >= under * index.size[pair[new] % len(index.ids)]
    if not kept.any():
        return
    of = np.repeat(np.arange(kept.sum()), long[kept])
    hits = np.repeat(kept, long)
    pair, p, q = pair[new][kept], p[hits], q[hits]
    d, i = pair // len(index.ids), pair % len(index.ids)
    q = q - docs.tok_at[d][of]
    diag = (q - p) // band
    chosen = _best_bands(of, diag)
    rest = np.flatnonzero(~chosen)
    if len(rest):
        chosen[rest[_best_bands(of[rest], diag[rest])]] = True
    of, p, q = of[chosen], p[chosen], q[chosen]
    new = np.searchsorted(of, np.arange(len(pair)))
    step = np.minimum(np.diff(p, prepend=0), SPAN)
    step[new] = SPAN
    enough = np.add.reduceat(step, new) >= under * index.size[i]
    ends = np.append(new[1:], len(of))
    for k in np.flatnonzero(enough).tolist():
        yield int(d[k]), int(i[k]), p[new[k] : ends[k]], q[new[k] : ends[k]]


def blocks_of(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Matching runs (position in a, in b, length), ordered in both: those of difflib's SequenceMatcher(None, b, a), but words
    of b that a doesn't hold are passed over at once."""
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    at = [(j, places[x]) for j, x in enumerate(b) if x in places]
    where = [j for j, _ in at]
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        size, pa, pb, last, runs = 0, 0, 0, -2, {}
        for j, ps in at[bisect_left(where, blo) : bisect_left(where, bhi)]:
            before, runs = runs if j == last + 1 else {}, {}
            last = j
            for i in ps:
                if i >= ahi:
                    break
                if i >= alo:
                    n = runs[i] = before.get(i - 1, 0) + 1
                    if n > size:
                        size, pa, pb = n, i - n + 1, j - n + 1
        if size:
            found.append((pb, pa, size))
            if alo < pa and blo < pb:
                todo.append((alo, pa, blo, pb))
            if pa + size < ahi and pb + size < bhi:
                todo.append((pa + size, ahi, pb + size, bhi))
    out: list[tuple[int, int, int]] = []
    for pb, pa, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == pa and out[-1][1] + out[-1][2] == pb:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((pa, pb, n))
    return out


def stretches(a: list[int], blocks: list[tuple[int, int, int]], gap: int = 4) -> list[tuple[int, int, int, int, int]]:
    """Stretches of close blocks: (matched, a_from, a_to, b_from, b_to)."""
    out: list[list[int]] = []
    for pa, pb, n in blocks:
        if out:
            ga, gb = pa - out[-1][2], pb - out[-1][4]
            # a lone word joins only at close range, longer runs across a wider gap
            if max(ga, gb) <= (gap if n > 1 else 2):
                out[-1][0] += n
                out[-1][2], out[-1][4] = pa + n, pb + n
                continue
        if n > 1 or len(a) == 1:
            out.append([n, pa, pa + n, pb, pb + n])
    return [tuple(x) for x in out]


def _best_two(dense: list[tuple[int, int, int, int, int]], n: int) -> list[tuple[int, int, int, int, int]]:
    """The longest dense stretch and, if it holds more than most sentences (16 words, or a sixth of a short item), the second one."""
    s = sorted(dense, key=lambda x: -x[0])
    return s[:1] + [x for x in s[1:2] if x[0] >= min(16, max(6, n // 6))]


def _dense(a: list[int], blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The best one or two stretches in which 3 tokens in 4 are alike."""
    return _best_two([x for x in stretches(a, blocks) if x[0] >= 0.75 * max(x[2] - x[1], x[4] - x[3])], len(a))


def followed(a: list[int], b: list[int]) -> int:
    """Words of ``a`` followed in the best one or two dense stretches."""
    return sum(x[0] for x in _dense(a, blocks_of(a, b)))


def _numbered(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of ``x`` in the sorted ``known``, -1 where it isn't there."""
    if not len(known):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at, -1)


def pairs_alike(pa: np.ndarray, pb: np.ndarray, at: np.ndarray, shifts: np.ndarray, reach: int = 14) -> int:
    """How many of an item's pairs of neighbours ``pa`` stand among a text's pairs ``pb`` at the places ``at``, too, near one of the
    diagonals ``shifts`` (anywhere, where there are very many: an upper bound)."""
    if len(pa) * len(pb) > 4_000_000:
        return int(np.isin(pa, pb).sum())
    i, j = np.nonzero(pa[:, None] == pb[None, :])
    if not len(i):
        return 0
    d = at[j] - i
    s = np.sort(shifts)
    k = np.searchsorted(s, d)
    near = np.minimum(np.abs(s[np.minimum(k, len(s) - 1)] - d), np.abs(s[np.maximum(k - 1, 0)] - d)) <= reach
    i = i[near]
    return int((np.diff(i) != 0).sum()) + 1 if len(i) else 0


def template_followed(index: Index, i: int, docs: Texts, d: int, region: tuple[int, int]) -> tuple[float, float, float]:
    """(share of the item's template tokens followed in one or two dense stretches, share of their slots whose fillers map
    consistently, share of them filled alike)."""
    t = index.texts
    ia, ib = t.tok_at[i], t.tok_at[i + 1]
    da, db = docs.tok_at[d] + region[0], docs.tok_at[d] + region[1]
    a, b = t.toks[ia:ib].tolist(), docs.toks[da:db].tolist()
    blocks = blocks_of(a, b)
    best = _dense(a, blocks)
    maps: dict[tuple, dict[tuple, int]] = {}
    slots = same = 0
    for pa, pb, n in blocks:
        if not any(x[1] <= pa and pa + n <= x[2] for x in best):
            continue
        for k in range(n):
            p, q = ia + pa + k, da + pb + k
            if t.slot[p]:
                x = tuple(t.words[t.first[p] : t.first[p] + t.count[p]].tolist())
                y = tuple(docs.words[docs.first[q] : docs.first[q] + docs.count[q]].tolist())
                to = maps.setdefault(x, {})
                to[y] = to.get(y, 0) + 1
                slots += 1
                same += x == y
    agree = sum(max(m.values()) for m in maps.values())
    return sum(x[0] for x in best) / max(1, len(a)), agree / slots if slots else 1.0, same / slots if slots else 1.0


SCHEMA = "doc_id long, item_id long, coverage double, template_coverage double, slot_consistency double, slots_same double"


def match_texts(index: Index, texts: list[str], vocabulary: Vocabulary, under: float = UNDER) -> Iterator[tuple[int, int, float, float, float, float]]:
    """(number of the text, item id, coverage, template coverage, slot consistency, slots filled alike) of candidate pairs.

    The templates of pairs whose wording is followed are taken as followed where the words are.
    """
    docs = read_texts(texts, vocabulary)
    t = index.texts
    pairs, doc_pairs = _mix(t.words[:-1], t.words[1:]), _mix(docs.words[:-1], docs.words[1:])
    known, pairs = np.unique(pairs, return_inverse=True)
    doc_pairs = _numbered(known, doc_pairs)
    held, wanted, marked = np.zeros(len(known), dtype=bool), np.zeros(len(known) + 1, dtype=bool), -1
    for d, i, p, q in candidates(index, docs, under):
        wa, wb = docs.word_at[d], docs.word_at[d + 1]
        a = t.words[t.word_at[i] : t.word_at[i + 1]]
        # words three in four alike, runs of three between edits, keep two pairs of neighbours of every four words
        least = 2 / 9 * len(a) - 3
        own = pairs[t.word_at[i] : t.word_at[i + 1] - 1]
        if d != marked:
            held[:], marked = False, d
            in_doc = doc_pairs[wa : max(wa, wb - 1)]
            held[in_doc[in_doc >= 0]] = True
        alike = int(held[own].sum())  # anywhere in the document: at least as many as near the diagonals
        if least >= 1 and alike < least and _covered(p) < index.size[i] / 3:
            yield d, index.ids[i], 0.0, 0.0, 1.0, 1.0
            continue
        words = docs.words[wa:wb]
        shift = (docs.first[q + docs.tok_at[d]] - wa) - (t.first[p + t.tok_at[i]] - t.word_at[i])
        u, cnt = np.unique(shift, return_counts=True)
        o = int(u[np.argmax(cnt)])
        if 0 <= o <= len(words) - len(a) and (words[o : o + len(a)] == a).all():
            yield d, index.ids[i], 1.0, 1.0, 1.0, 1.0
            continue
        size = int(docs.tok_at[d + 1] - docs.tok_at[d])
        region = max(0, int(q.min()) - len(a) - 10), min(size, int(q.max()) + len(a) + 10)
        coverage = 0.0
        lo, hi = docs.first[region[0] + docs.tok_at[d]], docs.first[region[1] - 1 + docs.tok_at[d]] + docs.count[region[1] - 1 + docs.tok_at[d]]
        if least >= 1 and alike >= least:
            wanted[own] = True  # the last place, of -1, is never wanted
            at = np.flatnonzero(wanted[doc_pairs[lo : hi - 1]])
            wanted[own] = False
            alike = pairs_alike(own, doc_pairs[lo + at], at, shift - (lo - wa))
        if least < 1 or alike >= least:
            lo, hi = lo - wa, hi - wa
            coverage = followed(a.tolist(), words[lo:hi].tolist()) / len(a)
        followed_t, consistency, same = (coverage, 1.0, 1.0)
        if coverage < 1 / 3 and _covered(p) >= index.size[i] / 3 or coverage >= 1 / 3:
            followed_t, consistency, same = template_followed(index, i, docs, d, region)
        yield d, index.ids[i], coverage, followed_t, consistency, same


def find_leaks(documents: DataFrame, items: DataFrame, block_items: int = BLOCK_ITEMS, least: float = 0.2) -> DataFrame:
    """Pairs of a document (doc_id, text) and an evaluation item (item_id, text) that it holds passages of.

    ``coverage`` is the share of the item's words followed in one or two stretches, in order;
    ``template_coverage`` the same of its template tokens; ``slot_consistency`` the share of the slots there that
    map consistently and ``slots_same`` of those filled alike. Pairs come out if coverage or, with
    consistent slots, template coverage reaches ``least``. Each document's whole text is read;
    repeated documents each get their pairs. NULL or blank texts and NULL ids give no pairs, an empty side an empty
    result; extra columns are ignored. Of repeated item ids each row is matched by itself. An item
    of fewer than six template tokens is found where its whole template stands.

    Map-only: one pass over the documents per ``block_items`` items (the driver and each worker
    hold one block's index, some tens of MB; how many blocks there are doesn't matter to memory). Which words
    count as names is settled over all items first, so blocks don't change templates.
    """
    spark = documents.sparkSession
    docs = spread(documents.select("doc_id", "text").filter("doc_id is not null and text is not null"))
    chosen = items.select("item_id", "text").filter("item_id is not null and text is not null")
    names = NameBits().add(r.text for r in chosen.toLocalIterator())
    parts: list[DataFrame] = []

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(build_index(block, names))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = shared.value
            vocabulary = Vocabulary(index.names)
            for pdf in batches:
                ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
                got = [
                    (ids[k + d], *f)
                    for k in range(0, len(ids), SLICE)
                    for d, *f in match_texts(index, texts[k : k + SLICE], vocabulary)
                    if f[1] >= least or (f[2] >= least and f[3] >= 0.8)
                ]
                yield pd.DataFrame(got, columns=[c.split()[0] for c in SCHEMA.split(", ")])

        return docs.mapInPandas(run, SCHEMA)

    block: list[tuple[int, str]] = []
    for r in chosen.toLocalIterator():
        block.append((r.item_id, r.text))
        if len(block) == block_items:
            parts.append(scan(block))
            block = []
    if block or not parts:
        parts.append(scan(block))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kind_of(least: float = 1 / 3):
    """'wording' if a third of the words is followed, else 'reparameterised' if half of the template is followed and nine
    slots in ten are replaced consistently, else NULL. By chance texts of one kind reach about two fifths of a template."""
    return F.when(F.col("coverage") >= least, "wording").when(
        (F.col("template_coverage") >= least * 1.5) & (F.col("slot_consistency") >= 0.9), "reparameterised"
    )
