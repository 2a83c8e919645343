"""Personal information in free text, found by a semi-Markov conditional random field.

Whole segments are proposed and scored by whole-span features: the shape of numbers, check
digits, the parts an address has, how its words look as given or family names and what a public
vocabulary says of them, and classes of cue words around. A dynamic program over segments of
bounded length chooses boundaries and types jointly. The weights are trained here by maximum
likelihood on generated sentences.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.engine.scale import BROADCAST_ROWS, spread
from tidemark.engine.session import ensure_checkpoint_dir
from tidemark.llm.contamination import LOOKALIKES
from tidemark.llm.pii_words import BODIES, LITTLE, PAIRS, PARTICLES, PLACES, cue_classes

#: Words of a name at most (initials and particles not counted): the bound of the dynamic program's segments.
NAME_WORDS = 5
#: Labelled names (rows of the name table) read at most to fit the name model.
NAME_SAMPLE = 4000

KINDS = ("email", "phone", "identity", "address", "name")

VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def vocabulary_paths() -> list[str]:
    """Ranks files that tell ordinary words from names: TIDEMARK_WORD_VOCABULARIES (separated by ':') or the default ones."""
    own = os.environ.get("TIDEMARK_WORD_VOCABULARIES")
    return own.split(":") if own else list(VOCABULARIES)


# ---------------------------------------------------------------- patterns of candidates

_AT = r"(?:\s?@\s?|\s?[\[({<]\s?at\s?[\])}>]\s?|\s+at\s+)"
_DOT = r"(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\s+dot\s+)"
_MAIL_AT = re.compile(_AT, re.I)
_MAIL_DOT = re.compile(_DOT, re.I)
_MAIL_SPOT = re.compile(r"@|(?<![^\W_])at(?![^\W_])", re.I)
_MAIL_HOST = re.compile(r"[^\W_][\w-]*(?:" + _DOT + r"[^\W_][\w-]*)+", re.I)
_MAIL_NEXT = re.compile(r"\s?[\])}>]?\s*" + _MAIL_HOST.pattern, re.I)
_LOCAL = frozenset("_.+%-")
_SEP = "[ \xa0\u2009\u202f\u2010\u2011\u2013-]"
PHONE = re.compile(
    r"(?<![\w.+/-])(?<!\d:)(?:\+ ?|\((?=\+?\d))?\d(?:[\d]|(?:" + _SEP + r"|[./])(?=[\d(])|\)" + _SEP + r"?(?=\d)|\((?=\d)){7,24}(?!\w)"
)
NINO = re.compile(r"(?<![\w-])[A-Za-z]{2}(?:" + _SEP + r"?\d{2}){3}" + _SEP + r"?[A-Za-z](?![\w-])")
SSN = re.compile(r"(?<![\w.-])\d{3}(" + _SEP + r")\d{2}\1\d{4}(?![\w-])")
HEALTH = re.compile(r"(?<![\w.+/-])\d{3}(" + _SEP + r"?)\d{3}\1\d{4}(?![\w-])")
_DASHES = str.maketrans("\xa0\u2009\u202f\u2010\u2011\u2013", "   ---")

#: Six digits with little between them: what every number looked for holds.
_SIX = re.compile(r"\d(?:[ \xa0\u2009\u202f\u2010\u2011\u2013./()-]{0,2}\d){5}")

_GAP = r"(?:,?[ \t\xa0]*\r?\n\s*|,\s*|\s+)"
_NAMEWORD = r"[^\W\d_][\w'’.-]*"
# Words for ways, before or after their names, in several languages.
_STRONG_WAY = r"street|str?\.?|road|rd\.?|lane|ln\.?|avenue|ave\.?|boulevard|blvd\.?|crescent|cres\.?|terrace|ter\.?|drive|dr\.?|highway|hwy\.?|mews|parkway|pkwy\.?"
_WEAK_WAY = r"close|cl\.?|way|place|pl\.?|court|ct\.?|gardens|grove|hill|square|sq\.?|row|park|walk|gate|green|view|rise|quay|circle|alley"
_FLAT = re.compile(r"(?<![\w-])(?:flat|unit|apt\.?|apartment|suite|room|floor|studio)\s+\w{1,5}" + _GAP + r"$", re.I)
_DIGITS = re.compile(r"\d+")
_HOUSE = re.compile(r"(?<![\w.:/-])\d{1,5}[A-Za-z]?(?:[-/]\d{1,4})?(?:\s(?:bis|ter))?,?\s+(?=[^\W\d_])")
_STREET = re.compile(
    r"(?:(?:" + _NAMEWORD + r"\s+){1,4}?(?:(?P<strong>" + _STRONG_WAY + r")|(?P<weak>" + _WEAK_WAY + r"))(?![\w'’])(?:\s(?:N|S|E|W|NE|NW|SE|SW)\b)?"
    r"|(?P<fr>rue|avenue|av\.|boulevard|bd\.?|place|chemin|allée|impasse|quai|cours|passage)\s+(?:(?:de|du|des|la|le|les|l['’]|d['’])\s?)*" + _NAMEWORD + r"(?:(?:\s[^\W\d_][\w'’-]*){1,3}?(?=,|\s*\n|\s\d|$))?)",
    re.I,
)
_COMPOUNDS = ("straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ring", "damm", "ufer", "straat", "laan", "gracht", "plein", "gatan", "vägen", "vej", "gade", "veien")
_HOUSE_AFTER = re.compile(r"\d{1,4}\s?[A-Za-z]?(?!\w)")
_FIRST_WORDS = ("calle", "avenida", "avda", "plaza", "paseo", "carrer", "ronda", "camino", "c/", "via", "piazza", "corso", "rua", "travessa", "praça", "ul.", "ulica")
_WAY_FIRST = re.compile(
    r"(?<!\w)(?:calle|avenida|avda\.?|plaza|paseo|carrer|ronda|camino|c/|via|viale|piazza|corso|rua|travessa|praça|ul\.|ulica)\s?"
    r"(?:[^\W\d_][\w'’.-]*\s){0,5}?[^\W\d_][\w'’.-]*,?\s(?:n[º°.o]\s?)?\d{1,4}(?![\w-])", re.I
)
_TOWN = r"[^\W\d_][\w'’.-]*(?:[ \xa0][^\W\d_][\w'’-]*){0,2}?"
_POST_UK = r"[A-Za-z]{1,2}\d[A-Za-z\d]?\s?\d[A-Za-z]{2}(?!\w)"
_TAILS = [
    ("uk", re.compile(_GAP + r"(?P<town>" + _TOWN + r")(?P<post>" + _GAP + _POST_UK + r")", re.I)),
    ("us", re.compile(_GAP + r"(?P<town>" + _TOWN + r"),?\s+(?:[A-Z]{2}|[A-Z][a-z]+)\.?,?\s+\d{5}(?:-\d{4})?(?!\w)")),
    ("num", re.compile(_GAP + r"(?:[A-Z]{1,2}-)?(?:\d{4}\s?[A-Z]{2}|\d{2}-\d{3}|\d{3}\s\d{2}|\d{4,5})[ \xa0]+(?P<town>[^\W\d_][\w'’-]*)(?!\w)", re.I)),
    ("post", re.compile(_GAP + _POST_UK, re.I)),
    ("town", re.compile(_GAP + r"(?P<town>[^\W\d_a-z][\w'’-]+(?:[ \xa0][^\W\d_a-z][\w'’-]+)?)(?![\w'’-])")),
]
#: What may stand inside a word: apostrophes and hyphens, invisible characters, a hyphen at a line's end.
_INNER = r"(?:['’]|-(?:\r?\n)?|[\u00ad\u200b-\u200d\u2060\ufeff]+)"
_HIDDEN = re.compile(r"(?<=[^\W\d_])-\r?\n(?=[^\W\d_])|[\u00ad\u200b-\u200d\u2060\ufeff]")
WORD = re.compile(r"[^\W\d_]+(?:" + _INNER + r"[^\W\d_]+)*")
_CAP = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:" + _INNER + r"[^\W\d_]+)*"
_PART = r"(?:" + "|".join(sorted(PARTICLES, key=lambda p: (-len(p), p))) + r")(?![^\W\d_])"
_LINK = r"(?:,[ \t]|[ \t\xa0]|\r?\n)"
_RUN = re.compile(_CAP + r"(?:" + _LINK + r"(?:" + _PART + r"|[^\W\d_]\.(?![^\W\d_]{2})|" + _CAP + r"))+")
_UNIT = re.compile(r"[^\W\d_]\.|" + WORD.pattern)
_LETTERS = re.compile(r"[^\W\d_]{3,}")
_SMALL_NEXT = re.compile(r"(?:[ \xa0]|\r?\n)((?:[^\W\d_]\.[ \xa0])?)(" + WORD.pattern + ")")
_ALNUM = re.compile(r"[^\W_]+")


def fold(s: str) -> str:
    s = s.lower()
    return s if s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def health_check(digits: str) -> bool:
    """Ten digits whose last is 11 minus the weighted sum modulo 11 (weights 10 to 2; 11 counts as 0, 10 is never valid)."""
    if len(digits) != 10:
        return False
    c = 11 - sum(int(d) * w for d, w in zip(digits, range(10, 1, -1), strict=False)) % 11
    return (0 if c == 11 else c) == int(digits[9]) and c != 10


# ---------------------------------------------------------------- what is known of words


@dataclass
class NameModel:
    """Likeness of words to given and family names: stocks, log odds of word beginnings and ends, and vocabulary classes."""

    given: dict[str, float] = field(default_factory=dict)
    family: dict[str, float] = field(default_factory=dict)
    stock: tuple[frozenset[str], frozenset[str]] = (frozenset(), frozenset())
    classes: dict[str, str] = field(default_factory=dict)
    cache: dict[str, tuple] = field(default_factory=dict, repr=False)

    @staticmethod
    def grams(w: str) -> list[str]:
        return [f"^{w[:2]}", f"^{w[:3]}", f"{w[-2:]}$", f"{w[-3:]}$", f"{w[-4:]}$"]

    @classmethod
    def fit(cls, given: list[str], family: list[str], classes: dict[str, str]) -> NameModel:
        """Names against the vocabulary's ordinary words."""
        split = lambda ws: sorted({p for w in ws if w for p in re.split(r"['’\s-]+", fold(w)) if len(p) > 1})
        other = sorted(w for w, c in classes.items() if c in ("common", "known") and len(w) > 2)

        def counts(words: list[str]) -> dict[str, float]:
            out: dict[str, float] = {}
            for w in words:
                for g in cls.grams(w):
                    out[g] = out.get(g, 0) + 1 / max(1, len(words))
            return out

        b = counts(other)
        eps2 = 2.0 / max(1, len(other))

        def odds(pos: list[str]) -> dict[str, float]:
            a = counts(pos)
            eps = 0.5 / max(1, len(pos))
            return {g: math.log((a.get(g, 0) + eps) / (b.get(g, 0) + eps2)) for g in a.keys() | b.keys()}

        given, family = split(given), split(family)
        return cls(odds(given), odds(family), (frozenset(given), frozenset(family)), classes)

    def look(self, word: str) -> tuple[float, float, bool, bool, str]:
        """(given likeness, family likeness, in the given stock, in the family stock, class) of a written word."""
        s = self.cache.get(word)
        if s is None:
            written = word
            if not word.isascii():
                word = unicodedata.normalize("NFKC", word).translate(LOOKALIKES)
            parts = [p for p in re.split(r"['’-]", fold(word)) if len(p) > 1] or [fold(word)]
            g, f = [], []
            for p in parts:
                gr = self.grams(p)
                g.append(sum(self.given.get(x, 0.0) for x in gr) / len(gr))
                f.append(sum(self.family.get(x, 0.0) for x in gr) / len(gr))
            low = word.lower()
            kind = "title" if "title" in _CUE.get(fold(word), ()) else "body" if low in BODIES else ("place" if word.capitalize() in _PLACE_SET else "common" if low in LITTLE else self.classes.get(low, "rare"))
            s = (max(g), min(f), any(p in self.stock[0] for p in parts), all(p in self.stock[1] for p in parts), kind)
            if len(self.cache) > 300_000:
                self.cache.clear()
            self.cache[written] = s
        return s

    def likely_given(self, chunk: str) -> tuple[str, ...]:
        """The words without capitals in a piece of text that may be given names."""
        out = []
        for w in _LETTERS.findall(chunk):
            if w.islower():
                g, _, stocked, _, kind = self.look(w)
                if (stocked and kind != "common") or (g > 1.2 and kind == "rare"):
                    out.append(w)
        return tuple(out)


_PLACE_SET = frozenset(PLACES)
_PAIR_SET = frozenset(p.lower() for p in PAIRS)
_CUE = cue_classes()


@dataclass(frozen=True, slots=True)
class Segment:
    """A proposed span with the features of its own text; those of the words around are added by ``context``."""

    start: int
    end: int
    kind: str
    features: tuple[str, ...]


_CUE_CACHE: dict[str, tuple[str, ...]] = {}


def _cues(word: str) -> tuple[str, ...]:
    got = _CUE_CACHE.get(word)
    if got is None:
        if len(_CUE_CACHE) > 300_000:
            _CUE_CACHE.clear()
        got = _CUE_CACHE[word] = _CUE.get(fold(word), ())
    return got


def surroundings(text: str, start: int, end: int) -> tuple[str, tuple[str, ...], set[str], str]:
    """(sign before, classes of the word before, classes of the four words before, sign or sort of word after)."""
    before = text[max(0, start - 50) : start]
    tip = before.rstrip(" \t\xa0\r")[-1:]
    sign = "^" if not tip else ("w" if tip.isalnum() else tip)
    words = _ALNUM.findall(before)[-4:]
    last = (_cues(words[-1]) or ("none",)) if words else ()
    near = {c for w in words for c in _cues(w)}
    nxt = text[end : end + 4].lstrip(" \t\xa0\r")[:1]
    return sign, last, near, "$" if not nxt else ("d" if nxt.isdigit() else ("w" if nxt.isalpha() else nxt))


def context(text: str, start: int, end: int, kind: str) -> list[str]:
    """Features of the cue words around and the signs next to a span."""
    sign, last, near, nxt = surroundings(text, start, end)
    return [f"{kind}:s1={sign}", *[f"{kind}:c1={c}" for c in last], *[f"{kind}:near={c}" for c in sorted(near)], f"{kind}:n1={nxt}"]


def _bin(x: float) -> int:
    return max(-3, min(4, int(math.floor(x * 1.5))))


# ---------------------------------------------------------------- candidates


def _emails(text: str, names: NameModel) -> Iterator[Segment]:
    for spot in _MAIL_SPOT.finditer(text):
        a, b = spot.span()
        if _MAIL_NEXT.match(text, b) is None:
            continue
        while a > 0 and text[a - 1].isspace():
            a -= 1
        if a > 0 and text[a - 1] in "[({<":
            a -= 1
            if a > 0 and text[a - 1].isspace():
                a -= 1
        m = _MAIL_AT.match(text, a) or _MAIL_AT.match(text, spot.start())
        if m is None or m.end() < b:
            continue
        s = m.start()
        while s > 0 and (text[s - 1].isalnum() or text[s - 1] in _LOCAL):
            s -= 1
        while s < m.start() and not (text[s].isalnum() or text[s] == "_"):
            s += 1
        host = _MAIL_HOST.match(text, m.end())
        if s == m.start() or text[m.start() - 1] == "." or host is None:
            continue
        local, sign = text[s : m.start()], m.group().strip()
        at = "sign" if sign == "@" else ("word" if sign.isalpha() else "bracket")
        seps = [x.group() for x in _MAIL_DOT.finditer(host.group())]
        dot = "sign" if all(x == "." for x in seps) else ("word" if any(x.strip().isalpha() for x in seps) else "bracket")
        labels = _MAIL_DOT.split(host.group())
        if len(labels[-1]) < 2 or not labels[-1].isalpha():
            continue
        if local.isalpha():
            g, f, gs, fs, kind = names.look(local)
            shape = "name" if gs or fs or (kind == "rare" and max(g, f) > 0.5) else ("rare" if kind in ("rare", "proper") else "plain")
        else:
            shape = "marked"
        tail = "long" if len(labels[-1]) > 3 else "short"
        spaced = m.group() != m.group().strip() and at == "sign"
        one = f"{at}/{dot}/{shape}"
        first = names.look(labels[0])[4] if labels[0].isalpha() else "mixed"
        yield Segment(
            s, host.end(), "email",
            (f"email:forms={one}", f"email:at={at}/{dot}", f"email:shape={shape}", f"email:tail={tail}/{at}", f"email:spaced={spaced}", f"email:host={first}/{at}", "email:bias"),
        )


def _numbers(text: str) -> Iterator[Segment]:
    if _SIX.search(text) is None:
        return
    for m in PHONE.finditer(text):
        s = m.group().translate(_DASHES).rstrip(" -./(")
        d = re.sub(r"\D", "", s)
        if not 9 <= len(d) <= 15:
            continue
        lead = "+" if s.lstrip("(").startswith("+") else ("00" if d.startswith("00") else ("0" if d[0] == "0" else ("(" if s[0] == "(" else "d")))
        groups = [len(g) for g in re.findall(r"\d+", s)]
        seps = "".join(sorted(set(re.sub(r"[\d+]", "", s))))
        ident = "ssn" if SSN.fullmatch(s) else ("health" if HEALTH.fullmatch(s) and health_check(d) else ("ten" if HEALTH.fullmatch(s) else "no"))
        yield Segment(
            m.start(), m.start() + len(s), "phone",
            (f"phone:lead={lead}", f"phone:n={len(d)}/{lead}", f"phone:groups={'-'.join(map(str, groups[:5]))}/{lead}", f"phone:count={min(len(groups), 6)}/{lead}",
             f"phone:idlike={ident}/{lead}", f"phone:seps={seps}/{lead}", f"phone:one={len(groups) == 1}/{lead}/{len(d)}", "phone:bias"),
        )
    for m in NINO.finditer(text):
        s = m.group().upper()
        prefix = "sample" if s[:2] == "QQ" else ("bad" if s[0] in "DFIQUV" or s[1] in "DFIOQUV" or s[:2] in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ") else "good")
        yield Segment(m.start(), m.end(), "identity", ("identity:nino", f"identity:prefix={prefix}", f"identity:suffix={s[-1] in 'ABCD'}/{prefix}", "identity:bias"))
    for m in SSN.finditer(text):
        yield Segment(m.start(), m.end(), "identity", ("identity:ssn", f"identity:ssn_sep={m.group(1).translate(_DASHES)}", "identity:bias"))
    for m in HEALTH.finditer(text):
        ok = health_check(re.sub(r"\D", "", m.group()))
        sep = m.group(1).translate(_DASHES) or "none"
        yield Segment(m.start(), m.end(), "identity", (f"identity:health={ok}", f"identity:health_sep={sep}/{ok}", "identity:bias"))


def _tails(text: str, end: int) -> list[tuple[str, int]]:
    """(kind, end) of what may follow a street, the longest first; a bare street is one, too."""
    out = [("none", end)]
    for kind, p in _TAILS:
        m = p.match(text, end)
        if m:
            out.append((kind, m.end()))
            if kind == "uk":
                out.append(("town", m.end("town")))
    return sorted(set(out), key=lambda t: -t[1])


def _addresses(text: str, low: str, names: NameModel) -> Iterator[Segment]:
    def spans(start: int, street_end: int, form: str, extra: list[str], flat: int | None) -> Iterator[Segment]:
        tails = _tails(text, street_end)
        posted = any(k in ("uk", "us", "num", "post") for k, _ in tails)
        for kind, end in tails:
            full = kind in ("uk", "us", "num", "post") or not posted
            fs = [f"address:parts={form}/{kind}", f"address:full={full}/{kind}", f"address:tail={kind}", *[f"address:{x}" for x in extra],
                  *[f"address:{x}/{kind in ('none', 'town')}" for x in extra], "address:bias"]
            if flat is not None:
                yield Segment(flat, end, "address", (*fs, "address:flat"))
                yield Segment(start, end, "address", (*fs, "address:flat_cut"))
            else:
                yield Segment(start, end, "address", tuple(fs))

    for d in _DIGITS.finditer(text):
        if d.end() - d.start() > 5:
            continue
        if d.start() and text[d.start() - 1].isspace():
            yield from _compound_streets(text, d.start(), spans)
        m = _HOUSE.match(text, d.start())
        if m is None:
            continue
        st = _STREET.match(text, m.end())
        if st is None:
            continue
        f = _FLAT.search(text, max(0, m.start() - 30), m.start())
        way = "strong" if st["strong"] else ("weak" if st["weak"] else "fr")
        words = WORD.findall(st.group())
        kinds = [names.look(w)[4] for w in words[:-1]] or ["none"]
        caps = "upper" if st.group().isupper() else ("cap" if all(w[0].isupper() or w in PARTICLES for w in words) else ("lower" if st.group().islower() else "mixed"))
        dull = sum(k == "common" for k in kinds) * 2 > len(kinds)
        yield from spans(m.start(), st.end(), way, [f"caps={caps}/{way}", f"dull={dull}/{caps}", f"words={len(words)}"], f.start() if f else None)
    if not any(x in low for x in _FIRST_WORDS):
        return
    for m in _WAY_FIRST.finditer(text):
        yield from spans(m.start(), m.end(), "first", [f"caps={any(c.isupper() for c in m.group())}/first"], None)


def _compound_streets(text: str, number: int, spans) -> Iterator[Segment]:
    """Streets whose way is the end of a word, before a house number at ``number``."""
    tip = number
    while tip > 0 and text[tip - 1].isspace():
        tip -= 1
    way = text[max(0, tip - 8) : tip].lower()
    if not way.endswith(_COMPOUNDS):
        return
    m = _HOUSE_AFTER.match(text, number)
    if m is None:
        return
    s = tip - len(max((x for x in _COMPOUNDS if way.endswith(x)), key=len))
    joined = s > 0 and (text[s - 1].isalpha() or text[s - 1] == "-")
    while s > 0 and (text[s - 1].isalpha() or text[s - 1] == "-"):
        s -= 1
    if not joined:  # 'Lange Straße 12': the word before belongs to the street
        k = s
        while k > 0 and text[k - 1] == " ":
            k -= 1
        while k > 0 and (text[k - 1].isalpha() or text[k - 1] in "-."):
            k -= 1
        s = k if k < s and text[k : k + 1].isupper() else s
    cap = text[s : s + 1].isupper()
    yield from spans(s, m.end(), "compound", [f"caps={cap}/compound", f"joined={joined}"], None)


def _loud(text: str, start: int, end: int) -> bool:
    """Whether the letters around a segment are capitals, too."""
    around = [c for c in text[max(0, start - 30) : start] + text[end : end + 30] if c.isalpha()]
    return len(around) >= 6 and sum(c.isupper() for c in around) >= 0.8 * len(around)


def name_features(words: tuple[str, ...], shape: tuple, names: NameModel) -> tuple[str, ...]:
    """Features of a name's own words; ``shape`` = (turned round, initials, particles, across lines, case)."""
    swapped, initials, particles, line, case = shape
    given, rest = (words[-1], words[:-1]) if swapped else (words[0], words[1:])
    family, middle = (rest[0], rest[1:]) if swapped else (rest[-1], rest[:-1])
    g, _, gs, _, gk = names.look(given)
    _, f, _, fs, fk = names.look(family)
    likely = (gs or g > 0.4) and (fs or f > 0.3)
    out = [
        f"name:g={_bin(g)}", f"name:f={_bin(f)}", f"name:like={_bin(g)}/{_bin(f)}", f"name:stock={gs}/{fs}", f"name:classes={gk}/{fk}/{case}",
        f"name:given={gs}/{gk}", f"name:family={fs}/{fk}", f"name:case={case}/{gs}/{fs}", f"name:case={case}/{likely}", f"name:swapped={swapped}/{gs}/{likely}",
        f"name:initials={min(initials, 2)}/{likely}", f"name:words={len(words)}/{particles > 0}", f"name:line={line}/{likely}", f"name:line_stock={line}/{gs}/{fs}",
        f"name:twice={fold(given) == fold(family)}", f"name:pair={' '.join(words).lower() in _PAIR_SET}", f"name:likely={likely}/{gs}/{fs}", "name:bias",
    ]
    dull = sum(names.look(w)[4] == "common" for w in words)
    out.append(f"name:dull={dull}/{min(len(words), 3)}")
    for w in middle:
        mg, mf, ms, mfs, mk = names.look(w)
        out.append(f"name:middle={ms or mfs}/{mk}/{max(mg, mf) > 0.4}")
    return tuple(out)


def run_spans(run: str) -> list[tuple[int, int, tuple[str, ...], tuple]]:
    """(start, end, words, shape) of all spans in a run of capitalised words that may be a name: two to NAME_WORDS
    words with initials and particles between."""
    out = []
    units = [(u.start(), u.end(), u.group() if u.group().isalpha() else _HIDDEN.sub("", u.group())) for u in _UNIT.finditer(run)]
    sort = ["I" if len(w) <= 2 and (w[-1] == "." or len(w) == 1) else ("P" if w.islower() and w in PARTICLES else "W") for _, _, w in units]
    for i in range(len(units)):
        if sort[i] != "W" or not units[i][2][0].isupper():
            continue
        words, initials, particles, line, commas = [units[i][2]], 0, 0, False, 0
        for j in range(i + 1, len(units)):
            gap = run[units[j - 1][1] : units[j][0]]
            if "," in gap:
                commas += 1
                if commas > 1 or particles or initials or len(words) > 1:
                    break
            line = line or "\n" in gap
            w = units[j][2]
            if sort[j] == "I":
                initials += 1
                continue
            if sort[j] == "P":
                particles += 1
                if particles > 2 or commas:
                    break
                continue
            if not w[0].isupper():
                break
            words.append(w)
            if len(words) > (2 if commas else NAME_WORDS):
                break
            case = "upper" if all(x.isupper() for x in words) else "cap"
            out.append((units[i][0], units[j][1], tuple(words), (bool(commas), initials, particles, line, case)))
    return out


def small_spans(text: str, likely: Callable[[str], tuple[str, ...]]) -> Iterator[tuple[int, int, tuple[str, ...], tuple]]:
    """Spans of two small words of which one may be a given name; a family name before it needs a comma.
    ``likely`` gives the words of a piece without blanks that may be given names."""
    for w in {w for chunk in set(text.split()) for w in likely(chunk)}:
        for m in re.finditer(r"(?<![^\W\d_])" + w + r"(?![^\W\d_'’-])", text):
            nxt = _SMALL_NEXT.match(text, m.end())
            if nxt and nxt.group(2).islower() and len(nxt.group(2)) > 2:
                gap = text[m.end() : nxt.start(2)]
                yield m.start(), nxt.end(), (w, nxt.group(2)), (False, int(bool(nxt.group(1))), 0, "\n" in gap, "lower")
            if text[max(0, m.start() - 2) : m.start()] == ", ":
                k = m.start() - 2
                while k > 0 and (text[k - 1].isalpha() or text[k - 1] in "'’-"):
                    k -= 1
                before = text[k : m.start() - 2]
                if len(before) > 2 and before.islower() and WORD.fullmatch(before):
                    yield k, m.end(), (before, w), (True, 0, 0, False, "lower")


def name_spans(text: str, names: NameModel) -> Iterator[tuple[int, int, tuple[str, ...], tuple]]:
    """All spans of a text that may be a name; capitals in a text of capitals say nothing ('loud')."""
    for run in _RUN.finditer(text):
        off = run.start()
        for s, e, words, shape in run_spans(run.group()):
            if shape[-1] == "upper" and _loud(text, off + s, off + e):
                shape = (*shape[:-1], "loud")
            yield off + s, off + e, words, shape
    yield from small_spans(text, names.likely_given)


def _other_segments(text: str, names: NameModel) -> list[Segment]:
    low = text.lower()
    out: list[Segment] = []
    if "@" in text or "at" in low:
        out += _emails(text, names)
    out += _numbers(text)
    out += _addresses(text, low, names)
    return out


def segments(text: str, names: NameModel) -> list[Segment]:
    """Candidate segments with the features of their own text and of the words around."""
    own = _other_segments(text, names)
    own += [Segment(s, e, "name", name_features(w, sh, names)) for s, e, w, sh in name_spans(text, names)]
    return [Segment(c.start, c.end, c.kind, (*c.features, *context(text, c.start, c.end, c.kind))) for c in own]


# ---------------------------------------------------------------- decoding and training


def best_chain(scored: list[tuple[Segment, float]]) -> list[Segment]:
    """The non-overlapping segments with the greatest total score (semi-Markov Viterbi)."""
    scored = sorted((x for x in scored if x[1] > 0), key=lambda x: (x[0].end, x[0].start))
    if not scored:
        return []
    points = sorted({p for c, _ in scored for p in (c.start, c.end)})
    at = {p: i for i, p in enumerate(points)}
    best = [0.0] * len(points)
    back: list[tuple[Segment, int] | None] = [None] * len(points)
    ends: dict[int, list[tuple[Segment, float]]] = {}
    for c, s in scored:
        ends.setdefault(at[c.end], []).append((c, s))
    for i in range(1, len(points)):
        best[i] = best[i - 1]
        for c, s in ends.get(i, ()):
            if (v := best[at[c.start]] + s) > best[i] + 1e-12:
                best[i], back[i] = v, (c, at[c.start])
    out, i = [], len(points) - 1
    while i > 0:
        if back[i] is not None:
            out.append(back[i][0])
            i = back[i][1]
        else:
            i -= 1
    return out[::-1]


def chosen(cands: list[Segment], weights: dict[str, float]) -> list[Segment]:
    return best_chain([(c, sum(weights.get(f, 0.0) for f in c.features)) for c in cands])


def _marginals(cands: list[Segment], scores: list[float]) -> list[float]:
    """Probability of each candidate under the segment lattice (forward-backward in log space)."""
    points = sorted({p for c in cands for p in (c.start, c.end)})
    at = {p: i for i, p in enumerate(points)}
    n = len(points)
    ninf = float("-inf")

    def lse(a: float, b: float) -> float:
        if a == ninf:
            return b
        if b == ninf:
            return a
        m = max(a, b)
        return m + math.log(math.exp(a - m) + math.exp(b - m))

    ends: dict[int, list[int]] = {}
    starts: dict[int, list[int]] = {}
    for k, c in enumerate(cands):
        ends.setdefault(at[c.end], []).append(k)
        starts.setdefault(at[c.start], []).append(k)
    fwd = [0.0] * n
    for i in range(1, n):
        fwd[i] = fwd[i - 1]
        for k in ends.get(i, ()):
            fwd[i] = lse(fwd[i], fwd[at[cands[k].start]] + scores[k])
    bwd = [0.0] * n
    for i in range(n - 2, -1, -1):
        bwd[i] = bwd[i + 1]
        for k in starts.get(i, ()):
            bwd[i] = lse(bwd[i], bwd[at[cands[k].end]] + scores[k])
    z = fwd[-1]
    return [math.exp(min(0.0, fwd[at[c.start]] + s + bwd[at[c.end]] - z)) for c, s in zip(cands, scores, strict=True)]


def train(examples: list[tuple[str, set[tuple[int, int, str]]]], names: NameModel, epochs: int = 5, rate: float = 0.2, decay: float = 2e-3) -> dict[str, float]:
    """Maximum-likelihood weights (AdaGrad with L2 decay); deterministic."""
    data = [(segments(t, names), gold) for t, gold in examples]
    data = [(c, [(s.start, s.end, s.kind) in gold for s in c]) for c, gold in data if c]
    w: dict[str, float] = {}
    g2: dict[str, float] = {}
    for _ in range(epochs):
        for cands, gold in data:
            scores = [sum(w.get(f, 0.0) for f in c.features) for c in cands]
            for c, y, p in zip(cands, gold, _marginals(cands, scores), strict=True):
                d = y - p
                if abs(d) < 1e-3:
                    continue
                for f in c.features:
                    g = d - decay * w.get(f, 0.0)
                    g2[f] = g2.get(f, 1e-6) + g * g
                    w[f] = w.get(f, 0.0) + rate * g / math.sqrt(g2[f])
    return w


@dataclass
class Model:
    """Names and weights. ``find`` keeps what it learnt of runs of words and of single words; the words around are
    looked at only where they could decide."""

    names: NameModel
    weights: dict[str, float]
    runs: dict[str, list] = field(default_factory=dict, repr=False)
    small: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)
    ctx: dict[str, dict[str, dict[str, float]]] = field(default_factory=dict, repr=False)
    reach: float = -1.0

    def _prepare(self) -> None:
        """The weights of the words around by kind and slot, and the most they can add to a name's score."""
        self.ctx = {k: {slot: {} for slot in ("s1", "c1", "near", "n1")} for k in KINDS}
        for f, w in self.weights.items():
            kind, _, rest = f.partition(":")
            slot, eq, value = rest.partition("=")
            if eq and slot in self.ctx[kind]:
                self.ctx[kind][slot][value] = w
        top = lambda slot, n: sum(sorted((max(0.0, w) for w in self.ctx["name"][slot].values()), reverse=True)[:n])
        self.reach = top("s1", 1) + top("n1", 1) + top("c1", 4) + top("near", 8)

    def _around(self, text: str, start: int, end: int, kind: str) -> float:
        t = self.ctx[kind]
        sign, last, near, nxt = surroundings(text, start, end)
        s = t["s1"].get(sign, 0.0) + t["n1"].get(nxt, 0.0)
        for c in last:
            s += t["c1"].get(c, 0.0)
        for c in near:
            s += t["near"].get(c, 0.0)
        return s

    def _own(self, words: tuple[str, ...], shape: tuple) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in name_features(words, shape, self.names))

    def _run(self, run: str) -> list[tuple[int, int, float, float, bool]]:
        """(start, end, score, score among capitals, capitals) of the spans of a run that the words around could make a name."""
        got = self.runs.get(run)
        if got is None:
            got = []
            for s, e, words, shape in run_spans(run):
                own = self._own(words, shape)
                upper = shape[-1] == "upper"
                loud = self._own(words, (*shape[:-1], "loud")) if upper else own
                if max(own, loud) + self.reach > 0:
                    got.append((s, e, own, loud, upper))
            if len(self.runs) > 200_000:
                self.runs.clear()
            self.runs[run] = got
        return got

    def _likely(self, word: str) -> tuple[str, ...]:
        got = self.small.get(word)
        if got is None:
            if len(self.small) > 500_000:
                self.small.clear()
            got = self.small[word] = self.names.likely_given(word)
        return got

    def find(self, text: str) -> list[Segment]:
        get = self.weights.get
        if self.reach < 0:
            self._prepare()
        around = self._around
        scored = []
        for c in _other_segments(text, self.names):
            scored.append((c, sum(get(f, 0.0) for f in c.features) + around(text, c.start, c.end, c.kind)))
        for run in _RUN.finditer(text):
            for s, e, own, loud, upper in self._run(run.group()):
                s, e = s + run.start(), e + run.start()
                if upper and _loud(text, s, e):
                    own = loud
                if own + self.reach > 0 and (own := own + around(text, s, e, "name")) > 0:
                    scored.append((Segment(s, e, "name", ()), own))
        for s, e, words, shape in small_spans(text, self._likely):
            own = self._own(words, shape)
            if own + self.reach > 0 and (own := own + around(text, s, e, "name")) > 0:
                scored.append((Segment(s, e, "name", ()), own))
        return best_chain(scored)


# ---------------------------------------------------------------- on tables

SPAN = "struct<start:int,stop:int,kind:string,surface:string,name_key:string>"


def name_key(surface: str) -> str:
    """Given and family name of a written name, folded; a name written family first is turned round."""
    s = re.sub(r"\s+", " ", _HIDDEN.sub("", surface)).strip()
    if "," in s:
        a, b = s.split(",", 1)
        s = f"{b.strip()} {a.strip()}"
    return fold(s.replace("’", "'").translate(LOOKALIKES))


def _known_keys(known: DataFrame) -> DataFrame:
    """Distinct folded names of ``known`` (column ``name``), folded as found ones are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"k": [name_key(n) for n in pdf["name"]]})

    return known.select("name").filter("name is not null").distinct().mapInPandas(run, "k string").filter("k <> ''").distinct()


def find_private(documents: DataFrame, model: Model, known: DataFrame, redacted: bool = False) -> DataFrame:
    """Every document's spans of personal information: doc_id, text (with ``redacted``: with each span replaced by
    [EMAIL], [NAME] …; else NULL) and spans (start and stop in code points, kind, surface, name_key), without
    the names that stand in ``known`` (column ``name``, "given family").

    One row per input row, in one pass and without a join: NULL ids and repeated ids with different
    texts are treated row by row, a NULL or empty text has no spans and stays as it is. Known names
    are held by every worker as long as they measurably are at most ``BROADCAST_ROWS``. Beyond that the
    rows with their spans are written to the checkpoint folder, found names are reduced to distinct
    keys, joined to the known ones, and the rows replaced in a second pass by their row's kept spans.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keys = _known_keys(known).persist(StorageLevel.MEMORY_AND_DISK)
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    public = spark.sparkContext.broadcast({r.k for r in keys.collect()} if few else set())
    if few:
        keys.unpersist()
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, spans array<{SPAN}>"

    def scan(texts: bool, drop: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m, out = shared.value, public.value
            for pdf in batches:
                spans, written = [], []
                for t in pdf["text"]:
                    got = []
                    for s in m.find(t) if t else ():
                        surface = t[s.start : s.end]
                        key = name_key(surface) if s.kind == "name" else None
                        if not (drop and key in out):
                            got.append({"start": s.start, "stop": s.end, "kind": s.kind, "surface": surface, "name_key": key})
                    spans.append(got)
                    written.append((replace(t, got) if drop else t) if texts else None)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].astype(object), "text": pd.Series(written, dtype=object), "spans": spans})

        return run

    docs = spread(documents.select("doc_id", "text"))
    if few:
        return docs.mapInPandas(scan(redacted, True), schema)
    ensure_checkpoint_dir(spark)
    rows = docs.mapInPandas(scan(redacted, False), schema).withColumn("__row", F.monotonically_increasing_id()).checkpoint()
    each = rows.select("__row", F.explode("spans").alias("s"))
    found = each.select(F.col("s.name_key").alias("k")).filter("k is not null").distinct()
    drop = found.join(keys, "k", "left_semi")
    kept = each.join(drop, each["s.name_key"] == drop["k"], "left_anti").groupBy("__row").agg(F.sort_array(F.collect_list("s")).alias("kept"))
    rows = rows.join(kept, "__row", "left").select("doc_id", "text", F.coalesce("kept", F.array().cast(f"array<{SPAN}>")).alias("spans"))

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["text"] = [replace(t, ss) for t, ss in zip(pdf["text"], pdf["spans"], strict=True)]
            yield pdf

    return rows.mapInPandas(second, schema) if redacted else rows


def replace(text: str | None, spans) -> str | None:
    """The text with each span replaced by its typed placeholder."""
    if text is None:
        return None
    parts, at = [], 0
    for s in spans:
        parts += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = s["stop"]
    return "".join([*parts, text[at:]])


def found_spans(documents: DataFrame, model: Model, known: DataFrame) -> DataFrame:
    """Distinct (doc_id, kind, surface) of all documents; rows without an id are left out, as nothing names them."""
    spans = find_private(documents.filter("doc_id is not null"), model, known)
    return spans.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.kind", "s.surface").distinct()


def redact(documents: DataFrame, model: Model, known: DataFrame) -> DataFrame:
    """(doc_id, text) of every row with typed placeholders in place of personal information; the rest is unchanged."""
    return find_private(documents, model, known, redacted=True).select("doc_id", "text")
