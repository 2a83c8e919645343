"""String functions as expressions; Arrow UDFs only where no built-in can express them."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Latin letters with marks and their plain forms, one to one.
ACCENTED = "àáâãäåāăąçćĉċčďđèéêëēĕėęěĝğġģĥħìíîïĩīĭįıĵķĺļľłñńņňòóôõöøōŏőŕŗřśŝşšţťŧùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccddeeeeeeeeegggghhiiiiiiiiijkllllnnnnooooooooorrrsssstttuuuuuuuuuuwyyyzzz"


def fold_accents(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def normalise_name(c: Column) -> Column:
    """Entities decoded, accents dropped, lower case, only letters, digits and single blanks. NULL stays NULL."""
    s = c
    for entity, ch in (("&amp;", "&"), ("&#39;", "'"), ("&apos;", "'"), ("&quot;", '"'), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">")):
        s = F.replace(s, F.lit(entity), F.lit(ch))
    s = F.regexp_replace(fold_accents(s), r"[-_/.]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9 ]", ""), r" +", " "))


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """All named and numeric entities (beyond the few that normalise_name decodes in the JVM)."""
    return s.map(lambda t: None if t is None else html.unescape(t))


def _indel(a: str, b: str) -> float:
    """Normalised insert/delete similarity, 0 to 100."""
    if not a and not b:
        return 100.0
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return 200.0 * prev[-1] / (len(a) + len(b))


def token_set_similarity(a: str | None, b: str | None) -> float | None:
    """Best similarity among: shared tokens, shared + rest of a, shared + rest of b. 100 if one side's tokens
    contain the other's; 0 for a side without tokens; NULL if a side is NULL."""
    if a is None or b is None:
        return None
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = sorted(x & y)
    ra, rb = sorted(x - y), sorted(y - x)
    if both and (not ra or not rb):
        return 100.0
    base = " ".join(both)
    sa, sb = " ".join([*both, *ra]), " ".join([*both, *rb])
    best = _indel(sa, sb)
    return max(best, _indel(base, sa), _indel(base, sb)) if both else best


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def season_label(start: Column) -> Column:
    """2026 → 2026-27."""
    return F.format_string("%d-%02d", start.cast("int"), F.pmod(start.cast("int") + 1, F.lit(100)))


def season_code(start: Column) -> Column:
    """2026 → 2627."""
    return F.format_string("%02d%02d", F.pmod(start.cast("int"), F.lit(100)), F.pmod(start.cast("int") + 1, F.lit(100)))


def season_of_label(label: Column) -> Column:
    y = F.regexp_extract(label, r"^(\d{4})-\d{2}$", 1)
    return F.when(y != "", y).cast("int")


#: Order matters: identifiers first, then keys in assignments, then long tokens.
REDACTIONS = [
    (r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", "<uuid>"),
    (r"(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*)[^\s&,;]+", "$1<secret>"),
    (r"(?i)(bearer )[A-Za-z0-9._~+/-]+=*", "$1<secret>"),
    (r"\b[A-Za-z0-9_-]{32,}\b", "<key>"),
]


def redact(c: Column) -> Column:
    for pattern, to in REDACTIONS:
        c = F.regexp_replace(c, pattern, to)
    return c


def parse_specs(text: str) -> list[tuple[str, int, int]]:
    """'name[:count][@at],…' → (name, count, at); the driver-side mini language for run lists."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"([\w-]+)(?::(\d+))?(?:@(\d+))?", part)
        if not m:
            raise ValueError(f"bad spec {part!r}")
        out.append((m[1], int(m[2] or 1), int(m[3] or 1)))
    return out


def parse_options(text: str) -> tuple[str, list[str], dict[str, str]]:
    """'name:arg:…:k=v,k=v' → name, plain arguments and options."""
    name, *rest = text.strip().split(":")
    if not name:
        raise ValueError("a spec needs a name")
    args, opts = [], {}
    for piece in rest:
        if "=" in piece:
            opts |= dict(kv.split("=", 1) for kv in piece.split(","))
        else:
            args.append(piece)
    return name, args, opts


def split_message(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters, cut at line ends where possible; nothing is lost but the line ends cut at."""
    out = []
    while len(text) > limit:
        cut = text.rfind("\n", 0, limit + 1)
        cut, skip = (cut, 1) if cut > 0 else (limit, 0)
        out.append(text[:cut])
        text = text[cut + skip :]
    return [*out, text]


def plain(s: str) -> str:
    """Python twin of fold_accents, for driver-side code and tests."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))
