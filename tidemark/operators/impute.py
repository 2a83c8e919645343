"""Filling missing measurements from similar records, with provenance.

Method: functional dependencies (determinant columns → field) are mined and verified on
complete records; missing cells are left-joined to the dictionaries of the verified
determinants, best one first, and fall back to group averages. Every filled cell says
which level filled it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.engine.scale import one_row

NONE = -1.0  # stands for an unused or missing determinant; determinants are non-negative


@dataclass(frozen=True)
class Level:
    """One way to fill a field: ``keys`` (expressions of up to three long or double columns) determine the value."""

    name: str
    field: str
    keys: tuple[str, ...]
    #: 'fd': used only if mined and verified; 'group': a fallback average per unit of ``weight``
    kind: str = "fd"
    weight: str | None = None
    #: two values agree if they differ by less than about this (a metric functional dependency)
    tolerance: float = 0.006


def _key_struct(keys: tuple[str, ...]) -> list[Column]:
    cols = []
    for i in range(3):
        if i < len(keys):
            k = F.expr(keys[i]).cast("double")
            cols.append(F.when(k.isNull() | F.isnan(k), F.lit(None)).otherwise(k).alias(f"k{i + 1}"))
        else:
            cols.append(F.lit(NONE).alias(f"k{i + 1}"))
    return cols


def _long(rows: DataFrame, levels: list[tuple[int, Level]], base: list[Column], value: bool) -> DataFrame:
    """Each row once per level whose determinants it has: base, level, field, k1..k3, w, and with ``value`` v and its bin."""
    parts = []
    for n, lv in levels:
        w = F.expr(lv.weight).cast("double") if lv.weight else F.lit(1.0)
        v = F.col(f"`{lv.field}`").cast("double")
        extra = [v.alias("v"), F.floor(v / F.lit(lv.tolerance)).alias("bin")] if value else [F.lit(lv.field).alias("field")]
        parts.append(F.struct(F.lit(n).alias("level"), *_key_struct(lv.keys), w.alias("w"), *extra))
    x = rows.select(*base, F.explode(F.array(*parts)).alias("p")).select(*base, "p.*")
    known = "k1 is not null and k2 is not null and k3 is not null and w > 0"
    return x.filter(known + (" and v is not null" if value else ""))


def _group_dictionaries(rows: DataFrame, levels: list[tuple[int, Level]]) -> DataFrame | None:
    """Averages per unit of weight of all fallback levels: one aggregation per set of keys, for all its fields."""
    by_keys: dict[tuple, list[tuple[int, Level]]] = {}
    for n, lv in levels:
        by_keys.setdefault((lv.keys, lv.weight), []).append((n, lv))
    out = None
    for (keys, weight), group in by_keys.items():
        w = F.expr(weight).cast("double") if weight else F.lit(1.0)
        x = rows.select(*_key_struct(keys), w.alias("w"), *[F.col(f"`{lv.field}`").cast("double").alias(f"v{n}") for n, lv in group])
        g = x.filter("k1 is not null and k2 is not null and k3 is not null and w > 0").groupBy("k1", "k2", "k3").agg(
            *[
                F.struct(
                    F.lit(n).alias("level"), F.count(f"v{n}").alias("n"),
                    (F.sum(f"v{n}") / F.sum(F.when(F.col(f"v{n}").isNotNull(), F.col("w")))).alias("value"),
                ).alias(f"s{n}")
                for n, _ in group
            ]
        )
        g = g.select("k1", "k2", "k3", F.explode(F.array(*[f"s{n}" for n, _ in group])).alias("s")).filter("s.n > 0")
        g = g.select("s.level", "k1", "k2", "k3", "s.n", F.col("s.n").alias("agree"), "s.value")
        out = g if out is None else out.unionByName(g)
    return out


def mine_dictionaries(rows: DataFrame, levels: list[Level]) -> DataFrame:
    """(level, k1..k3) → value, n, agree for every level, from cells that hold a value.

    Values of a determinant are counted in bins of the level's tolerance; the fullest two
    adjoining bins are what the key determines: ``agree`` counts the records in them, ``value`` is their
    mean. Group levels give value per unit of weight and ``agree = n``. Partial aggregation
    shrinks hot determinants and groups before the shuffle.
    """
    numbered = list(enumerate(levels))
    group = _group_dictionaries(rows, [(n, lv) for n, lv in numbered if lv.kind == "group"])
    fds = [(n, lv) for n, lv in numbered if lv.kind == "fd"]
    if not fds:
        return group
    bins = _long(rows, fds, [], True).groupBy("level", "k1", "k2", "k3", "bin").agg(
        F.count("*").alias("bn"), F.sum("v").alias("bv"), F.sum("w").alias("bw")
    )
    w = Window.partitionBy("level", "k1", "k2", "k3").orderBy("bin")
    near = F.lead("bin").over(w) == F.col("bin") + 1
    both = lambda c: F.col(c) + F.when(near, F.lead(c).over(w)).otherwise(0)
    bins = bins.select("level", "k1", "k2", "k3", "bn", both("bn").alias("pn"), both("bv").alias("pv"), both("bw").alias("pw"))
    fd = bins.groupBy("level", "k1", "k2", "k3").agg(
        F.sum("bn").alias("n"), F.max("pn").alias("agree"), F.max_by(F.col("pv") / F.col("pw"), "pn").alias("value")
    )
    return fd if group is None else fd.unionByName(group)


def verify(dictionaries: DataFrame, levels: list[Level], min_support: int, max_error: float) -> list[tuple[int, float, int]]:
    """Levels of kind 'fd' that hold: (level, error, support). ``support`` counts complete records
    whose determinant repeats; ``error`` is the share of them that must go for the rest to agree."""
    stats = (
        dictionaries.filter("n >= 2")
        .groupBy("level")
        .agg(F.sum("n").alias("support"), F.sum(F.col("n") - F.col("agree")).alias("bad"))
        .collect()  # one row per candidate dependency
    )
    ok = [
        (r.level, r.bad / r.support, r.support)
        for r in stats
        if levels[r.level].kind == "fd" and r.support >= min_support and r.bad / r.support <= max_error
    ]
    return sorted(ok, key=lambda t: (levels[t[0]].tolerance, t[1], -t[2], t[0]))


def fill_missing(
    rows: DataFrame,
    keys: list[str],
    fields: list[str],
    levels: list[Level],
    min_support: int = 20,
    max_error: float = 0.05,
    entry_agreement: float = 0.8,
    needs: str = "true",
    bounds: tuple[float, float] | None = None,
) -> DataFrame:
    """Fill NULL ``fields`` of ``rows`` (one row per ``keys``) where ``needs`` holds.

    Returns one row per missing cell: keys, field, value, filled_by (name of the level) and
    support (records behind the value). Levels are tried in the order: verified dependencies by
    tolerance and error (entries whose records agree to ``entry_agreement``), then fallbacks as given, then the field's overall average per unit of the last
    fallback's weight ('overall'). A cell for which no record has a value at all comes out with a NULL value
    and filled_by 'none'. Only missing cells travel to the join; measured cells are never touched.
    Values are clipped to ``bounds``. Hot determinants or groups are pre-aggregated before the
    shuffle, and the join's skewed partitions are split by adaptive execution.
    """
    d = mine_dictionaries(rows, levels).persist(StorageLevel.MEMORY_AND_DISK)
    good = verify(d, levels, min_support, max_error)
    order = [n for n, _, _ in good] + [n for n, lv in enumerate(levels) if lv.kind == "group"]
    rank = {n: i for i, n in enumerate(order)}
    last_weight = {lv.field: lv.weight for lv in levels if lv.kind == "group"}
    mean_of = lambda f: F.sum(F.col(f)) / F.sum(F.when(F.col(f).isNotNull(), F.expr(last_weight.get(f) or "1.0").cast("double")))
    overall = one_row(rows.agg(F.array(*[mean_of(f) for f in fields]).alias("m"), F.array(*[F.count(f) for f in fields]).alias("n")))
    cells = rows.filter(needs).filter(" or ".join(f"`{f}` is null" for f in fields))
    cells = cells.select(
        "*",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("__field"),
                        F.col(f"`{f}`").isNull().alias("__gap"),
                        F.expr(last_weight.get(f) or "1.0").cast("double").alias("__w"),
                        F.lit(i).alias("__i"),
                    )
                    for i, f in enumerate(fields)
                ]
            )
        ).alias("__c"),
    ).filter("__c.__gap").select(*rows.columns, "__c.__field", "__c.__w", "__c.__i")
    base = [F.col(f"`{k}`") for k in keys] + [F.col("__field")]
    used = [(rank[n], levels[n]) for n in order] or [(-1, levels[0])]  # no level holds: none is tried
    tries = _long(cells, used, base, False).filter("field = __field").withColumnRenamed("level", "rank")
    remap = F.create_map(*[F.lit(x) for n, i in rank.items() for x in (n, i)]) if rank else F.create_map().cast("map<int,int>")
    book = d.filter(F.col("level").isin(order) if order else F.lit(False)).withColumn("rank", F.try_element_at(remap, F.col("level")))
    is_fd = F.col("rank") < len(good)
    book = book.filter(~is_fd | (F.col("agree") >= F.col("n") * entry_agreement)).select("rank", "k1", "k2", "k3", "value", "n")
    hit = tries.join(book, ["rank", "k1", "k2", "k3"])
    best = hit.groupBy(*[f"`{k}`" for k in keys], "__field").agg(
        F.min(F.struct("rank", (F.col("value") * F.col("w")).alias("value"), "n")).alias("__best")
    )
    all_cells = cells.select(*base, "__w", "__i")
    on = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys] + [F.col("a.__field") == F.col("b.__field")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = all_cells.alias("a").join(best.alias("b"), cond, "left")
    mean = F.get(overall["m"], F.col("a.__i"))
    count = F.get(overall["n"], F.col("a.__i"))
    names = F.array(*[F.lit(levels[n].name) for n in order]) if order else F.array().cast("array<string>")
    value = F.coalesce(F.col("b.__best.value"), mean * F.col("a.__w"))
    if bounds:
        value = F.when(value.isNotNull(), F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), value)))
    return joined.select(
        *[F.col(f"a.`{k}`").alias(k) for k in keys],
        F.col("a.__field").alias("field"),
        value.alias("value"),
        F.when(F.col("b.__best").isNotNull(), F.get(names, F.col("b.__best.rank")))
        .when(mean.isNotNull(), "overall")
        .otherwise("none")
        .alias("filled_by"),
        F.coalesce(F.col("b.__best.n"), count).alias("support"),
    )
