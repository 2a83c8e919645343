"""Joins with checked cardinality, NULL-aware aggregates, islands, block frames, top-n and set comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.engine.scale import one_row

# ------------------------------------------------------------------ joins


class CardinalityError(ValueError):
    """A join key repeats on a side that was declared unique."""


def assert_unique(df: DataFrame, keys: list[str], what: str) -> None:
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise CardinalityError(f"{what}: {keys} repeat")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", validate: str | None = None) -> DataFrame:
    """An equi-join whose declared cardinality ('1:1', '1:m', 'm:1') is verified before it is built.

    The check is an aggregation of the keys alone, partial before its shuffle. NULL keys never match.
    """
    if validate in ("1:1", "1:m"):
        assert_unique(left, keys, "left")
    if validate in ("1:1", "m:1"):
        assert_unique(right, keys, "right")
    return left.join(right, keys, how)


def outer_with_indicator(left: DataFrame, right: DataFrame, keys: list[str], indicator: str = "side") -> DataFrame:
    """Full outer join with a column that says where each row was found: both, left_only or right_only."""
    a = left.withColumn("__l", F.lit(True))
    b = right.withColumn("__r", F.lit(True))
    side = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left_only").otherwise("right_only")
    return a.join(b, keys, "full_outer").withColumn(indicator, side).drop("__l", "__r")


#: Values of a dense grid's axis that are held in one array.
AXIS = 50_000


def dense_grid(keys: DataFrame, axis: DataFrame, facts: DataFrame, on: list[str], fill: dict) -> DataFrame:
    """Every key with every value of an axis, facts attached and gaps filled.

    The axis is exploded from arrays of about ``AXIS`` values, joined by the array's number, instead of a cross join of two
    data sets; a short axis is one array. Repeated axis values count once.
    """
    names = axis.columns
    parts = max(1, -(-axis.distinct().count() // AXIS))
    number = F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int")
    packed = axis.distinct().groupBy(number.alias("__p")).agg(F.collect_list(F.struct(*names)).alias("__a"))
    grid = keys.withColumn("__p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(packed, "__p")
    grid = grid.select(*keys.columns, F.explode("__a").alias("__a")).select(*keys.columns, "__a.*")
    return grid.join(facts, on, "left").na.fill(fill)


# ------------------------------------------------------------------ aggregates


def strict_sum(c: str) -> Column:
    """NULL if any value is NULL (or there is no row)."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def sum_min_count(c: str, n: int = 1) -> Column:
    """NULL if fewer than ``n`` values are known."""
    return F.when(F.count(c) >= n, F.sum(c))


def rate_per(stat: str, exposure: str, unit: float) -> Column:
    """Σ stat / Σ exposure where the stat is known × unit; NULL without exposure."""
    known = F.sum(F.when(F.col(stat).isNotNull(), F.col(exposure)))
    return F.when(known > 0, F.sum(stat) / known * F.lit(unit))


def strict_product(c: Column) -> Column:
    """Product that a NULL or NaN makes NULL."""
    bad = F.max((c.isNull() | F.isnan(c.cast("double"))).cast("int"))
    return F.when(bad == 0, F.product(c))


def weighted_mean(x: str, w: str) -> Column:
    return F.when(F.sum(w) != 0, F.sum(F.col(x) * F.col(w)) / F.sum(w))


def shrunk_ratio(numerator: Column, denominator: Column, prior: float, weight: float) -> Column:
    return (numerator + F.lit(prior * weight)) / (denominator + F.lit(weight))


def band(c: Column, edges: list[float]) -> Column:
    """Index of the half-open band [edge, next); the last is closed, values outside go to the nearest."""
    last = len(edges) - 2
    out = F.when(c < edges[1], 0)
    for i in range(1, last):
        out = out.when(c < edges[i + 1], i)
    return F.when(c.isNotNull(), out.otherwise(last))


def mode_by(df: DataFrame, by: list[str], value: str, tie: list[Column]) -> DataFrame:
    """The most frequent value per group; ties by the given order."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), *tie)
    return n.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def unpivot_sides(df: DataFrame, shared: list[str], home: dict[str, str], away: dict[str, str], flag: str = "is_home") -> DataFrame:
    """One row per side: ``home`` and ``away`` map result columns to source columns."""
    side = lambda m, h: F.struct(*[F.col(c).alias(n) for n, c in m.items()], F.lit(h).alias(flag))
    return df.select(*shared, F.explode(F.array(side(home, True), side(away, False))).alias("s")).select(*shared, "s.*")


# ------------------------------------------------------------------ windows


def islands(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "island") -> DataFrame:
    """Number the runs of equal ``value`` (NULLs equal) within each group, from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    fresh = F.row_number().over(w) == 1
    change = (fresh | ~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    return df.withColumn("__c", change).withColumn(
        name, F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("__c")


def absence_runs(df: DataFrame, by: list[str], order: list[str], cond: Column, name: str) -> DataFrame:
    """For each row the length of the run of rows with ``cond`` that ends just before it."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = df.withColumn("__i", F.row_number().over(w)).withColumn("__stop", F.when(~F.coalesce(cond, F.lit(False)), F.col("__i")))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.max("__stop").over(before), F.lit(0))
    return x.withColumn(name, F.col("__i") - 1 - last).drop("__i", "__stop")


def block_frame(df: DataFrame, by: list[str], block: str, value: str, k: int) -> DataFrame:
    """Per (group, block) sums over the last ``k`` rows of *earlier* blocks: the rows of one block never
    see each other (a GROUPS frame, which Spark lacks).

    Rows are packed into their block, the blocks' newest ``k`` values travel along a window of
    at most ``k`` blocks, and one slice takes the newest ``k`` rows. Result: by, block, n, total.
    """
    order_in = F.struct(F.col("__o"), F.col(value))
    b = df.withColumn("__o", F.xxhash64(*df.columns)).groupBy(*by, block).agg(F.sort_array(F.collect_list(order_in)).alias("v"))
    b = b.withColumn("v", F.slice(F.reverse(F.transform("v", lambda x: x[value])), 1, k))
    w = Window.partitionBy(*by).orderBy(block).rowsBetween(-k, -1)
    b = b.withColumn("p", F.slice(F.flatten(F.reverse(F.collect_list("v").over(w))), 1, k))
    total = F.aggregate(F.filter("p", lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return b.select(*by, block, F.size("p").alias("n"), F.when(F.size("p") > 0, total).alias("total"))


def trailing_sum_time(at_us: str, value: str, by: list[str], width_us: int) -> Column:
    """Σ value over rows of the key in [t - width, t) on epoch microseconds."""
    return F.sum(value).over(Window.partitionBy(*by).orderBy(at_us).rangeBetween(-width_us, -1))


# ------------------------------------------------------------------ order, top-n, sets


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; ``order`` must end in a unique key. Spark limits groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def skyline(df: DataFrame, by: list[str], key: str, low: list[str], high: list[str], cell: str | None = None) -> DataFrame:
    """Rows of each group that no other row dominates (≤ in every ``low``, ≥ in every ``high``, better in one).

    Local skylines of hash parts first, then of their survivors: skyline(A ∪ B) = skyline of both
    skylines, so most rows never meet; the quadratic step only sees survivors of one group.
    Rows with a NULL criterion are never dominated and never dominate.
    """
    crit = [*low, *high]

    def undominated(x: DataFrame, part: list[str]) -> DataFrame:
        y = x.select(*[F.col(c).alias(f"__{c}") for c in dict.fromkeys([*part, key, *crit])])
        on = F.lit(True)
        for c in part:
            on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
        better = F.lit(False)
        for c in low:
            on = on & (F.col(f"__{c}") <= F.col(c))
            better = better | (F.col(f"__{c}") < F.col(c))
        for c in high:
            on = on & (F.col(f"__{c}") >= F.col(c))
            better = better | (F.col(f"__{c}") > F.col(c))
        return x.join(y, on & better, "left_anti")

    parts = df.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(64)))
    return undominated(undominated(parts, [*by, "__part"]).drop("__part"), by)


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], rtol: float = 1e-9) -> DataFrame:
    """Keyed differences of two tables: (keys, column, kind) with kind only_a, only_b or value.

    Floating columns compare with a relative tolerance, NULL and NaN equal themselves. One
    full outer join on the keys.
    """
    cols = [c for c in a.columns if c in b.columns and c not in keys]
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(True).alias("__a"))
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(True).alias("__b"))
    j = left.join(right, keys, "full_outer")
    kinds = []
    for c in cols:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        same = x.eqNullSafe(y)
        if a.schema[c].dataType.typeName() in ("double", "float"):
            close = F.abs(x - y) <= F.lit(rtol) * F.greatest(F.abs(x), F.abs(y))
            same = same | F.coalesce(close, F.lit(False))
        kinds.append(F.when(F.col("__a") & F.col("__b") & ~same, F.struct(F.lit(c).alias("column"), F.lit("value").alias("kind"))))
    alone = F.when(F.col("__b").isNull(), "only_a").when(F.col("__a").isNull(), "only_b")
    kinds.append(F.when(alone.isNotNull(), F.struct(F.lit("*").alias("column"), alone.alias("kind"))))
    return j.select(*keys, F.explode(F.array_compact(F.array(*kinds))).alias("d")).select(*keys, "d.column", "d.kind")


def resolve(df: DataFrame, mapping: DataFrame, keys: list[str], result: str) -> DataFrame:
    """Attach ``result`` of a mapping (keys, result); a key that the mapping lacks raises, named.

    The check is an anti-join of distinct keys; NULL keys stay unresolved.
    """
    known = mapping.select(*keys, result)
    assert_unique(known, keys, "mapping")
    wanted = df.select(*keys).distinct()
    for k in keys:
        wanted = wanted.filter(F.col(k).isNotNull())
    lost = wanted.join(known, keys, "left_anti").limit(10).collect()
    if lost:
        raise LookupError("unknown: " + ", ".join(str(tuple(r)) for r in lost))
    return df.join(known, keys, "left")


def pooled_rollup(df: DataFrame, label: str, pools: dict[str, Column], aggregates: list[Column]) -> DataFrame:
    """Aggregates per value of ``label`` and over each named pool, in one aggregation (rows are
    labelled with every pool they belong to)."""
    names = [F.col(label).cast("string"), *[F.when(c, F.lit(n)) for n, c in pools.items()]]
    x = df.withColumn("__label", F.explode(F.array_compact(F.array(*names))))
    return x.groupBy(F.col("__label").alias(label)).agg(*aggregates)


def contribution(df: DataFrame, by: list[str], diff: str) -> DataFrame:
    """Per cell: rows, mean difference and its part of the overall mean (parts add up to it)."""
    g = df.filter(F.col(diff).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.sum(diff).alias("s"))
    g = g.withColumn("__n", one_row(g.agg(F.sum("n").alias("n")))["n"])
    return g.select(*by, "n", (F.col("s") / F.col("n")).alias("mean"), (F.col("s") / F.col("__n")).alias("part"))


def ranked_takers(df: DataFrame, by: list[str], rank: str, q: str, present: str, name: str = "p") -> DataFrame:
    """P(this row acts) = q · present · Π over better ranks (1 − q · present), per group."""
    w = Window.partitionBy(*by).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    x = F.coalesce(F.col(q) * F.col(present), F.lit(0.0))
    return df.withColumn(name, x * F.coalesce(F.product(1 - x).over(w), F.lit(1.0)))
