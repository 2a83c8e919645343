"""As-of joins as one union, one shuffle and one sort (never a nested loop)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_at: str,
    right_at: str,
    by: list[str],
    columns: list[str],
    direction: str = "backward",
    strict: bool = False,
    tolerance: Column | None = None,
    tie: list[str] | None = None,
    suffix: str = "",
) -> DataFrame:
    """Each left row with ``columns`` of the nearest right row of the same ``by`` key.

    ``direction`` 'backward' takes the latest right row at or before the left time, 'forward' the
    earliest at or after; ``strict`` excludes equal times. ``tolerance`` (same type as the
    difference of the times; the times must then be numeric) drops matches farther away. Of right
    rows at the same time the greatest by ``tie`` (default: ``columns``) counts. Every left row
    comes out once (a left join); left rows with a NULL key or time and rows without a match get
    NULLs. Repeated left rows are kept. Columns of the result are the left's and
    ``columns`` + ``suffix``, which replace left columns of the same name; other right columns
    don't matter, whatever their names.

    Skew: rows of one key are sorted in one task (with spilling); for keys that may hold a
    third of the data put a time bucket into ``by``, as event_attributes does.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    back = direction == "backward"
    tie = tie or columns
    payload = F.struct(F.col(right_at).alias("__rt"), *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(columns)])
    keys = [f"__k{i}" for i in range(len(by))]
    # at equal times the side order decides whether a match counts
    lo = 0 if (strict == back) else 1
    lside = left.select(
        *[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)],
        F.col(left_at).alias("__t"),
        F.lit(lo).alias("__side"),
        F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__left"),
    )
    valid = [F.col(f"`{b}`").isNotNull() for b in by] + [F.col(right_at).isNotNull()]
    cond = valid[0]
    for v in valid[1:]:
        cond = cond & v
    rank = F.struct(*[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(tie)])
    rside = right.filter(cond).select(
        *[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)],
        F.col(right_at).alias("__t"),
        F.lit(1 - lo).alias("__side"),
        payload.alias("__pay"),
        rank.alias("__rank"),
    )
    both = lside.unionByName(rside, allowMissingColumns=True)
    if back:
        w = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__t"), "__side", F.asc_nulls_first("__rank"))
        hit = F.last("__pay", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    else:
        w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("__t"), "__side", F.desc_nulls_last("__rank"))
        hit = F.first("__pay", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumn("__hit", hit).filter(F.col("__left").isNotNull())
    ok = F.col("__t").isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    if tolerance is not None:
        gap = F.col("__t") - F.col("__hit.__rt") if back else F.col("__hit.__rt") - F.col("__t")
        ok = ok & (gap <= tolerance)
    return out.select(
        *[F.col(f"__left.`{c}`").alias(c) for c in left.columns if c not in {f"{x}{suffix}" for x in columns}],
        *[F.when(ok, F.col(f"__hit.__c{i}")).alias(f"{c}{suffix}") for i, c in enumerate(columns)],
    )


def range_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_at: str,
    right_at: str,
    before: int,
    after: int,
    columns: list[str],
    suffix: str = "_r",
) -> DataFrame:
    """Inner band join: right rows of the same key with right_at in [left_at - before, left_at + after] (numbers).

    The time axis is cut into buckets as wide as the band; each left row goes to the two or three buckets
    that its band touches, so the join is an equi-join on key and bucket and a hot key is
    spread over its buckets. NULL keys or times match nothing.
    """
    width = max(1, before + after)
    bucket = lambda c: F.floor(c / F.lit(width))
    lw = left.withColumn("__b", F.explode(F.sequence(bucket(F.col(left_at) - before), bucket(F.col(left_at) + after))))
    r = right.select(
        *[F.col(f"`{b}`").alias(f"__k{i}") for i, b in enumerate(by)],
        F.col(right_at).alias("__rt"),
        *[F.col(f"`{c}`").alias(f"{c}{suffix}") for c in columns],
    ).withColumn("__rb", bucket(F.col("__rt")))
    on = F.col("__b") == F.col("__rb")
    for i, b in enumerate(by):
        on = on & (lw[b] == F.col(f"__k{i}"))
    gap = F.col("__rt") - F.col(left_at)
    return lw.join(r, on & (gap >= -before) & (gap <= after)).select(
        *[lw[c] for c in left.columns], *[F.col(f"{c}{suffix}") for c in columns]
    )


def running_count_before(df: DataFrame, by: list[str], order: str) -> Column:
    """Rows of the same key with a strictly smaller integer ``order``: a composite-key as-of count."""
    w = Window.partitionBy(*by).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    return F.count("*").over(w)
