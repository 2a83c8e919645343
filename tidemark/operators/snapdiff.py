"""What changed between consecutive full snapshots, found through Merkle-tree digests.

Keys fall into hash buckets (the leaves of a tree of given fanout, as deep as the number of keys asks). The
leaves' digests are computed where the rows are read, by partial aggregation; parents' digests follow from their
children's; digests are compared top-down between consecutive snapshots, and only rows of leaves whose digests differ
are read again and compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.engine.scale import BROADCAST_ROWS, broadcast_if_small
from tidemark.engine.session import ensure_checkpoint_dir

#: Keys a leaf should hold about; more make digests fewer and rows read again more.
LEAF_KEYS = 4


def _digest(nodes: DataFrame, by: list[str], h: Column) -> DataFrame:
    """An order-free digest ``dg`` of the hashes ``h`` of each group: of their sum and number. Unlike a xor it keeps rows that come
    twice. It is NULL, which differs from everything, where a hash is or where a hot key's repeats overflow the sum."""
    got = nodes.withColumn("__h", h).groupBy(*by).agg(F.try_sum(F.shiftright("__h", 12)).alias("s"), F.count(F.lit(1)).alias("n"), F.count("__h").alias("m"))
    return got.select(*by, F.when(F.col("s").isNotNull() & (F.col("n") == F.col("m")), F.xxhash64("s", "n")).alias("dg"))


def _differing(nodes: DataFrame, group: list[str], seqs: DataFrame) -> DataFrame:
    """(group, seq, node) of each pair (seq - 1, seq) whose digests differ or of which one is missing: one shuffle by node."""
    w = Window.partitionBy(*group, "node").orderBy("seq")
    x = nodes.select(*group, "seq", "node", "dg", F.lag("seq").over(w).alias("p"), F.lag("dg").over(w).alias("pd"), F.lead("seq").over(w).alias("nx"))
    x = x.join(seqs.select(*group, "seq", "last"), [*group, "seq"])
    same = (F.col("p") == F.col("seq") - 1) & (F.col("dg") == F.col("pd"))
    changed = F.when((F.col("seq") > 0) & ~F.coalesce(same, F.lit(False)), F.col("seq"))
    gone = F.when((F.col("seq") < F.col("last")) & ~F.coalesce(F.col("nx") == F.col("seq") + 1, F.lit(False)), F.col("seq") + 1)
    return x.select(*group, "node", F.explode(F.array_compact(F.array(changed, gone))).alias("seq")).select(*group, "seq", "node")


def merkle_diff(
    rows: DataFrame,
    snapshots: DataFrame,
    group: list[str],
    snapshot: str,
    order: str,
    key: str,
    value: str,
    fanout: int = 16,
    depth: int | None = None,
) -> DataFrame:
    """Keys added, removed or changed between consecutive snapshots of a group.

    ``rows`` (group, snapshot, key, value) are the snapshots' contents; ``snapshots`` (group,
    snapshot, order) lists the snapshots to compare in their order (ties by snapshot). The
    result has group, snapshot (the later one), key, change, old_value and new_value. A group's
    first snapshot reports nothing; a listed snapshot without rows is an empty list. Rows with a
    NULL key are ignored; a NULL value is a value. Of repeated keys in one snapshot the greatest
    value counts.

    Digests are of the rows as delivered, so equal digests mean equal contents, and a leaf in which only repeats
    differ is merely compared in vain. The tree has ``fanout ** depth`` leaves of about LEAF_KEYS keys by
    default (the largest snapshot is counted first). Leaves' digests are aggregated before they are shuffled, a
    hot group is spread over its leaves. The leaves' digests, which serve both comparisons of a snapshot,
    and the differing leaves are checkpointed; rows are read twice and never written.
    """
    w = Window.partitionBy(*group).orderBy(order, snapshot)
    seqs = snapshots.select(*group, snapshot, order).withColumn("seq", F.row_number().over(w).cast("int") - 1)
    seqs = seqs.withColumn("last", F.count("*").over(Window.partitionBy(*group)).cast("int") - 1)
    seqs = broadcast_if_small(seqs.select(*group, snapshot, "seq", "last"))  # one row per snapshot
    rows = rows.filter(F.col(key).isNotNull()).select(*group, snapshot, F.col(key).alias("k"), F.col(value).alias("v"))
    if depth is None:
        most = rows.groupBy(*group, snapshot).count().agg(F.max("count").alias("n")).first().n or 1
        depth = 1
        while fanout**depth * LEAF_KEYS < most:
            depth += 1
    leaf = F.pmod(F.xxhash64("k"), F.lit(fanout**depth)).cast("int" if fanout**depth < 2**31 else "long")
    held = rows.withColumn("node", leaf).join(seqs, [*group, snapshot])
    ensure_checkpoint_dir(rows.sparkSession)
    level = _digest(held, [*group, "seq", "node"], F.xxhash64("k", F.col("v").isNull(), "v")).checkpoint()
    levels = [level]
    for _ in range(depth - 1):  # bottom-up: parents' digests from their children's
        child = F.when(F.col("dg").isNotNull(), F.xxhash64("child", "dg"))
        level = _digest(level.withColumnRenamed("node", "child").withColumn("node", F.floor(F.col("child") / fanout)), [*group, "seq", "node"], child)
        levels.append(level)
    differing = _differing(levels[-1], group, seqs)
    for nodes in reversed(levels[:-1]):  # top-down: only children of differing nodes are compared
        parents = differing.withColumnRenamed("node", "parent").checkpoint()
        wanted = parents.select(*group, "parent", F.explode(F.array("seq", F.col("seq") - 1)).alias("seq")).distinct()
        below = nodes.withColumn("parent", F.floor(F.col("node") / fanout)).join(wanted, [*group, "seq", "parent"], "left_semi")
        below = _differing(below, group, seqs).withColumn("parent", F.floor(F.col("node") / fanout))
        differing = below.join(parents, [*group, "seq", "parent"], "left_semi").select(*group, "seq", "node")
    # which of its two comparisons a leaf of a snapshot takes part in
    parts = F.array(F.struct("seq", F.lit(True).alias("as_new")), F.struct((F.col("seq") - 1).alias("seq"), F.lit(False).alias("as_new")))
    leaves = differing.select(*group, "node", F.explode(parts).alias("p")).select(*group, "node", "p.*")
    leaves = leaves.groupBy(*group, "seq", "node").agg(F.max("as_new").alias("as_new"), (~F.min("as_new")).alias("as_old")).checkpoint()
    again = held.join(broadcast_if_small(leaves, 2 * BROADCAST_ROWS), [*group, "seq", "node"])
    sides = F.array_compact(
        F.array(F.when(F.col("as_new"), F.struct("seq", F.lit(True).alias("now"))), F.when(F.col("as_old"), F.struct((F.col("seq") + 1).alias("seq"), F.lit(False).alias("now"))))
    )
    again = again.select(*group, "k", "v", F.explode(sides).alias("p")).select(*group, "k", "v", "p.*")
    new, old = F.col("now"), ~F.col("now")
    both = again.groupBy(*group, "seq", "k").agg(
        F.max(new).alias("now"), F.max(old).alias("was"), F.max(F.when(new, F.col("v"))).alias("new_value"), F.max(F.when(old, F.col("v"))).alias("old_value")
    )
    change = (
        F.when(F.col("now") & ~F.col("was"), "added")
        .when(F.col("was") & ~F.col("now"), "removed")
        .when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    )
    return (
        both.withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .join(seqs, [*group, "seq"])
        .select(*group, snapshot, F.col("k").alias(key), "change", "old_value", "new_value")
    )


def complete_deliveries(manifest: DataFrame) -> DataFrame:
    """Manifest rows whose ``expected`` and ``written`` hold the same files in any order and whose
    ``failed`` is empty. A NULL list makes a delivery incomplete."""
    same = (F.size(F.array_except("expected", "written")) == 0) & (F.size(F.array_except("written", "expected")) == 0)
    return manifest.filter(F.coalesce(same & (F.size("failed") == 0) & F.col("failed").isNotNull(), F.lit(False)))
