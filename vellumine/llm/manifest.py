"""Merkle manifest of a dataset by nested-interval labels.

Rows are leaves, numbered inside their source along the id. A node is labelled with the
interval of leaf ranks that it covers, so a node of level k begins at a multiple of 16^k and
that multiple is its bucket. Ancestors are attached by containment joins between the buckets
of neighbouring levels, from the root down: the children of a node whose interval lies inside
the node's. The siblings of a child are its parent's interval less its own. Only the last
step touches leaves, so the paths of the upper levels move once for every 16 leaves.

The subroots are the leaves of a second tree over the sources, built by the same functions.
Every group of a shuffle holds at most 16 nodes; a source of any size is spread over ranges of
its ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.common import stored

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIBLINGS = "array<struct<before:string,after:string>>"


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with its rank and the number of rows (``rank``, ``n``) inside ``group``.

    Rows are dealt by ranges of (group, order), sorted and stored with their place. A group
    that fills many ranges gets its offsets from one row per (group, range). Rows equal in
    ``group`` and ``order`` are taken in the order in which they are read, which also lets the
    ranges split them.
    """
    keys = [group, *order, "_read"]
    dealt = df.withColumn("_read", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read")
    dealt = stored(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    group_key = F.struct(F.col(group).alias("g"))  # a struct equals another with null in the same place
    parts = dealt.groupBy(group_key.alias("_g"), "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_g", "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
                         F.sum("_n").over(Window.partitionBy("_g")).alias("n"))
    joined = dealt.withColumn("_g", group_key).join(parts, ["_g", "_part"])
    return joined.withColumn("rank", F.col("_at") + F.col("_shift")).drop("_g", "_part", "_at", "_shift")


def families(nodes: DataFrame, level: int, extra: list[str] = ()) -> DataFrame:
    """Nodes (grp, n, lo, hi, node) of ``level`` - 1 gathered under their parents.

    A row is a parent: grp, n, bucket, lo, hi, node and ``children``, at most 16 of them by
    interval. A group with a single leaf has a family of one and no hash above it.
    """
    child = F.struct("lo", "hi", "node", *extra)
    found = nodes.groupBy("grp", "n", F.floor(F.col("lo") / F.lit(FAN ** level)).alias("bucket")).agg(F.array_sort(F.collect_list(child)).alias("children"))
    both = F.array_join(F.col("children.node"), "")
    return found.select("grp", "n", "bucket", F.col("children")[0]["lo"].alias("lo"), F.array_max("children.hi").alias("hi"),
                        F.when(F.col("n") > 1, F.sha2(both, 256)).otherwise(F.col("children")[0]["node"]).alias("node"), "children")


def grow(leaves: DataFrame, extra: list[str] = ()) -> list[DataFrame]:
    """The stored families of all levels, the lowest first."""
    levels = [stored(families(leaves, 1, extra), "nodes")]
    largest = levels[0].agg(F.max("n")).first()[0] or 0
    while FAN ** len(levels) < largest:
        below = levels[-1].where(F.col("n") > FAN ** len(levels)).select("grp", "n", "lo", "hi", "node")
        levels.append(stored(families(below, len(levels) + 1), "nodes"))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(grp, node): the node that covers all of its group."""
    out = None
    for i, level in enumerate(levels):
        top = level.where((F.col("lo") == 0) & (F.col("hi") == F.col("n"))).select("grp", "node")
        out = top if out is None else out.unionByName(top)
    return out


def siblings() -> Column:
    """What the interval of ``children``'s parent holds besides ``child``'s, left and right of it."""
    def side(test):
        return F.array_join(F.transform(F.filter("children", test), lambda c: c["node"]), "")

    return F.struct(side(lambda c: c["hi"] <= F.col("child.lo")).alias("before"), side(lambda c: c["lo"] >= F.col("child.hi")).alias("after"))


def paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Every leaf (grp, child) with its siblings up to the root, and the columns of ``above``.

    ``above`` has a row per group: grp, ``path`` (siblings above the group's own root) and
    columns to carry.
    """
    carried = [c for c in above.columns if c not in ("grp", "path")]
    down = None
    for level in range(len(levels), 0, -1):
        family = levels[level - 1].select("grp", "n", "bucket", "lo", "hi", "children")
        root = (F.col("lo") == 0) & (F.col("hi") == F.col("n"))
        taken = ["node.*", "up.path", *[f"up.{c}" for c in carried]]
        same = F.col("node.grp").eqNullSafe(F.col("up.grp"))
        reached = family.where(root).alias("node").join(above.alias("up"), same).select(*taken)
        if down is not None:
            inside = (F.col("node.bucket") == F.col("up.at")) & (F.col("up.lo") <= F.col("node.lo")) & (F.col("node.hi") <= F.col("up.hi"))
            reached = reached.unionByName(family.where(~root).alias("node").join(down.alias("up"), same & inside).select(*taken))
        each = reached.withColumn("child", F.explode("children"))
        step = F.when(F.col("n") > 1, F.array(siblings())).otherwise(F.lit(None).cast(SIBLINGS))
        each = each.withColumn("path", F.concat(F.coalesce(step, F.array().cast(SIBLINGS)), "path"))
        if level == 1:
            return each.select("grp", "child", "path", *carried)
        at = F.floor(F.col("child.lo") / F.lit(FAN ** (level - 1)))
        down = each.select("grp", F.col("child.lo").alias("lo"), F.col("child.hi").alias("hi"), at.alias("at"), "path", *carried)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof(path: Column) -> Column:
    """The siblings of all levels, concatenated from the leaf's run to the root."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, leaf, subroot, root, path, arrived.

    ``path`` is the proof: for each level, from the leaf's run to the root, the siblings before
    and after the path. ``arrived`` is the leaf of the row as ``tampered`` (a text instead of
    the last field) has it, null where that is the same row. A null field is told from an empty one; rows without
    a source form a source of their own, which comes first; rows without an id come first in
    it. Rows that repeat an id are ordered by their leaf; equal rows are leaves each, with
    places in the order of reading. An empty table has no rows and no root. Other columns,
    whatever their names, are not read.
    """
    values = [F.col(f"`{f}`") for f in fields]
    leaf = digest(*[framed(v) for v in values])
    # stays null where nothing is tampered, so the row carries one digest
    other = F.when(~tampered.eqNullSafe(values[-1]), digest(*[framed(v) for v in values[:-1]], framed(tampered))) if tampered is not None else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("grp"), leaf.alias("node"), other.alias("arrived"))
    leaves = numbered(rows, "grp", ["doc_id", "node"]).select("grp", "n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "node", "doc_id", "arrived")
    levels = grow(leaves, ["doc_id", "arrived"])
    named = tops(levels).select(F.lit(0).alias("all"), F.col("grp").alias("name"), "node")
    subroots = numbered(named, "all", ["name"]).select(
        F.col("all").alias("grp"), "n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "node", "name")
    crown = grow(subroots, ["name"])
    top = tops(crown).select("grp", F.array().cast(SIBLINGS).alias("path"), F.col("node").alias("root"))
    above = paths(crown, top).select(F.col("child.name").alias("grp"), F.col("child.node").alias("subroot"), "root", "path")
    out = paths(levels, stored(above, "subroots"))
    return out.select(F.col("child.doc_id").alias("doc_id"), F.col("grp").alias("source"), F.col("child.node").alias("leaf"),
                      "subroot", "root", "path", F.col("child.arrived").alias("arrived"))


def verified(held: DataFrame) -> DataFrame:
    """Check every row of a manifest against the root: doc_id, leaf, subroot, root,
    proof_sha256, folded_root and verified (the arrived leaf folds up to the root)."""
    back = folded(F.coalesce("arrived", "leaf"), F.col("path"))
    out = held.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
