"""Operator 11: Merkle manifest of a dataset, by lag/lead windows.

Every row is a leaf; per group (source) the leaves, in order of their id,
form a tree in which ``arity`` consecutive nodes become one parent, and the
groups' roots form a tree of the same kind above. The manifest holds for each
row its leaf hash, its path (the siblings of its ancestors, left and right of
them, level by level) and both roots, so any row can be verified alone.

All levels of a block of ``arity ** tier`` leaves are built over the same
sorted rows: at level k a node is carried by the row of its first leaf, so
its siblings stand at the fixed offsets ``j * arity ** k``, where lag and lead
fetch them. They are masked by the node's slot among its siblings and by the
length of their run; the first child's row hashes the parent and carries it
on. The path of every other row is the last one carried before it, level by
level. Blocks are window partitions of a fixed size, so no task holds a
group; their roots are the leaves of the next tier, which has
``arity ** tier`` times fewer rows.

Leaves are numbered by ranges (``plans.numbering``), so one group may hold
any share of all rows.

Hashes are lower-case hexadecimal SHA-256; a parent hashes its children's
hexadecimal text, one after the other; a run of one is hashed too. A leaf
hashes its columns one after the other, each ``-`` if null, else the number
of its UTF-8 bytes, ``:``, and the value as text.

Edge cases: a null id comes before all others, equal ids are ordered by leaf
hash, and rows equal in both are interchangeable; a null group is a group of
its own, before all others (which are in bytewise order); empty texts are
values like others; a group of one row has its leaf as root; one group alone
has its root as the dataset's; an empty table gives no rows; columns that are
not named play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from ..plans.stored import stored

PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts' text, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_hash(*values: Column) -> Column:
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return digest(*map(part, values))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` has under ``path``."""
    return F.aggregate(path, leaf, lambda node, level: digest(level["left"], node, level["right"]))


def siblings_hash(path: Column) -> Column:
    """Hash of all siblings on the path, in order."""
    return digest(F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), ""))


def _climbed(nodes: DataFrame, arity: int, tier: int) -> DataFrame:
    """``nodes`` (grp, pos from 0, n: nodes of the group, node) with
    ``block``, ``top`` (on the block's first row: the node ``tier`` levels up)
    and s0 .. (on the row that carries a node: its siblings at that level,
    null where the group has no more than one node)."""
    block = Window.partitionBy("grp", "block").orderBy("pos")
    pos, n = F.col("pos"), F.col("n")
    rows = nodes.withColumn("block", F.floor(pos / arity ** tier)).withColumn("node0", F.col("node"))
    for level in range(tier):
        step, here = arity ** level, F.col(f"node{level}")
        number = F.floor(pos / step)
        slot = number % arity
        run = F.least(F.lit(arity), F.ceil(n / step) - (number - slot))
        carries, several = pos % step == 0, n > step
        left = F.concat_ws("", *[F.when(slot >= j, F.lag(here, j * step).over(block)) for j in range(arity - 1, 0, -1)])
        right = F.concat_ws("", *[F.when(slot + j < run, F.lead(here, j * step).over(block)) for j in range(1, arity)])
        rows = rows.withColumn(f"s{level}", F.when(carries & several, F.struct(left.alias("left"), right.alias("right"))))
        parent = F.when(several, digest(here, F.col(f"s{level}.right"))).otherwise(here)
        rows = rows.withColumn(f"node{level + 1}", F.when(pos % (step * arity) == 0, parent))
    return rows.withColumnRenamed(f"node{tier}", "top").drop(*[f"node{k}" for k in range(tier)])


def _tree(nodes: DataFrame, arity: int, tier: int) -> tuple[DataFrame, DataFrame]:
    """The climbed ``nodes``, and for each of their blocks (grp, block) the
    path ``above`` it and the group's ``root``."""
    climbed = stored(_climbed(nodes, arity, tier))
    tops = climbed.where(F.col("pos") % arity ** tier == 0) \
        .select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / arity ** tier).alias("n"), F.col("top").alias("node"))
    tops = stored(tops)
    if tops.where("n > 1").isEmpty():
        return climbed, tops.select("grp", F.col("pos").alias("block"), F.array().cast(PATH).alias("above"), F.col("node").alias("root"))
    rows = _with_paths(*_tree(tops, arity, tier), tier)
    return climbed, stored(rows.select("grp", F.col("pos").alias("block"), F.col("path").alias("above"), "root"))


def _with_paths(climbed: DataFrame, above: DataFrame, tier: int) -> DataFrame:
    """The nodes with their whole ``path``, and the columns of ``above``
    (grp, block, above, ...)."""
    so_far = Window.partitionBy("grp", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    levels = F.array_compact(F.array(*[F.last(f"s{k}", ignorenulls=True).over(so_far) for k in range(tier)]))
    mine = climbed.withColumn("mine", levels.cast(PATH)).drop("top", *[f"s{k}" for k in range(tier)])
    return mine.join(above, ["grp", "block"]).withColumn("path", F.concat("mine", "above")).drop("mine", "above")


def merkle_manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
                    id_col: str = "doc_id", group_col: str = "source", carry: dict[str, Column] | None = None,
                    arity: int = 3, tier: int = 7) -> DataFrame:
    """One row per input row: id, group, leaf, subroot, root, path, and the
    columns ``carry`` (computed from the input row)."""
    carry = carry or {}
    # A group's key is never null and sorts as the group does: null first.
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaves = stored(docs.select(F.col(id_col).alias("id"), key.alias("grp"), leaf_hash(*[F.col(c) for c in columns]).alias("node"),
                                F.monotonically_increasing_id().alias("copy"), F.struct(F.lit(0).alias("none"), *[c.alias(n) for n, c in carry.items()]).alias("carry")))
    nodes = numbered(leaves, ["grp"], ["id", "node", "copy"], seq="pos", total="n").withColumn("pos", F.col("pos") - 1).drop("copy")
    climbed, above = _tree(nodes, arity, tier)
    # Of each group its first block knows the root; the groups are the leaves of the tree above.
    subroots = above.where("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("member"), F.col("root").alias("node"))
    groups = numbered(subroots, ["grp"], ["member"], seq="pos", total="n").withColumn("pos", F.col("pos") - 1)
    groups = _with_paths(*_tree(groups, arity, tier), tier) \
        .select(F.col("member").alias("grp"), F.col("node").alias("subroot"), F.col("path").alias("to_root"), F.col("root").alias("whole"))
    above = above.join(groups, "grp").withColumn("above", F.concat("above", "to_root"))
    group = F.when(F.col("grp") != "", F.expr("substring(grp, 2)"))
    return _with_paths(climbed, above, tier).select(
        F.col("id").alias(id_col), group.alias(group_col), F.col("node").alias("leaf"), "subroot", F.col("whole").alias("root"), "path",
        *[F.col("carry")[name].alias(name) for name in carry])
