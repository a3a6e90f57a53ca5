"""Merkle manifest of a dataset by butterfly exchange: a leaf per row, a tree per group, a proof for every leaf.

A leaf is H of a row's fields, H the lowercase hex SHA-256 of its inputs put together. The leaves of a group ascend by
id; every ``fanout`` neighbours become their H until one node is left, the group's root. The roots of the groups, in
order, are the leaves of one more tree.

A tree is cut into blocks of ``fanout ** BLOCK_LEVELS`` neighbouring leaves, each folded within a row. Above, blocks
meet in a butterfly: in round r, blocks whose numbers differ in digit r only, to the base of the fanout, swap the roots of
the subtrees that they stand for, and each of them hashes the common ancestor for itself. After the last round every
block knows the root and all upper siblings of its leaves, so nothing has to travel down again. Where a tree's last
subtree is not full, some of its blocks have no partner of their own number; they get the root of the last subtree, of
which there is one per tree and round. Only block roots are swapped, one row for 1,024 leaves, and the rounds grow with
the logarithm of the leaves; every round is saved.

Ranks come from one range sort that is saved with each row's number in its partition: partition sizes, a few numbers,
give the rest. Ties are told apart by the leaf and by the row's number in the first reading, so that a range cuts equal
rows too.

Defined cases: a null field is ``-``, another is its length in UTF-8 bytes, a colon and the value; a null id comes
first; rows with equal ids stand in the order of their leaves, equal rows are leaves of their own; a null group comes
first and is a group of its own; a lone leaf is its tree's root; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodespark.llm.common import saved
from lodespark.session import bounded_broadcast

FANOUT = 2
#: Levels that are folded within a row; a block has ``FANOUT ** BLOCK_LEVELS`` leaves.
BLOCK_LEVELS = 10
#: Rows of a range when leaves are ranked.
RANGE_ROWS = 200_000
#: Siblings on one level, put together: what stands left of the node, and right of it.
STEPS = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*fields: Column) -> Column:
    return digest(*[encoded(f) for f in fields])


def tampered(doc_id: Column, one_in: int = 7) -> Column:
    """A fixed choice of rows by their id; never one without id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % one_in == 0, F.lit(False))


def ranked(rows: DataFrame, tree: str, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``place``, counted from 0 inside each tree, and ``leaves``, the size of the tree; saved.

    Trees and ``order`` ascend, nulls first. ``rows`` should be a saved table, so that ``order`` can name any column.
    """
    parts = max(1, -(-rows.count() // range_rows))
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    at = F.monotonically_increasing_id()
    sorted_rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    sorted_rows = saved(sorted_rows.withColumn("__part", F.shiftright(at, 33)).withColumn("__at", at.bitwiseAND(F.lit((1 << 33) - 1))), "merkle-ranks")
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    starts = sorted_rows.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    numbered = sorted_rows.join(bounded_broadcast(starts), "__part").withColumn("__at", F.col("__start") + F.col("__at"))
    trees = numbered.groupBy(F.col(tree).alias("__tree")).agg(F.min("__at").alias("__first"), F.count("*").alias("leaves"))
    return numbered.join(bounded_broadcast(trees), F.col(tree).eqNullSafe(F.col("__tree"))).select(
        *[F.col(f"`{c}`") for c in rows.columns], (F.col("__at") - F.col("__first")).alias("place"), "leaves"
    )


def _runs(nodes: Column, fanout: int) -> Column:
    """The next level: H of every ``fanout`` nodes of an array, the last run may be shorter."""
    starts = F.sequence(F.lit(0), F.size(nodes) - 1, F.lit(fanout))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(nodes, i + 1, F.lit(fanout)), ""), 256))


def _siblings(nodes: Column, at: Column, fanout: int) -> Column:
    """What stands left and right of node ``at`` in its run."""
    start = F.floor(at / fanout).cast("int") * fanout
    return F.struct(
        F.array_join(F.slice(nodes, start + 1, at - start), "").alias("before"),
        F.array_join(F.slice(nodes, at + 2, F.lit(fanout) - 1 - (at - start)), "").alias("after"),
    )


def blocks(leaves: DataFrame, fanout: int = FANOUT, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(tree, block, blocks, rows, levels, node): each block's rows in order, its levels from the leaves up, its root.

    A tree of one block ends at its root; else every block goes up all ``levels``, a short last one too.
    """
    width = fanout**levels
    by_block = (
        leaves.withColumn("block", F.floor(F.col("place") / width))
        .groupBy("tree", "block")
        .agg(F.max("leaves").alias("leaves"), F.sort_array(F.collect_list(F.struct("place", "row", "leaf"))).alias("rows"))
        .withColumn("blocks", F.ceil(F.col("leaves") / width))
    )

    def fold(found: Column, _: Column) -> Column:
        top = F.element_at(found, -1)
        up = (F.col("blocks") > 1) | (F.size(top) > 1)
        return F.when(up, F.concat(found, F.array(_runs(top, fanout)))).otherwise(found)

    start = F.array(F.col("rows.leaf")).cast("array<array<string>>")
    folded_up = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, fold)
    return by_block.withColumn("levels", folded_up).select(
        "tree", "block", "blocks", "rows",
        F.slice("levels", 1, F.size("levels") - 1).alias("levels"),
        F.element_at(F.element_at("levels", -1), 1).alias("node"),
    )


def butterfly(roots: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, block, root, steps) from the roots (tree, block, blocks, node) of the blocks of any number of trees."""
    state = roots.select("tree", "block", "blocks", "node", F.array().cast(STEPS).alias("steps"))
    most = roots.agg(F.max("blocks")).first()[0] or 0
    span = 1
    while span < most:
        state = saved(_round(state, span, fanout), "merkle-round")
        span *= fanout
    return state.select("tree", "block", F.col("node").alias("root"), "steps")


def _round(state: DataFrame, span: int, fanout: int) -> DataFrame:
    """Swap between the blocks whose numbers differ in one digit; ``span`` is the worth of that digit."""
    done = state.filter(F.col("blocks") <= span)
    open_ = state.filter(F.col("blocks") > span)
    digit = F.floor(F.col("block") / span) % fanout
    other = F.col("block") + (F.col("other") - digit) * span
    asked = open_.select("tree", "block", "blocks", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("other"), digit.alias("digit"), other.alias("partner")).filter("other <> digit")
    given = open_.select(F.col("tree").alias("__tree"), F.col("block").alias("partner"), F.col("node").alias("sibling"))
    exact = asked.filter("partner < blocks").join(
        given, F.col("tree").eqNullSafe(F.col("__tree")) & (asked.partner == given.partner)
    )
    # The last subtree of a tree may lack the partner: its root is the node of the tree's last block.
    last = open_.filter("block = blocks - 1").select(F.col("tree").alias("__tree"), F.col("node").alias("sibling"))
    begins = F.floor(F.col("partner") / span) * span
    ragged = asked.filter((F.col("partner") >= F.col("blocks")) & (begins < F.col("blocks"))).join(
        bounded_broadcast(last), F.col("tree").eqNullSafe(F.col("__tree"))
    )
    columns = ["tree", "block", "other", "digit", "sibling"]

    def joined(side: Column) -> Column:
        found = F.sort_array(F.collect_list(F.when(side, F.struct("other", "sibling"))))
        return F.array_join(found.getField("sibling"), "")

    found = (
        exact.select(*columns)
        .union(ragged.select(*columns))
        .groupBy(F.col("tree").alias("__tree"), F.col("block").alias("__block"))
        .agg(joined(F.col("other") < F.col("digit")).alias("before"), joined(F.col("other") > F.col("digit")).alias("after"))
    )
    both = F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("block") == F.col("__block"))
    before, after = (F.coalesce(c, F.lit("")) for c in ("before", "after"))
    met = open_.join(found, both, "left").select(
        "tree",
        "block",
        "blocks",
        digest(before, F.col("node"), after).alias("node"),
        F.concat("steps", F.array(F.struct(before.alias("before"), after.alias("after")))).alias("steps"),
    )
    return met.union(done.select(*met.columns))


def manifest(leaves: DataFrame, fanout: int = FANOUT, levels: int = BLOCK_LEVELS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(tree, row, leaf, subroot, root, steps) of every leaf (tree, id, leaf, row).

    ``row`` is carried along, any type that sorts. ``steps`` are the siblings on the way up, through the subroot to the root.
    """
    told_apart = saved(leaves.withColumn("__read", F.monotonically_increasing_id()), "merkle-leaves")
    placed = ranked(told_apart, "tree", ["id", "leaf", "__read"], range_rows)
    cut = saved(blocks(placed, fanout, levels), "merkle-blocks")
    lower = saved(butterfly(cut, fanout), "merkle-trees")
    subroots = lower.filter("block = 0").select(F.col("tree").alias("group"), F.col("root").alias("leaf"))
    subroots = saved(subroots.withColumn("tree", F.lit(0)), "merkle-subroots")
    tops = ranked(subroots, "tree", ["group"], range_rows).withColumn("row", F.col("group"))
    top_cut = saved(blocks(tops, fanout, levels), "merkle-top")
    top = _leaves(top_cut, butterfly(top_cut, fanout), fanout).select(
        F.col("row").alias("group"), F.col("root").alias("top"), F.col("steps").alias("upper")
    )
    return (
        _leaves(cut, lower, fanout)
        .join(bounded_broadcast(top), F.col("tree").eqNullSafe(F.col("group")))
        .select("tree", "row", "leaf", F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("steps", "upper").alias("steps"))
    )


def _leaves(cut: DataFrame, trees: DataFrame, fanout: int) -> DataFrame:
    """(tree, row, leaf, root, steps) of every leaf of the blocks, with the steps inside the block in front."""
    upper = trees.select(F.col("tree").alias("__tree"), F.col("block").alias("__block"), "root", "steps")
    both = F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("block") == F.col("__block"))

    def proven(one: Column, at: Column) -> Column:
        def step(level: Column, i: Column) -> Column:
            return _siblings(level, F.floor(at / F.pow(F.lit(float(fanout)), i)).cast("int"), fanout)

        return F.struct(one.row.alias("row"), one.leaf.alias("leaf"), F.transform("levels", step).alias("steps"))

    each = cut.join(upper, both).select("tree", "root", "steps", F.explode(F.transform("rows", proven)).alias("one"))
    return each.select("tree", "one.row", "one.leaf", "root", F.concat("one.steps", "steps").alias("steps"))


def proof_hash(steps: Column) -> Column:
    """H of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s.before, s.after)), ""), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of a proof lead to."""
    return F.aggregate(steps, leaf, lambda node, s: digest(s.before, node, s.after))
