"""Dense positions without a window over all rows, and what they are for: zipping by position, lists of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoline.session import counted, cut


def with_position(rows: DataFrame, order: list[str], keys: list[str] = (), name: str = "position") -> DataFrame:
    """``rows`` with their place from 0 in the order of ``keys`` and ``order``, within their keys if there are any. Rows are
    range-partitioned and sorted, counted by partition, and shifted by the counts before: only a row a
    partition, and with keys a row a key, meet again. Of rows that are equal in all that the order has, any may come first."""
    by = [*keys, *order]
    dealt = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()))
    part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dealt.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))  # a row a partition, broadcast below
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_p", before.alias("_before"))
    out = dealt.withColumn("_p", part).join(F.broadcast(counts), "_p").withColumn(name, F.col("_before") + at)
    if keys:
        first = out.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min(name).alias("_first"))
        same = [out[k].eqNullSafe(first[f"_k{i}"]) for i, k in enumerate(keys)]
        on = same[0]
        for s in same[1:]:
            on = on & s
        out = out.join(first, on).withColumn(name, F.col(name) - F.col("_first"))
    return out.select(*rows.columns, name)


def running_sum(rows: DataFrame, order: list[str], value: str, name: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before, in ``order``, nulls first: within ranges of the rows, as many as Spark
    has shuffle partitions if ``ranges`` doesn't say, and over the ranges' totals. Null values add nothing."""
    dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    dealt = cut(dealt.sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_p", F.shiftright("_m", 33))
    totals = dealt.groupBy("_p").agg(F.sum(value).alias("_t"))  # a row a partition, broadcast below
    totals = totals.select("_p", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(totals), "_p").withColumn(name, F.col("_before") + inner).select(*rows.columns, name)


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], keys: list[str] = (), how: str = "inner") -> DataFrame:
    """Rows of both sides with equal positions, within ``keys``, as (keys, position, the others' columns). Of unequal lengths
    ``inner`` ends with the shorter, and ``full`` goes on with nulls. Columns of both sides other than keys must differ in name;
    null keys are a key of their own."""
    l, r = with_position(left, left_order, keys), with_position(right, right_order, keys)
    on = [*keys, "position"]
    named = r.select(*(F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in r.columns))
    match = l["position"] == named["_r_position"]
    for k in keys:
        match = match & l[k].eqNullSafe(named[f"_r_{k}"])
    j = l.join(named, match, how)
    of = lambda c: F.when(j["position"].isNull(), named[f"_r_{c}"]).otherwise(l[c]).alias(c)
    return j.select(*(of(k) for k in keys), F.coalesce(l["position"], named["_r_position"]).alias("position"), *(c for c in left.columns if c not in keys), *(c for c in right.columns if c not in keys))


def _jumped(step: DataFrame, value: str) -> DataFrame:
    """One round of pointer doubling: rows (n, far, ...) with ``value`` of their ``far`` added to their own, and ``far``'s own far.
    Only rows that still point somewhere are joined."""
    to = step.select(F.col("n").alias("_n"), F.col("far").alias("_far"), F.col(value).alias("_value"))
    open_ = step.where("far IS NOT NULL").join(to, F.col("far") == F.col("_n")).withColumns({"far": F.col("_far"), value: F.col(value) + F.col("_value")})
    return step.where("far IS NULL").unionByName(open_.select(*step.columns))


def _measured(nodes: DataFrame, node: str, parent: str, named: dict[str, str]) -> DataFrame:
    """(n, up, the columns of ``named`` under their new names, size, depth) of every node that leads to a root; ``size`` is the number of
    nodes of its subtree. After k rounds a node knows its descendants less than 2**k below it and its ancestor 2**k above, so what its
    descendants exactly 2**k below know is what the next round adds: log2(depth) rounds in all."""
    up = nodes.where(F.col(node).isNotNull()).select(F.col(node).alias("n"), F.col(parent).alias("up"), *(F.col(c).alias(o) for o, c in named.items()))
    first = Window.partitionBy("n").orderBy(*named, "up")
    up = up.withColumn("_i", F.row_number().over(first)).where("_i = 1").drop("_i")
    known = up.select(F.col("n").alias("k"))
    one = F.lit(1).cast("bigint")
    step = up.join(known, up["up"] == known["k"], "left").select("n", F.col("k").alias("up"), *named, F.col("k").alias("far"), one.alias("size"), one.alias("depth"))
    (step, left), before = counted(step, F.col("far").isNotNull()), None
    while left and left != before:  # a round that ends no walk: all that are left lead into cycles
        before = left
        gains = step.where("far IS NOT NULL").groupBy(F.col("far").alias("_g")).agg(F.sum("size").alias("_gain"))
        grown = _jumped(step, "depth").join(gains, F.col("n") == F.col("_g"), "left")
        step, left = counted(grown.withColumn("size", F.col("size") + F.coalesce("_gain", F.lit(0))).select(*step.columns), F.col("far").isNotNull())
    return step.where("far IS NULL").drop("far")


def tour(nodes: DataFrame, node: str, parent: str, order: list[str]) -> DataFrame:
    """(node, enter, leave, depth) of every node that leads to a root: a walk around the tree, siblings by ``order``. A node's
    subtree is what enters between its enter and leave, so it is found by a range, and lookups need no recursion. A node
    is entered a step after its parent and after the walks around its older siblings, twice their subtrees' sizes, so its place is
    a sum along the way up: a tree takes log2(depth) rounds for sizes and as many for places, not a round a step.

    A root is a node whose parent is null or absent; nodes that lead into a cycle reach no root and are left out; of
    repeated nodes the first by ``order`` counts; null nodes are no nodes; roots are siblings."""
    named = {f"_o{i}": c for i, c in enumerate(order)}
    older = Window.partitionBy("up").orderBy(*named, "n").rowsBetween(Window.unboundedPreceding, -1)
    known = _measured(nodes, node, parent, named)
    known = known.select("n", "up", "size", "depth", (F.coalesce(2 * F.sum("size").over(older), F.lit(0)) + F.when(F.col("up").isNull(), 0).otherwise(1)).alias("w"))
    enter = F.col("total")
    return above(known, "n", "up", "w", ["size", "depth"]).select(F.col("n").alias(node), enter.alias("enter"), (enter + 2 * F.col("size") - 1).alias("leave"), "depth")


def above(nodes: DataFrame, node: str, parent: str, weight: str, keep: list[str] = ()) -> DataFrame:
    """(node, the columns of ``keep``, total): the sum of ``weight`` over a node and all its ancestors, in log2(depth) rounds. Nodes must be a forest."""
    step, open_ = counted(nodes.select(F.col(node).alias("n"), F.col(parent).alias("far"), *keep, F.col(weight).cast("bigint").alias("total")), F.col("far").isNotNull())
    while open_:
        step, open_ = counted(_jumped(step, "total"), F.col("far").isNotNull())
    return step.select(F.col("n").alias(node), *keep, "total")


def listing(nodes: DataFrame, node: str, parent: str, order: list[str]) -> DataFrame:
    """(node, place, depth): the recursive listing in which the nodes of a directory come before what is in them, and then
    each one's own listing follows. A node's place is its number among its siblings, plus what its ancestors' listings
    put before: their directories' sizes and their older siblings' descendants, summed along the way up."""
    named = {f"_o{i}": c for i, c in enumerate(order)}
    siblings = Window.partitionBy("up").orderBy(*named, "n")
    known = _measured(nodes, node, parent, named)
    older = F.coalesce(F.sum(F.col("size") - 1).over(siblings.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = known.select("n", "up", "depth", (F.row_number().over(siblings) - 1).alias("nth"), (F.count(F.lit(1)).over(Window.partitionBy("up")) + older).alias("w"))
    place = F.col("nth") + F.col("total") - F.col("w")
    return above(known, "n", "up", "w", ["depth", "nth", "w"]).select(F.col("n").alias(node), place.cast("bigint").alias("place"), "depth")
