"""Trees, chains, hash tables and layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.operators.positions import running_sum
from chronoline.session import counted, cut


def paths(nodes: DataFrame, node: str, parent: str, name: str) -> DataFrame:
    """(node, path, depth) of every node that leads to a root (a node whose parent is null or absent).
    Pointer doubling: each round joins every node's known ancestor to that ancestor's own, so a depth
    of n takes log2(n) joins. A first doubling of ids alone tells which nodes lead into a cycle, however
    long; these reach no root and are left out before any path is built. Repeated rows count once;
    null nodes are no nodes."""
    up = nodes.where(F.col(node).isNotNull()).select(F.col(node).alias("n"), F.col(parent).alias("p"), F.col(name).alias("s")).distinct()
    known = up.select(F.col("n").alias("k")).distinct()
    first, n = counted(up.join(known, up["p"] == known["k"], "left").select("n", F.col("k").alias("up"), "s"))
    ids = first.select("n", "up").where("up IS NOT NULL")
    rounds = n.bit_length() + 1  # no walk without a cycle is longer than there are nodes
    left = 1
    for _ in range(rounds):
        far = ids.select(F.col("n").alias("_n"), F.col("up").alias("_up"))
        ids, left = counted(ids.join(far, ids["up"] == far["_n"]).select("n", F.col("_up").alias("up")))
        if not left:
            break
    if left:  # who still has an ancestor after so many steps leads into a cycle
        first = first.join(ids.select("n").distinct(), "n", "left_anti")
    step = first.select("n", "up", F.array("s").alias("tail"))
    open_ = n
    while open_:
        far = step.select(F.col("n").alias("_n"), F.col("up").alias("_up"), F.col("tail").alias("_tail"))
        step = step.join(far, step["up"] == far["_n"], "left").select("n", F.when(F.col("_n").isNull(), None).otherwise(F.col("_up")).alias("up"), F.when(F.col("_n").isNull(), F.col("tail")).otherwise(F.concat("_tail", "tail")).alias("tail"))
        step, open_ = counted(step, F.col("up").isNotNull())
    return step.select(F.col("n").alias(node), F.concat(F.lit("/"), F.array_join("tail", "/")).alias("path"), F.size("tail").cast("long").alias("depth"))


def chains(blocks: DataFrame, block: str, following: str) -> DataFrame:
    """(head, block, step) of the chains of every head, a block that is no block's ``following``, until a
    pointer leads nowhere or back into the chain. Pointer doubling: each round takes what is walked so far
    a jump further and doubles the jumps, so chains of n steps take log2(n) joins. Null blocks are no
    blocks; a cycle that no head leads into lies in no chain."""
    known = blocks.select(F.col(block).alias("k")).where("k IS NOT NULL").distinct()
    jump = blocks.select(F.col(block).alias("n"), F.col(following).alias("k")).where("n IS NOT NULL").join(known, "k").select("n", F.col("k").alias("to")).distinct()
    jump = cut(jump)
    walked = known.join(jump.where("n != to"), known["k"] == jump["to"], "left_anti").select(F.col("k").alias("head"), F.col("k").alias("block"), F.lit(0).cast("long").alias("step"))
    (walked, size), n, far = counted(walked), -1, 1
    while size > n:
        n = size
        further = walked.join(jump, walked["block"] == jump["n"]).select("head", F.col("to").alias("block"), (F.col("step") + far).alias("step"))
        walked, size = counted(walked.union(further).groupBy("head", "block").agg(F.min("step").alias("step")))
        onward = jump.select(F.col("n").alias("_n"), F.col("to").alias("_to"))
        jump = cut(jump.join(onward, jump["to"] == onward["_n"]).select("n", F.col("_to").alias("to")))
        far *= 2
    return walked


def extents(files: DataFrame, order: list[str], size: str, block: int, per_range: int | None = None) -> DataFrame:
    """Files with blocks and start_block when laid out one after another in order: a running sum over the
    whole table, by ranges of about ``per_range`` rows if that is given. Nulls in the order come first; a null
    size takes no blocks."""
    n = F.coalesce(F.expr(f"({size} + {block - 1}) div {block}"), F.lit(0).cast("long"))
    return running_sum(files.withColumn("blocks", n), order, "blocks", "start_block", 1 + files.count() // per_range if per_range else None).withColumn("start_block", F.col("start_block").cast("long"))


def physical_block(logical, group: int = 170):
    """Logical to physical block where hash blocks stand before each group, group of groups, and on."""
    b = logical
    first = F.expr(f"({b} + {group}) div {group}")
    second = F.when(F.col(b) >= group, F.expr(f"({b} + {group * group}) div {group * group}")).otherwise(0)
    third = F.when(F.col(b) >= group * group, 1).otherwise(0)
    return F.col(b) + first + second + third


def path_hash(text):
    """h = upper(c) + 31 h over the characters, modulo 2**32."""
    chars = F.transform(F.split(F.upper(text), ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(4294967296)))


def hash_table(rows: DataFrame, key: str, order: str, slots: int) -> DataFrame:
    """(slot, winner) of an open table where the last writer wins; free slots hold -1."""
    last = rows.groupBy(F.pmod(F.col(key), F.lit(slots)).alias("slot")).agg(F.max(order).alias("winner"))
    return rows.sparkSession.range(slots).select(F.col("id").alias("slot")).join(last, "slot", "left").select("slot", F.coalesce("winner", F.lit(-1)).cast("long").alias("winner"))


def digest_tree(blocks: DataFrame, keys: list[str], index: str, digest: str, fan: int = 170) -> DataFrame:
    """(keys, node, digest): one level of a hash tree, the hash of up to ``fan`` digests in order."""
    g = blocks.groupBy(*keys, F.expr(f"{index} div {fan}").alias("node")).agg(F.sort_array(F.collect_list(F.struct(index, digest))).alias("d"))
    return g.select(*keys, "node", F.sha1(F.array_join(F.transform("d", lambda x: x[digest]), "").cast("binary")).alias("digest"))


def digest_nodes(texts: DataFrame, key: str, text: str, block: int = 4, fan: int = 170, levels: int = 2) -> DataFrame:
    """(key, node, digest): a level, 1 or 2, of the hash tree over blocks of ``block`` characters of each key's text. A node of
    the second level is ``block * fan * fan`` characters of one text, one of the first ``block * fan``, so it is worked out where the text is read and only digests leave
    the row. Keys that several rows share, by a count of the keys alone, have their blocks' digests merged by ``digest_tree``, of equal
    places in the order of the digests. A null text has one null digest."""
    rows = texts.select(key, F.col(text).alias("text"))
    shared = rows.groupBy(key).count().where("count > 1").select(F.col(key).alias("_k"))
    shared, several = counted(shared)
    whole = rows.join(shared, F.col(key).eqNullSafe(F.col("_k")), "left_anti") if several else rows

    def cut_up(c, size: int):  # the pieces of a text, at least one
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length(c) / size).cast("int")) - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))

    def digests(c):
        return F.sha1(F.array_join(c, "").cast("binary"))

    node = block * fan**levels
    parts = whole.select(key, "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length("text") / node).cast("int")) - 1)).alias("i"))
    parts = parts.select(key, F.col("i").cast("long").alias("node"), F.substring(F.col("text"), F.col("i") * node + 1, F.lit(node)).alias("part"))
    one = lambda c: digests(F.transform(cut_up(c, block), lambda b: F.sha1(b.cast("binary"))))
    top = one(F.col("part")) if levels == 1 else digests(F.transform(cut_up(F.col("part"), block * fan), one))
    out = parts.select(key, "node", F.when(F.col("part").isNotNull(), top).alias("digest"))
    if not several:
        return out
    d = rows.join(shared, F.col(key).eqNullSafe(F.col("_k")), "left_semi")
    d = d.select(key, "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length("text") / block).cast("int")) - 1)).alias("i"))
    d = d.select(key, F.col("i").cast("long").alias("i"), F.sha1(F.substring(F.col("text"), F.col("i") * block + 1, F.lit(block)).cast("binary")).alias("h")).where("h IS NOT NULL OR i = 0")
    empty = d.groupBy(key).agg(F.count("h").alias("_n")).where("_n = 0").select(F.col(key).alias("_k"))
    level = d.join(empty, F.col(key).eqNullSafe(F.col("_k")), "left_anti").select(key, F.col("i").alias("node"), F.col("h").alias("digest"))
    for _ in range(levels):
        level = digest_tree(level.withColumnsRenamed({"node": "i", "digest": "h"}), [key], "i", "h", fan)
    nulls = empty.select(F.col("_k").alias(key), F.lit(0).cast("long").alias("node"), F.lit(None).cast("string").alias("digest"))
    return out.unionByName(level).unionByName(nulls)
