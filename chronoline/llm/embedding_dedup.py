"""Embedding near-duplicates by a forest of random-projection trees.

Vectors of one label and length go down ``trees`` trees. A node projects on a random direction
and splits at the median of the fitted sample's vectors there; a vector within ``spill`` standard
deviations of a projection (1 / sqrt(dim)) of the split goes both ways. Two unit vectors of
cosine 0.98 differ by 0.2 / sqrt(dim) there on average, so a few trees with a narrow spill find
nearly all links, and copies per vector grow slowly (at spill 0.08 by about 6 % a level).

Vectors that share a leaf are compared in double precision; pairs at or above the threshold are
links, whichever tree found them. Leaves are compared in blocks of ``BLOCK`` vectors, each pair
of blocks a group of its own, so a leaf that holds a third of all vectors is spread over tasks.
Links aren't listed: a block pair returns each vector's number of links, counting a pair only in
the first leaf that both have, and a star over each of its connected parts. So the rows
returned grow with the vectors, not with the square of a group of near ones.

Equal vectors of a label become one class before anything else, by an aggregation that
combines before its shuffle; a class of any size costs one vector, and its members' links
count through its size. Classes are told apart by 64 bits of hash: of 10**9 different vectors
two share one with odds of about 3 %, of 10**10 about 2.7 pairs are expected to.

The split points are fitted on at most ``fit`` classes (those of least hash); every vector is
indexed. The depth follows the largest label, for leaves of about ``leaf`` classes; nodes that
the sample doesn't reach split at the whole sample's median.

Defined results: a null label, a null or empty or zero vector, and one with null or non-finite
components link with nothing; labels of any type are equal as Spark compares them (1.0 and 1.5 differ, -0.0 is
0.0, NaN is NaN); entries of any magnitude are scaled before they are multiplied; a repeated vec_id keeps a row each; a null vec_id links but is never a component's name; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import components, cut, sized
from chronoline.llm.textcols import GOLD, mix

BLOCK, POOL = 512, 256


def _pool(dim: int) -> np.ndarray:
    p = np.random.default_rng(dim).standard_normal((dim, POOL))
    return p / np.linalg.norm(p, axis=0)


def _direction(tree: int, path: np.ndarray) -> np.ndarray:
    """Which direction of the pool a node uses; path has a leading 1 bit."""
    return (mix(path.astype(np.uint64) * GOLD + np.uint64(tree + 1)) % np.uint64(POOL)).astype(np.int64)


def fit_splits(sample: np.ndarray, trees: int, depth: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each tree the split of every node that the sample reaches, by path; the rest use the whole sample's median."""
    p = sample @ _pool(sample.shape[1])
    middle = np.median(p, axis=0) if len(p) else np.zeros(POOL)
    out = {}
    for t in range(trees):
        paths, splits, where = [], [], np.ones(len(p), np.int64)
        for _ in range(depth):
            d = _direction(t, where)
            value = p[np.arange(len(p)), d]
            order = np.lexsort((value, where))
            node, first, count = np.unique(where[order], return_index=True, return_counts=True)
            ok = count >= 8
            at = value[order][first + count // 2]
            paths.append(node[ok])
            splits.append(at[ok])
            cutoff = np.where(ok, at, middle[_direction(t, node)])[np.searchsorted(node, where)]
            where = where * 2 + (value > cutoff)
        paths, splits = np.concatenate(paths or [np.zeros(0, np.int64)]), np.concatenate(splits or [np.zeros(0)])
        order = np.argsort(paths)
        out[t] = (paths[order], splits[order])
    return out


def leaves(x: np.ndarray, splits: dict, middle: np.ndarray, depth: int, spill: float):
    """(row, tree, leaf) of unit vectors, with the spilled copies."""
    p = x @ _pool(x.shape[1])
    rows, trees, paths = [], [], []
    for t, (known, at) in splits.items():
        row, path = np.arange(len(x)), np.ones(len(x), np.int64)
        for _ in range(depth):
            d = _direction(t, path)
            cutoff = middle[d]
            if len(known):
                k = np.minimum(np.searchsorted(known, path), len(known) - 1)
                cutoff = np.where(known[k] == path, at[k], cutoff)
            gap = p[row, d] - cutoff
            right, left = gap > -spill, gap <= spill
            row = np.concatenate([row[left], row[right]])
            path = np.concatenate([path[left] * 2, path[right] * 2 + 1])
        rows.append(row)
        trees.append(np.full(len(row), t))
        paths.append(path)
    return np.concatenate(rows), np.concatenate(trees), np.concatenate(paths)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _stars(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) of the connected parts of two blocks, given by the ids of their rows."""
    low_l, low_r, big = left.copy(), right.copy(), np.iinfo(np.int64).max
    while True:
        before = low_l.copy(), low_r.copy()
        low_l = np.minimum(low_l, np.where(near, low_r[None, :], big).min(1, initial=big))
        low_r = np.minimum(low_r, np.where(near, low_l[:, None], big).min(0, initial=big))
        if (low_l == before[0]).all() and (low_r == before[1]).all():
            ids, low = np.concatenate([left, right]), np.concatenate([low_l, low_r])
            return ids[ids != low], low[ids != low]


def _met_before(own: list[np.ndarray], left: np.ndarray, right: np.ndarray, tree: int, leaf: int) -> np.ndarray:
    """Which pairs of rows share a leaf that comes before this one; own: each row's (tree, leaf), sorted."""
    met = np.zeros(len(left), bool)
    keys = [o[(o[:, 0] < tree) | ((o[:, 0] == tree) & (o[:, 1] < leaf))] for o in own]
    width = max(map(len, keys), default=0)
    if width and len(left):
        code = np.full((len(own), width), -1, np.int64)  # a leaf's path is below 2**56, a tree's number below 128
        for i, k in enumerate(keys):
            code[i, : len(k)] = k[:, 0] << 56 | k[:, 1]
        other = code[right]
        for c in range(width):
            mine = code[left, c]
            met |= (mine >= 0) & (other == mine[:, None]).any(1)
    return met


def link_classes(classes: DataFrame, threshold: float = 0.98, trees: int = 4, leaf: int = 128, spill: float = 0.08, fit: int = 16_384) -> DataFrame:
    """Of classes (cid, label, vector: array<double>, m: members): rows (a, null, others), parts of the number
    of vectors in other classes that a's link to, and (a, b, null), stars of what is connected."""
    shape = classes.groupBy("label", F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
    most = shape.agg(F.max("n")).first()[0] or 0
    if most < 2:
        return classes.sparkSession.createDataFrame([], "a bigint, b bigint, others bigint")
    depth = max(0, math.ceil(math.log2(most / leaf)))
    trees = trees if depth else 1  # trees of a single leaf are all alike
    sample = classes.orderBy(F.xxhash64("cid"), "cid").limit(fit).select("vector").toArrow()["vector"]
    sizes = pc.list_value_length(sample).to_numpy()
    fitted = {}
    for dim in np.unique(sizes):
        x = _unit(pc.list_flatten(sample.filter(pa.array(sizes == dim))).to_numpy().reshape(-1, dim))
        fitted[int(dim)] = (fit_splits(x, trees, depth), np.median(x @ _pool(int(dim)), axis=0))
    del sample
    sent = classes.sparkSession.sparkContext.broadcast(fitted)  # at most trees * fit / 4 splits

    def assign(batches):
        kind = pa.struct([("tree", pa.int32()), ("leaf", pa.int64())])
        for b in batches:
            lists = b.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            begin = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                pick = np.flatnonzero(sizes == dim)
                splits, middle = sent.value.get(int(dim)) or ({t: (np.zeros(0, np.int64), np.zeros(0)) for t in range(trees)}, np.zeros(POOL))
                for i in range(0, len(pick), 2048):
                    mine = pick[i : i + 2048]
                    row, tree, path = leaves(_unit(flat[begin[mine][:, None] + np.arange(dim)]), splits, middle, depth, spill / math.sqrt(dim))
                    order = np.lexsort((path, tree, row))
                    own = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(len(mine) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(tree[order], pa.int32()), pa.array(path[order])], fields=list(kind)))
                    at = pa.array(mine)
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(4)), own], ["cid", "label", "vector", "m", "own"])

    placed = cut(classes.select("cid", "label", "vector", "m").mapInArrow(assign, f"cid bigint, label {dict(classes.dtypes)['label']}, vector array<double>, m bigint, own array<struct<tree:int,leaf:bigint>>"))
    where = ["label", "dim", "tree", "leaf"]
    rows = placed.select("cid", "label", F.size("vector").alias("dim"), F.explode("own").alias("o")).select("cid", "label", "dim", "o.*")
    counts = rows.groupBy(*where).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.join(counts, where).withColumn("block", F.pmod(F.hash("cid"), F.col("blocks")))
    grid = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    rows = rows.withColumn("g", F.explode(grid)).select("cid", *where, "block", F.col("g.i").alias("i"), F.col("g.j").alias("j"))
    rows = rows.join(placed.select("cid", "vector", "m", "own"), "cid")

    def compare(t: pa.Table) -> pa.Table:
        cid, block, m = (t.column(c).to_numpy() for c in ("cid", "block", "m"))
        i, j, tree, leaf = (t.column(c)[0].as_py() for c in ("i", "j", "tree", "leaf"))
        x = pc.list_flatten(t.column("vector")).to_numpy().reshape(len(cid), -1)
        # by a power of two, which is exact, so that no product passes the range of a double
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
        size = np.linalg.norm(x, axis=1)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = (x[left] @ x[right].T) / (size[left][:, None] * size[right][None, :]) >= threshold
        if i == j:
            np.fill_diagonal(near, False)
            a, b = np.nonzero(np.triu(near))
        else:
            a, b = np.nonzero(near)
        a, b = left[a], right[b]
        own = t.column("own").combine_chunks()
        flat = np.stack([own.flatten().field(k).to_numpy().astype(np.int64) for k in range(2)], 1)
        at = own.offsets.to_numpy() - own.offsets[0].as_py()
        linked = np.unique(np.concatenate([a, b]))
        back = np.searchsorted(linked, np.arange(len(cid)))
        fresh = ~_met_before([flat[at[k] : at[k + 1]] for k in linked], back[a], back[b], tree, leaf)
        a, b = a[fresh], b[fresh]
        n = np.bincount(a, m[b], len(cid)) + np.bincount(b, m[a], len(cid))
        some = np.flatnonzero(n)
        u, v = _stars(near, cid[left], cid[right])
        return pa.table([np.concatenate([cid[some], u]), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(v)]), pa.concat_arrays([pa.array(n[some].astype(np.int64)), pa.nulls(len(u), pa.int64())])], ["a", "b", "others"])

    return rows.groupBy(*where, "i", "j").applyInArrow(compare, "a bigint, b bigint, others bigint")


def _name(vectors: DataFrame, label: str) -> Column:
    """A string for each different label."""
    kind, c = dict(vectors.dtypes)[label], F.col(f"`{label}`")
    if kind in ("float", "double"):
        c = c + F.lit(0.0).cast(kind)
    return F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}) if kind.startswith(("array", "struct", "map")) else c.cast("string")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, trees: int = 4, leaf: int = 128, spill: float = 0.08, fit: int = 16_384, vec: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vector."""
    rows = vectors.select(F.col(f"`{vec}`").cast("bigint").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"), _name(vectors, label).alias("label"))
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("cid", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("label", F.transform("embedding", lambda x: x + F.lit(0.0)))))
    classes = rows.where("cid IS NOT NULL").groupBy("cid").agg(F.first("label").alias("label"), F.first("embedding").alias("vector"), F.count("*").alias("m"), F.min("vec_id").alias("rep"))
    classes = cut(classes)
    found = sized(link_classes(classes, threshold, trees, leaf, spill, fit))[0]
    other = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("others").alias("others"))
    joined = components(found.where("b IS NOT NULL")).toDF("cid", "comp")
    named = classes.select("cid", "m", "rep").join(joined, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "comp").join(other, "cid", "left").select("cid", "component_id", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    few = named.count() <= 20_000  # a class with a third of all rows then needs no shuffle of them
    out = rows.select("vec_id", "cid").join(F.broadcast(named) if few else named, "cid", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


#: The same by comparing all pairs.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
k AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM k a JOIN k b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u),
r(d, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.d, l.v FROM r JOIN l ON r.c = l.u),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept FROM v JOIN m ON m.d = v.vec_id LEFT JOIN n ON n.u = v.vec_id
"""


def query(spark, sf_dir):
    from chronoline.llm.common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))
