"""Queries over the other shared tables: frames, statistics, trees, text, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoline.functions import scalar
from chronoline.operators import diff, sequence, stats, tree
from chronoline.plans.base import EVENTS, events, query, read

FRAMES = "f AS (SELECT vec_id, CAST(unnest(range(1, len(embedding) + 1)) AS BIGINT) - 1 AS bin, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def frames(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("bin", "v"))
    return e.select("vec_id", F.col("bin").cast("long").alias("bin"), F.col("v").cast("double").alias("v"))


@query("local_peaks", f"WITH {FRAMES}, p AS (SELECT *, v > lag(v) OVER w AND v > lead(v) OVER w AS peak FROM f WINDOW w AS (PARTITION BY vec_id ORDER BY bin)) SELECT vec_id, bin, v FROM p WHERE peak")
def local_peaks(spark, sf_dir):
    return sequence.peaks(frames(spark, sf_dir), ["vec_id"], ["bin"], "v")


@query(
    "inferred_onsets",
    f"""
WITH {FRAMES}, p AS (SELECT *, lag(v, 1) OVER w AS a, lag(v, 2) OVER w AS b FROM f WINDOW w AS (PARTITION BY vec_id ORDER BY bin)),
r AS (SELECT vec_id, bin, CASE WHEN b IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(v - a, v - b)) END AS rise FROM p)
SELECT vec_id, bin, round(rise, 9) AS rise, round(CASE WHEN m > 0 THEN rise / m ELSE 0 END, 9) AS scaled FROM r JOIN (SELECT max(rise) AS m FROM r) ON true""",
)
def inferred_onsets(spark, sf_dir):
    """Rises over one and two frames, also relative to the largest of all (one broadcast row)."""
    r = sequence.rising(frames(spark, sf_dir), ["vec_id"], ["bin"], "v")
    top = r.agg(F.max("rise").alias("m"))
    out = r.join(F.broadcast(top))
    return out.select("vec_id", "bin", F.round("rise", 9).alias("rise"), F.round(F.when(F.col("m") > 0, F.col("rise") / F.col("m")).otherwise(F.lit(0.0)), 9).alias("scaled"))


@query(
    "frequency_mask",
    f"WITH {FRAMES} SELECT vec_id, bin, CASE WHEN bin BETWEEN 8 AND 40 THEN v ELSE 0.0::DOUBLE END AS v FROM f",
)
def frequency_mask(spark, sf_dir):
    return frames(spark, sf_dir).withColumn("v", F.when(F.col("bin").between(8, 40), F.col("v")).otherwise(F.lit(0.0)))


@query(
    "hop_frames",
    f"""
WITH {FRAMES}, s AS (SELECT vec_id, bin, v, unnest(range(greatest(0, (bin - 16 + 12) // 12), bin // 12 + 1)) AS win FROM f)
SELECT vec_id, CAST(win AS BIGINT) AS win, count(*) AS n, round(sum(v), 6) AS total FROM s WHERE bin - win * 12 < 16 GROUP BY ALL""",
)
def hop_frames(spark, sf_dir):
    """Overlapping windows of 16 frames every 12: each frame goes to the windows that cover it."""
    f = frames(spark, sf_dir).withColumn("win", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("bin") - 4) / 12)), F.floor(F.col("bin") / 12))))
    f = f.where(F.col("bin") - F.col("win") * 12 < 16)
    return f.groupBy("vec_id", F.col("win").cast("long").alias("win")).agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("total"))


@query(
    "frame_runs",
    f"""
WITH {FRAMES}, g AS (SELECT *, bin - row_number() OVER (PARTITION BY vec_id ORDER BY bin) AS run FROM f WHERE v > 0)
SELECT vec_id, min(bin) AS first_bin, max(bin) AS last_bin, count(*) AS n, round(avg(v), 9) AS mean FROM g GROUP BY vec_id, run HAVING count(*) >= 2""",
)
def frame_runs(spark, sf_dir):
    """Runs of at least two voiced frames with their mean activation."""
    f = frames(spark, sf_dir).where("v > 0")
    f = f.withColumn("run", F.col("bin") - F.row_number().over(Window.partitionBy("vec_id").orderBy("bin")))
    g = f.groupBy("vec_id", "run").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.count("*").alias("n"), F.round(F.avg("v"), 9).alias("mean"))
    return g.where("n >= 2").drop("run")


def _profiles():
    rows = [f"({t}, {m}, {k}, {p[(k - t) % 12]}::DOUBLE)" for t in range(12) for m, p in enumerate((stats.MAJOR, stats.MINOR)) for k in range(12)]
    return ", ".join(rows)


@query(
    "key_detect",
    f"""
WITH {EVENTS}, p(tonic, tonality, pc, w) AS (VALUES {_profiles()}),
h AS (SELECT user_id, k % 12 AS pc, sum(CASE WHEN value <= 0 THEN 1.0::DOUBLE ELSE value END) AS h FROM e WHERE k >= 0 GROUP BY ALL),
s AS (SELECT user_id, tonic, tonality, sum(h * w) / sqrt((SELECT sum(x.h * x.h) FROM h x WHERE x.user_id = h.user_id) * (SELECT sum(q.w * q.w) FROM p q WHERE q.tonic = p.tonic AND q.tonality = p.tonality)) AS score FROM h JOIN p USING (pc) GROUP BY user_id, tonic, tonality),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, tonic, tonality) AS i FROM s)
SELECT user_id, tonic, tonality, round(score, 6) AS score FROM r WHERE i = 1""",
)
def key_detect(spark, sf_dir):
    return stats.detect_keys(events(spark, sf_dir), ["user_id"], "k", "value").withColumn("score", F.round("score", 6))


BANDS = [(1.5, 5), (0.8, 4), (0.45, 3), (0.2, 2)]
KINDS = ("click", "purchase", "signup", "view", "logout")


@query(
    "density_rank",
    f"""
WITH {EVENTS}, span AS (SELECT user_id, greatest(1.0, (max(t) - min(t)) / 86400000000.0::DOUBLE) AS days FROM e GROUP BY user_id),
c AS (SELECT user_id, kind, count(*) AS n FROM e GROUP BY ALL), parts(kind) AS (VALUES ('click'), ('purchase'), ('signup'), ('view'), ('logout')),
d AS (SELECT span.user_id, parts.kind, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / days AS density FROM span CROSS JOIN parts LEFT JOIN c ON c.user_id = span.user_id AND c.kind = parts.kind),
l AS (SELECT *, CAST(CASE WHEN density >= 1.5 THEN 5 WHEN density >= 0.8 THEN 4 WHEN density >= 0.45 THEN 3 WHEN density >= 0.2 THEN 2 ELSE 1 END AS INTEGER) AS level FROM d)
SELECT user_id, kind, n, round(density, 6) AS density, level, max(level) OVER (PARTITION BY user_id) AS band FROM l""",
)
def density_rank(spark, sf_dir):
    """Events a day by kind in bands, absent kinds included, and the user's highest band."""
    e = events(spark, sf_dir)
    by = e.groupBy("user_id").agg(F.greatest(F.lit(1.0), (F.max("t") - F.min("t")) / F.lit(86400000000.0)).alias("days"), *[F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).cast("long").alias(k) for k in KINDS])
    rows = by.select("user_id", "days", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in KINDS])).alias("c")).select("user_id", "c.kind", "c.n", (F.col("c.n") / F.col("days")).alias("density"))
    rows = rows.withColumn("level", stats.banded(F.col("density"), BANDS, 1))
    return rows.select("user_id", "kind", "n", F.round("density", 6).alias("density"), "level", F.max("level").over(Window.partitionBy("user_id")).alias("band"))


@query("peak_normalize", "SELECT l_returnflag, l_linenumber, round(sum(CASE WHEN m > 1 THEN l_quantity / m ELSE l_quantity END), 6) AS total FROM (SELECT *, max(abs(l_quantity)) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY ALL")
def peak_normalize(spark, sf_dir):
    l = stats.peak_normalized(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity"), ["l_returnflag"], "l_quantity")
    return l.groupBy("l_returnflag", "l_linenumber").agg(F.round(F.sum("l_quantity"), 6).alias("total"))


@query("standardize", f"WITH {FRAMES} SELECT vec_id, bin, round((v - avg(v) OVER p) / nullif(stddev_samp(v) OVER p, 0), 9) AS v FROM f WINDOW p AS (PARTITION BY vec_id)")
def standardize(spark, sf_dir):
    return stats.standardized(frames(spark, sf_dir), ["vec_id"], "v").withColumn("v", F.round("v", 9))


@query("dictionary_encode", f"WITH {EVENTS}, m AS (SELECT user_id, kind, min(event_id) AS f FROM e GROUP BY ALL) SELECT user_id, kind, row_number() OVER (PARTITION BY user_id ORDER BY f, kind) - 1 AS code FROM m")
def dictionary_encode(spark, sf_dir):
    return sequence.first_codes(events(spark, sf_dir), ["user_id"], "kind", "event_id").withColumn("code", F.col("code").cast("long"))


@query("duplicate_report", "SELECT md5(text) AS text_hash, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY doc_id) AS ids FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_report(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_hash"))
    g = d.groupBy("text_hash").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("doc_id")).alias("i")).where("n > 1")
    return g.select("text_hash", "n", F.array_join(F.transform("i", lambda x: x.cast("string")), ", ").alias("ids"))


@query(
    "seek_table",
    """
WITH p AS (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM documents),
s AS (SELECT unnest(range(0, CAST((SELECT max(pos) FROM p) // 32768 AS BIGINT) + 2)) AS step)
SELECT CAST(step AS BIGINT) AS step, coalesce((SELECT min(doc_id) FROM p WHERE pos >= step * 32768), 4294967295) AS page FROM s""",
)
def seek_table(spark, sf_dir):
    """For each step of 32,768 the first document that begins at or after it; past the end 2**32 - 1."""
    d = tree.extents(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], "n_chars", 1).withColumnRenamed("start_block", "pos")
    top = (d.agg(F.max("pos").alias("top")).first()["top"] or 0) // 32768 + 1
    d = d.withColumn("step", F.expr("pos div 32768")).groupBy("step").agg(F.min("doc_id").alias("page"))
    steps = spark.range(0, top + 1).select(F.col("id").alias("step"))
    # forward as-of within shards of steps: the next page of the shard, else the first of the next shard that has one
    both = steps.join(d, "step", "left").withColumn("shard", F.expr("step div 4096"))
    within = both.withColumn("p", F.first("page", True).over(Window.partitionBy("shard").orderBy("step").rowsBetween(0, Window.unboundedFollowing)))
    first = both.groupBy("shard").agg(F.min("page").alias("f"))
    first = first.withColumn("next", F.first("f", True).over(Window.orderBy("shard").rowsBetween(1, Window.unboundedFollowing))).select("shard", "next")
    out = within.join(F.broadcast(first), "shard")
    return out.select("step", F.coalesce("p", "next", F.lit(4294967295)).cast("long").alias("page"))


@query("extent_allocation", "SELECT doc_id, CAST((n_chars + 4095) // 4096 AS BIGINT) AS blocks, CAST(coalesce(sum((n_chars + 4095) // 4096) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_block FROM documents")
def extent_allocation(spark, sf_dir):
    return tree.extents(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], "n_chars", 4096).select("doc_id", "blocks", "start_block")


@query(
    "block_map",
    """
WITH x AS (SELECT doc_id, CAST((n_chars + 4095) // 4096 AS BIGINT) AS blocks, CAST(coalesce(sum((n_chars + 4095) // 4096) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM documents),
b AS (SELECT doc_id, s + unnest(range(0, blocks)) AS logical FROM x)
SELECT doc_id, logical, CAST(logical + (logical + 170) // 170 + CASE WHEN logical >= 170 THEN (logical + 28900) // 28900 ELSE 0 END + CASE WHEN logical >= 28900 THEN 1 ELSE 0 END AS BIGINT) AS physical FROM b""",
)
def block_map(spark, sf_dir):
    e = tree.extents(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], "n_chars", 4096).where("blocks > 0")
    b = e.select("doc_id", F.explode(F.sequence(F.col("start_block"), F.col("start_block") + F.col("blocks") - 1)).alias("logical"))
    return b.select("doc_id", "logical", tree.physical_block("logical").cast("long").alias("physical"))


HASH = "h AS (SELECT p_partkey, p_name, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(upper(p_name), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) AS hash FROM part)"


@query("path_hashes", f"WITH {HASH} SELECT p_partkey, hash FROM h")
def path_hashes(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", tree.path_hash(F.col("p_name")).alias("hash"))


@query("hash_buckets", f"WITH {HASH} SELECT CAST(s.slot AS BIGINT) AS slot, coalesce(max(p_partkey), -1) AS winner FROM (SELECT unnest(range(0, 997)) AS slot) s LEFT JOIN h ON hash % 997 = s.slot GROUP BY ALL")
def hash_buckets(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", tree.path_hash(F.col("p_name")).alias("hash"))
    return tree.hash_table(p, "hash", "p_partkey", 997)


@query(
    "hash_collisions",
    f"""
WITH {HASH}, g AS (SELECT hash % 997 AS slot, count(*) AS n, min(p_partkey) AS one FROM h GROUP BY ALL),
o AS (SELECT *, CAST(coalesce(sum(CASE WHEN n > 1 THEN n * 24 + 24 ELSE 0 END) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM g)
SELECT slot, n, CASE WHEN n > 1 THEN 2147483648 + place ELSE one END AS entry FROM o""",
)
def hash_collisions(spark, sf_dir):
    """Slots with one key hold it; the others a flag and the offset of their list."""
    p = read(spark, sf_dir, "part").select("p_partkey", tree.path_hash(F.col("p_name")).alias("hash"))
    g = p.groupBy(F.pmod("hash", F.lit(997)).alias("slot")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("only"))
    w = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # one row per slot: 997 at most
    at = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") * 24 + 24).otherwise(0)).over(w), F.lit(0))
    return g.select("slot", "n", F.when(F.col("n") > 1, at + 2147483648).otherwise(F.col("only")).cast("long").alias("entry"))


@query(
    "tree_paths",
    """
WITH RECURSIVE t AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent, p_brand AS s FROM part),
r AS (SELECT id, '/' || s AS path, 1 AS depth FROM t WHERE parent IS NULL OR parent NOT IN (SELECT id FROM t)
      UNION ALL SELECT t.id, r.path || '/' || t.s, r.depth + 1 FROM r JOIN t ON t.parent = r.id)
SELECT id, path, CAST(depth AS BIGINT) AS depth FROM r""",
)
def tree_paths(spark, sf_dir):
    """Absolute paths of the binary tree over part keys."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey > 1 THEN p_partkey div 2 END").alias("parent"), F.col("p_brand").alias("s"))
    return tree.paths(p, "id", "parent", "s")


@query(
    "parent_check",
    """SELECT c.c_custkey, CASE WHEN n.n_nationkey IS NULL THEN 'missing' WHEN n.n_regionkey > 3 THEN 'not a directory' ELSE 'ok' END AS status FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""",
)
def parent_check(spark, sf_dir):
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.select("c_custkey", F.when(F.col("n_nationkey").isNull(), "missing").when(F.col("n_regionkey") > 3, "not a directory").otherwise("ok").alias("status"))


@query(
    "digest_tree",
    """
WITH b AS (SELECT doc_id, unnest(range(0, greatest(1, (length(text) + 63) // 64))) AS i, text FROM documents),
d AS (SELECT doc_id, i, sha1(substr(text, CAST(i * 64 + 1 AS BIGINT), 64)) AS h FROM b)
SELECT doc_id, CAST(i // 170 AS BIGINT) AS node, sha1(string_agg(h, '' ORDER BY i)) AS digest FROM d GROUP BY ALL""",
)
def digest_tree(spark, sf_dir):
    return tree.digest_nodes(read(spark, sf_dir, "documents"), "doc_id", "text", 64, levels=1)


@query(
    "text_rules",
    """
SELECT doc_id, CAST(length(translate(text, '.,;|!$%&*#', '')) AS BIGINT) AS bare, contains(text, '|') AS is_table,
       CASE WHEN contains(text, '%%%') THEN 'noise' WHEN upper(text) = text THEN 'shout' WHEN contains(text, '|') THEN 'table' ELSE 'prose' END AS kind,
       substr(upper(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')), 1, 12) AS short_id FROM documents""",
)
def text_rules(spark, sf_dir):
    t = F.col("text")
    kind = F.when(F.contains(t, F.lit("%%%")), "noise").when(F.upper(t) == t, "shout").when(F.contains(t, F.lit("|")), "table").otherwise("prose")
    return read(spark, sf_dir, "documents").select("doc_id", F.length(F.translate(t, ".,;|!$%&*#", "")).cast("long").alias("bare"), F.contains(t, F.lit("|")).alias("is_table"), kind.alias("kind"), F.substring(F.upper(F.regexp_replace(t, "[^A-Za-z0-9]", "")), 1, 12).alias("short_id"))


@query("regex_extract", r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, split_part(url, '/', -1) AS leaf FROM pages")
def regex_extract(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.split_part(F.col("url"), F.lit("/"), F.lit(-1)).alias("leaf"))


@query(
    "line_leads",
    """
WITH l AS (SELECT conv_id, turn, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS n FROM l WHERE line <> '')
SELECT conv_id, n, md5(line) AS line_hash, length(line) AS chars, coalesce(lead(n) OVER (PARTITION BY conv_id ORDER BY n), -1) AS next_n FROM k""",
)
def line_leads(spark, sf_dir):
    """Non-empty lines numbered through each conversation, with the number of the next."""
    l = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line")).where("line <> ''")
    l = l.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "i")).cast("long"))
    l = sequence.until_next(l, ["conv_id"], ["n"], "n", "next_n", F.lit(-1).cast("long"))
    return l.select("conv_id", "n", F.md5("line").alias("line_hash"), F.length("line").cast("long").alias("chars"), "next_n")


@query(
    "table_diff",
    """
WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 0),
z AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 15 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 89 <> 0)
SELECT coalesce(a.o_orderkey, z.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL OR z.o_orderkey IS NULL THEN '<row>' WHEN a.o_orderstatus IS DISTINCT FROM z.o_orderstatus THEN 'o_orderstatus' ELSE 'o_totalprice' END AS "column"
FROM a FULL JOIN z ON a.o_orderkey = z.o_orderkey
WHERE a.o_orderkey IS NULL OR z.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM z.o_orderstatus OR a.o_totalprice IS DISTINCT FROM z.o_totalprice""",
)
def table_diff(spark, sf_dir):
    """The first differing column of each order against an altered copy."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    a = o.where("o_orderkey % 97 <> 0")
    z = o.where("o_orderkey % 89 <> 0").withColumn("o_orderstatus", F.expr("IF(o_orderkey % 10 = 0, 'X', o_orderstatus)")).withColumn("o_totalprice", F.expr("IF(o_orderkey % 15 = 0, o_totalprice + 1, o_totalprice)"))
    cols = ["o_orderstatus", "o_totalprice", "o_orderpriority"]
    return diff.first_difference(diff.table_diff(a, z, ["o_orderkey"], cols), ["o_orderkey"], cols).select("o_orderkey", "column")


@query(
    "validator_report",
    """
WITH c AS (SELECT * FROM (VALUES ('name format'), ('balance'), ('segment known')) v("check")),
b AS (SELECT 'name format' AS "check", c_custkey, regexp_matches(c_name, '^Customer#[0-9]{9}$') AS ok FROM customer
      UNION ALL SELECT 'balance', c_custkey, c_acctbal >= 0 FROM customer UNION ALL SELECT 'segment known', c_custkey, c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE') FROM customer)
SELECT c."check", count(*) FILTER (NOT coalesce(ok, false)) AS failed, CASE WHEN count(*) FILTER (NOT coalesce(ok, false)) = 0 THEN 'ok' ELSE 'failed' END AS status, min(c_custkey) FILTER (NOT coalesce(ok, false)) AS first
FROM c JOIN b ON c."check" = b."check" GROUP BY ALL""",
)
def validator_report(spark, sf_dir):
    checks = {
        "name format": F.col("c_name").rlike("^Customer#[0-9]{9}$"),
        "balance": F.col("c_acctbal") >= 0,
        "segment known": F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE"),
    }
    return diff.report(read(spark, sf_dir, "customer"), checks, "c_custkey")


@query("missing_parts", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)")
def missing_parts(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey").join(read(spark, sf_dir, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_anti")


@query("known_segments", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def known_segments(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("bag_concat", "SELECT s_suppkey AS id, s_nationkey AS nation, 'supplier' AS side FROM supplier UNION ALL SELECT c_custkey, c_nationkey, 'customer' FROM customer")
def bag_concat(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("side"))
    return s.unionByName(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.lit("customer").alias("side")))


@query("first_maximum", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) WHERE i = 1")
def first_maximum(spark, sf_dir):
    """Arg-max with ties to the smallest key, by one map-side combined aggregate instead of a window."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("m"))
    return o.select("o_custkey", (-F.col("m.k")).alias("o_orderkey"), F.col("m.o_totalprice").alias("o_totalprice"))


@query("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("mapped_channels", "WITH m(kind, channel, gain) AS (VALUES ('click', 0, 1.0::DOUBLE), ('click', 1, 1.0::DOUBLE), ('view', 2, 0.5::DOUBLE), ('purchase', 3, 0.25::DOUBLE)) SELECT channel, count(*) AS n, round(sum(value * gain), 4) AS total FROM events JOIN m ON event_type = kind GROUP BY ALL")
def mapped_channels(spark, sf_dir):
    """Events routed to channels by a small mapping table; kinds without a channel fall away."""
    m = spark.createDataFrame([("click", 0, 1.0), ("click", 1, 1.0), ("view", 2, 0.5), ("purchase", 3, 0.25)], "event_type string, channel int, gain double")
    j = read(spark, sf_dir, "events").join(F.broadcast(m), "event_type")
    return j.groupBy("channel").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * F.col("gain")), 4).alias("total"))


@query("rank_projection", "SELECT p_partkey, lower(replace(p_brand, ' ', '')) AS brand, greatest(0, CAST(trunc(0.25 * p_retailprice) AS BIGINT)) AS preview_start, CASE WHEN p_size >= 10 THEN 2 ELSE 1 END AS grade, lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS code FROM part")
def rank_projection(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.lower(F.replace(F.col("p_brand"), F.lit(" "), F.lit(""))).alias("brand"), F.greatest(F.lit(0), (0.25 * F.col("p_retailprice")).cast("long")).cast("long").alias("preview_start"), F.when(F.col("p_size") >= 10, 2).otherwise(1).alias("grade"), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0").alias("code"))


@query(
    "scalar_functions",
    f"""
WITH {EVENTS} SELECT event_id, round(69 + 12 * log2((value + 1) / 440), 6) AS midi, round(440 * pow(2.0::DOUBLE, (k - 69) / 12.0::DOUBLE), 6) AS hz, CAST(round_even(value, 0) AS BIGINT) AS half_even,
 CAST(trunc(6e7::DOUBLE / (k + 1)) AS BIGINT) AS us_per_beat, ((k * 2) >> 3 << 11) | ((k * 2) >> 2 << 5) | ((k * 2) >> 3) AS rgb565, (k - 60 + 4294967296) % 4294967296 AS u32,
 greatest(48, least(84, k)) AS clamped FROM e""",
)
def scalar_functions(spark, sf_dir):
    k, v = F.col("k"), F.col("value")
    return events(spark, sf_dir).select(
        "event_id",
        F.round(scalar.hz_to_midi(v + 1), 6).alias("midi"),
        F.round(scalar.midi_to_hz(k), 6).alias("hz"),
        scalar.half_even(v).alias("half_even"),
        scalar.micros_per_beat(k + 1).alias("us_per_beat"),
        scalar.rgb565(k * 2, k * 2, k * 2).alias("rgb565"),
        scalar.u32(k - 60).alias("u32"),
        scalar.clamp(k, 48, 84).alias("clamped"),
    )


@query("vector_cosine", f"WITH {FRAMES}, g AS (SELECT vec_id // 2 AS pair, bin, max(v) FILTER (vec_id % 2 = 0) AS a, max(v) FILTER (vec_id % 2 = 1) AS b FROM f GROUP BY ALL) SELECT CAST(pair AS BIGINT) AS pair, round(CASE WHEN sum(a * a) * sum(b * b) = 0 THEN 0 ELSE sum(a * b) / sqrt(sum(a * a) * sum(b * b)) END, 6) AS cosine FROM g GROUP BY pair HAVING count(a) > 0 AND count(b) > 0")
def vector_cosine(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 2").alias("pair"), (F.col("vec_id") % 2).alias("side"), "embedding")
    a, b = (e.where(F.col("side") == s).select("pair", F.col("embedding").alias(n)) for s, n in ((0, "a"), (1, "b")))
    return a.join(b, "pair").select("pair", F.round(scalar.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))
