"""Shared Spark helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chronoline.session import checkpoint_dir, cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: bytes, as ``sized`` reckons them, for each partition of an intermediate table
PER_TASK = 4 << 20


def sized(df: DataFrame, weight: Column | None = None, **also: Column) -> tuple[DataFrame, dict]:
    """``cut(df)`` in as many partitions as its size asks for, and what was observed on the way: rows
    ``n``, whether it is ``one`` partition, and whatever aggregates ``also`` names. A row weighs 64 bytes or ``weight``. Small tables so
    take few tasks, and a table of one partition joins and groups without a shuffle; large ones keep
    the partitions they have."""
    seen = Observation()
    size = F.sum(F.lit(64) if weight is None else weight + 64)
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), size.alias("size"), *[c.alias(k) for k, c in also.items()]))
    got = dict(seen.get)
    parts = max(1, -(-(got["size"] or 0) // PER_TASK))
    return out.coalesce(parts), got | {"one": parts == 1}


def joined(left: DataFrame, right: DataFrame, on, one: bool, how: str = "inner") -> DataFrame:
    """The join; of two tables of ``one`` partition each it is known to be one again, so that what
    follows needs no shuffle either."""
    out = left.join(right, on, how)
    return out.coalesce(1) if one else out


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that occurs in ``links``; component is the smallest
    node reachable. Alternates large-star and small-star steps; each is a min-aggregation
    and an equi-join, so a hub's rows are combined before the shuffle and can be split.
    Nulls and self-links are ignored; an empty input gives an empty result."""
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges, before = sized(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while before["n"]:
        one = before["one"]
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = joined(both, low, "u", one).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined(large, low, "u", one).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges, now = sized(small.where("u != v").distinct(), x=F.sum(F.hash("u", "v").cast("long")), y=F.sum(F.hash("v", "u").cast("long")))
        if now == before:
            break
        before = now
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("x")).select("x.*").distinct()


def columns(df: DataFrame, **wanted: tuple[str, str]) -> DataFrame:
    """``df`` with just the columns wanted: new name = (column, type). A column that has its name
    and type already stays as it is, so that equal plans remain equal and share exchanges."""
    kinds = dict(df.dtypes)
    out = []
    for name, (column, kind) in wanted.items():
        c = F.col(f"`{column}`")
        if kinds[column] != kind:
            c = c.cast(kind).alias(name)
        out.append(c if column == name and kinds[column] == kind else c.alias(name))
    return df.select(*out)


def packed(docs: DataFrame) -> DataFrame:
    """(row, text): all columns of ``docs`` but its string column text in a struct, so that none clashes with
    an operator's own; ``unpacked`` puts them back."""
    whole = dict(docs.dtypes)["text"] == "string"  # else the column itself is kept too
    return docs.select(F.struct(F.lit(True).alias("__packed"), *(F.col(f"`{c}`") for c in docs.columns if not (whole and c == "text"))).alias("row"), F.col("text").cast("string").alias("text"))


def unpacked(rows: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of ``docs`` from packed rows, with another text where one is given."""
    whole = dict(docs.dtypes)["text"] == "string"
    of = lambda c: (F.col("text") if text is None else text) if c == "text" and (whole or text is not None) else F.col("row")[c]
    return rows.select(*(of(c).alias(c) for c in docs.columns))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as a URI."""
    checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id", most: int = 1_000_000) -> DataFrame:
    """``docs`` less the rows whose key is in ``ids``; rows with a null key stay. At most ``most``
    ids of 8 bytes are broadcast; beyond that both sides are shuffled."""
    ids, seen = sized(ids.select(key).where(F.col(key).isNotNull()).distinct())
    return docs.join(F.broadcast(ids) if seen["n"] <= most else ids, key, "left_anti").select(*docs.columns)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts of a few kilobytes: 10,000 rows, Spark's default, are tens of MB
    in each of a task's buffers. A setting other than the default stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


#: DuckDB has no crc32: a table of bytes' remainders by the rule of the polynomial, and a fold over the bytes of a string
CRC_TABLE = "crct AS (SELECT list(c ORDER BY k) AS tbl FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS k)))"


def crc_sql(text: str) -> str:
    """The unsigned crc32 of a string that isn't null, in a query that also reads ``crct``."""
    data = f"list_transform(string_split(regexp_replace(hex(encode({text})), '(..)', '\\1,', 'g'), ',')[:-2], lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {data}), lambda c, x: xor(c >> 8, tbl[xor(c & 255, x) + 1])))"
