"""Spelling variants: words one edit apart, by Aho-Corasick automata over halves of words.

Of two words one insertion, deletion or replacement apart, the edit lies in one half of the shorter
(the owner), so the other half stands unchanged in the longer: the first half at its start, or
the second at its end. Owners' halves are dealt to automaton shards by their hash. Every word is
scanned by the shards that may hold a half that fits it: only lengths from its own to one less
count, so there are three or fewer such halves. A hit is kept if its offset and the lengths fit,
and the rest beside it is verified. A pair whose edit could lie in either half counts for
the first, so numbers of near words add up over shards and no pair is ever listed.

Words that share a half are verified together by their rests with one code point left out, which takes
time in proportion to their number. A half shared by more than ``most`` words, or with a rest of more than
``longest`` code points, isn't verified: its words' rests are split into halves in turn and scanned
again, until each group is small; rests of one code point bound a group by the alphabet.

Defined results: a null text has no words; a null doc_id counts as an empty string in the hash; repeated rows
count each time; texts of any length are read whole, runs of any length are words; equal counts are
decided by code points; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import CRC_TABLE, crc_sql, cut, joined, sized, table

#: letters of the contract in UTF-8, A-Z lower-cased: a-z and U+00C0 to U+00FF
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
BETWEEN = re.compile(rb"[\x00-\x60\x7b-\x7f]")
#: bytes of text read at once, distinct words kept in a task, word rows of a shard
SLICE, HELD, PER_SHARD = 1 << 22, 200_000, 40_000


def runs(text: bytes):
    """Maximal runs of letters, A-Z lower-cased; a slice of a long text ends between runs."""
    raw, at = text.lower(), 0  # of bytes, so only A-Z change
    while at < len(raw):
        m = BETWEEN.search(raw, at + SLICE)
        end = m.start() if m else len(raw)
        yield from RUN.findall(raw, at, end)
        at = end


def words(docs: DataFrame, slips: int = 97, shortest: int = 5, fewest: int = 3, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs as the documents have them, one code point deleted where the hash of document
    and run is a multiple of ``slips``; of at least ``shortest`` code points and ``fewest`` occurrences."""

    def count(batches):
        total: Counter = Counter()
        for b in batches:
            for d, t in zip(b.column(0), b.column(1), strict=True):
                start = zlib.crc32((d.as_py() or "").encode() + b":")
                for run, n in Counter(runs(t.as_py() or b"")).items():
                    h = zlib.crc32(run, start)
                    if h % slips == 0:
                        letters = run.decode()
                        at = h % len(letters)
                        run = (letters[:at] + letters[at + 1 :]).encode()
                    if len(run) >= shortest:
                        total[run] += n
                if len(total) > HELD:
                    yield rows(total)
                    total.clear()
        yield rows(total)

    def rows(total):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    found = docs.select(F.col(f"`{doc}`").cast("string").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text")).mapInArrow(count, "word string, n bigint")
    return found.where(F.length("word") >= shortest).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def split(rows: DataFrame) -> DataFrame:
    """Rows (word, n, path, p, q, last, owner) for the halves of what lies between the first p and the last q
    code points, with ``rest``, the longest rest of the new group, and ``side``."""
    m = F.length("word") - F.col("p") - F.col("q")

    def halves(side: str, half: Column, half_less: Column):
        first = side == "first"

        def row(h: Column, owner: Column) -> Column:
            p, q = (F.col("p") + h, F.col("q")) if first else (F.col("p"), F.col("q") + h)
            return F.struct(
                p.cast("int").alias("p"), q.cast("int").alias("q"), F.lit(side).alias("side"), (owner & F.col("owner")).alias("owner"), (h + 2).cast("int").alias("rest"),
                (F.col("last") if first else F.lit(True)).alias("last"), F.concat_ws(",", "path", F.concat(F.lit(side[0]), p.cast("string"), F.lit("."), q.cast("string"))).alias("path"),
            )

        return F.when(half == half_less, F.array(row(half, F.lit(True)))).otherwise(F.array(row(half, F.lit(True)), row(half_less, F.lit(False))))

    up = lambda c: F.ceil(c / 2)
    down = lambda c: F.floor(c / 2)
    less = F.greatest(m - 1, F.lit(0))
    every = F.concat(halves("first", down(m), down(less)), halves("second", up(m), up(less)))
    return rows.select("word", "n", F.explode(every).alias("x")).select("word", "n", "x.*")


def key() -> list[Column]:
    """What the words of a group have in common; its hash is as good, and short."""
    common = F.concat_ws("\0", "path", F.substring("word", 1, F.col("p")), F.expr("right(word, q)"))
    return [F.xxhash64(common).alias("key"), F.xxhash64(F.reverse(common)).alias("key2")]


def scan(rows: pa.Table) -> pa.Table:
    """(word, near, best_n, best) for the words of a shard that have near words there."""
    col = {c: rows.column(c).to_pylist() for c in ("word", "n", "path", "p", "q", "side", "owner", "last")}
    automaton, halves = ahocorasick.Automaton(), {}
    for word, p, q, side, owner in zip(col["word"], col["p"], col["q"], col["side"], col["owner"], strict=True):
        half = word[:p] if side == "first" else word[len(word) - q :]
        if owner and half and half not in halves:
            halves[half] = len(half)
            automaton.add_word(half, len(half))
    if halves:
        automaton.make_automaton()
    groups: dict[tuple, list] = {}
    for k, (word, p, q, side) in enumerate(zip(col["word"], col["p"], col["q"], col["side"], strict=True)):
        length, at = (p, p) if side == "first" else (q, len(word))
        hit = not length or halves and any(end + 1 == at and size == length for end, size in automaton.iter(word))
        if hit:
            groups.setdefault((col["path"][k], word[:p], word[len(word) - q :]), []).append(k)
    out: dict[str, list] = {}
    for members in groups.values():
        if len(members) > 1:
            verify([(col["word"][k], col["n"][k], col["word"][k][col["p"][k] : len(col["word"][k]) - col["q"][k]], col["owner"][k]) for k in members], col["side"][members[0]] == "second" or col["last"][members[0]], out)
    return pa.table({"word": pa.array(list(out), pa.string()), "near": pa.array([v[0] for v in out.values()], pa.int64()), "best_n": pa.array([-v[1][0] for v in out.values()], pa.int64()), "best": pa.array([v[1][1] for v in out.values()], pa.string())})


def verify(members: list[tuple[str, int, str, bool]], but_last: bool, out: dict[str, list]) -> None:
    """Adds to ``out`` the near words among ``members`` (word, n, rest, owner), which agree but for their rests:
    how many, and the best as (-n, word). ``but_last``: a pair that leaving out the last code point
    of the longer rest explains counts elsewhere."""

    def near(word, count, best):
        have = out.get(word)
        if have is None:
            out[word] = [count, best]
        else:
            have[0] += count
            if best < have[1]:
                have[1] = best

    owners, replaced = {}, {}
    for word, n, rest, owner in members:
        if owner:
            owners[rest] = (-n, word)
            for i in range(len(rest)):
                replaced.setdefault((i, rest[:i] + rest[i + 1 :]), []).append((-n, word))
    for same in replaced.values():
        if len(same) > 1:
            same.sort()
            for k, (_, word) in enumerate(same):
                near(word, len(same) - 1, same[k == 0])
    for word, n, rest, _ in members:
        shorter = {rest[:i] + rest[i + 1 :] for i in range(len(rest))}
        if but_last:
            shorter.discard(rest[:-1])
        for v in shorter:
            if (o := owners.get(v)) is not None and len(o[1]) == len(word) - 1:
                near(word, 1, o)
                near(o[1], 1, (-n, word))


def near_words(vocabulary: DataFrame, most: int = 20_000, longest: int = 48) -> DataFrame:
    """(word, near, best_n, best) for words with near words: their number, and the one of largest n."""
    rows = split(vocabulary.select("word", "n", F.lit("").alias("path"), F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(False).alias("last"), F.lit(True).alias("owner")))
    found = None
    while True:
        rows, seen = sized(rows.select("*", *key()), F.length("word"), long=F.count_if(F.col("rest") > longest))
        if not seen["n"]:
            break
        # groups of over ``most`` rows: fewer than rows / most
        hot, heat = sized(rows.groupBy("key", "key2").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most).select("key", "key2", F.lit(True).alias("hot")))
        again = None
        if heat["n"] or seen["long"]:
            rows = cut(rows.join(F.broadcast(hot) if heat["n"] <= 10_000 else hot, ["key", "key2"], "left"))
            # what can't get smaller is small: at most the alphabet's size for each pair of ends
            deeper = (F.col("hot") | (F.col("rest") > longest)) & (F.col("rest") > 2)
            again = rows.where(F.coalesce(deeper, F.lit(False))).select("word", "n", "path", "p", "q", "last", "owner")
            rows = rows.where(~F.coalesce(deeper, F.lit(False)))
        shards = max(1, -(-seen["n"] // PER_SHARD))
        part = cut(rows.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInArrow(scan, "word string, near bigint, best_n bigint, best string"))
        found = part if found is None else found.unionAll(part)
        if again is None:
            break
        rows = split(again)
    if found is None:
        return vocabulary.sparkSession.createDataFrame([], "word string, near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("x")).select("word", "near", (-F.col("x.n")).alias("best_n"), F.col("x.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form (word, form). A form has twice the count, so there are no
    cycles; pointers double, and a round more is taken than half the depth's logarithm needs."""
    at, seen = sized(forms.select("word", F.col("form").alias("root")), F.length("word") * 2)
    while seen["n"]:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at, now = sized(joined(at, step, "root", seen["one"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), F.length("word") * 2, moved=F.count_if("moved"))
        at = at.drop("moved")
        if not now["moved"]:
            break
    return at


def variants(docs: DataFrame, slips: int = 97, shortest: int = 5, fewest: int = 3, factor: int = 2, most: int = 20_000, longest: int = 48, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word."""
    vocabulary, seen = sized(words(docs, slips, shortest, fewest, doc, text), F.length("word"))
    near = near_words(vocabulary, most, longest)
    known = F.col("best_n") >= factor * F.col("n")
    out = cut(vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(known, F.col("best")).alias("form"), F.when(known, F.col("best_n")).alias("form_n")))
    root = roots(out.where("form IS NOT NULL"))
    return out.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT doc_id, run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS hashed, count(*) AS n FROM r GROUP BY doc_id, run),
h AS (SELECT run, n, {crc_sql("hashed")} AS h FROM g, crct),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.less = w.word
      UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.less = w.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS best, max(near_n) AS best_n FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.best_n >= 2 * w.n THEN b.best END AS form, CASE WHEN b.best_n >= 2 * w.n THEN b.best_n END AS form_n FROM w LEFT JOIN b ON b.word = w.word),
c AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, c.next, f.form FROM c JOIN f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word AND c.next IS NULL
"""


def query(spark, sf_dir):
    return variants(table(spark, sf_dir, "documents"))
