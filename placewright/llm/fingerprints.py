"""Order MinHash fingerprints, in DataFrame functions only.

A text's k-mers are runs of ``K`` words (a shorter text is one k-mer, an empty one none), each numbered by its occurrence,
so that repetition counts. Each of ``M`` seeded hashes orders the numbered k-mers at random; the two that are minimal under
it and under its reverse are taken, put back in text order, and hashed as a tuple. The M tuple hashes are the fingerprint.
A component agrees only if both k-mers are shared and stand in the same order, which is what makes it sensitive to edit
distance; likeness is the share of agreeing components (1 for two texts without k-mers).

Occurrence numbers need work only where a text repeats a k-mer: there the hashes are sorted with their places and cut in runs.
Neighbours by descending doc_id are found without a total order in one task: ids are dealt to ranges, and the first row of
each range is also sent to the end of the range before. Null ids come last; rows of one id are ordered by their text. Null
text is empty. Ranges come from approximate percentiles of the ids and from equal steps between those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placewright.llm.common import parts

K = 2
M = 32
POS_BITS = 26
COARSE = 64
_POS = (1 << POS_BITS) - 1


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; a plain reference inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kmer_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    long_enough = lambda h: F.transform(F.slice(h, 1, F.size(h) - (K - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, K)]))
    short = lambda h: F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    return _let(hashes, lambda h: F.when(F.size(h) >= K, long_enough(h)).otherwise(short(h)))


def _placed(kmers: Column) -> Column:
    return F.transform(kmers, lambda h, i: F.shiftleft(h, POS_BITS).bitwiseOR(i.cast("bigint")))


def _entry(x: Column, o: Column) -> Column:
    return F.struct(x.alias("x"), o.cast("int").alias("o"))


def _numbered(s: Column) -> Column:
    """Entries of sorted placed hashes: equal hashes stand together in text order."""
    high = lambda x: F.shiftright(x, POS_BITS)
    starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda t: (t == 0) | (high(F.get(s, t)) != high(F.get(s, t - 1))))
    runs = lambda st: F.transform(st, lambda a, r: F.slice(s, a + 1, F.coalesce(F.get(st, r + 1), F.size(s)) - a))
    return F.flatten(F.transform(_let(starts, runs), lambda run: F.transform(run, _entry)))


def numbered_kmers(text: Column) -> Column:
    """array<struct<x, o>>: the k-mer's hash above its place (``POS_BITS`` bits), and its occurrence number from 0."""
    plain = lambda k: F.transform(_placed(k), lambda x: _entry(x, F.lit(0)))
    return _let(kmer_hashes(text), lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), plain(k)).otherwise(_let(F.sort_array(_placed(k)), _numbered)))


def ranges(docs: DataFrame, n: int) -> tuple[Column, list]:
    """A range number for doc_id, increasing with it (-1 for null), and (largest id, number) of each range in use."""
    q = docs.select(F.percentile_approx("doc_id", [i / COARSE for i in range(COARSE + 1)], 10_000).alias("q")).first()["q"]
    cuts = sorted({*q}) if q else [0]
    lows = F.array(*[F.lit(x).cast("long") for x in cuts])
    highs = F.array(*[F.lit(x).cast("long") for x in [*cuts[1:], cuts[-1] + 1]])
    steps = max(1, -(-n // COARSE))
    coarse = F.lit(0)
    for i, x in enumerate(cuts):
        coarse = coarse + (F.col("doc_id") > F.lit(x)).cast("int") if i else coarse
    lo, hi = F.get(lows, coarse).cast("double"), F.get(highs, coarse).cast("double")
    inside = F.floor((F.col("doc_id").cast("double") - lo) / (hi - lo) * steps).cast("int")
    number = F.coalesce(coarse * steps + F.greatest(F.lit(0), F.least(F.lit(steps - 1), inside)), F.lit(-1))
    used = docs.groupBy(number.alias("r")).agg(F.max("doc_id").alias("top")).orderBy("r").collect()  # at most n + COARSE rows
    return number, [(r["top"], r["r"]) for r in used]


def neighbours(docs: DataFrame) -> DataFrame:
    """Every row with the text of the next document, and after each range (``ghost``) the first row of the range before it."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    number, used = ranges(docs.select("doc_id"), 8 * parts(spark))
    # ids fall from range to range: the first row of range i follows the last row of range i + 1
    follow = [(used[i][0], used[i + 1][1]) for i in range(len(used) - 1)] + ([(used[-1][0], used[0][1])] if used else [])
    sent = spark.createDataFrame(follow, f"top {kind}, target int").groupBy("top").agg(F.collect_set("target").alias("targets"))
    rows = docs.withColumn("r", number).join(F.broadcast(sent), F.col("doc_id").eqNullSafe(F.col("top")), "left")
    rows = rows.select("doc_id", "text", F.explode(F.concat(F.array(F.struct(F.col("r"), F.lit(0).alias("ghost"))), F.transform(F.coalesce("targets", F.array().cast("array<int>")), lambda t: F.struct(t.alias("r"), F.lit(1).alias("ghost"))))).alias("at"))
    rows = rows.select("doc_id", "text", "at.r", "at.ghost")
    own = W.partitionBy("r").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    return rows.select("*", F.lead("text").over(own).alias("next_text"), F.row_number().over(own).alias("rn"))


def fingerprint_columns() -> list[Column]:
    """Of exploded (x, o) rows, the least and greatest packed key of each hash."""
    out = []
    for j in range(M):
        key = F.xxhash64(F.shiftrightunsigned("x", POS_BITS), "o", F.lit(j)).bitwiseAND(F.lit(~_POS)).bitwiseOR(F.col("x").bitwiseAND(F.lit(_POS)))
        key = F.when(F.col("x").isNotNull(), key)
        out += [F.min(key).alias(f"a{j}"), F.max(key).alias(f"b{j}")]
    return out


def tuple_hashes() -> list[Column]:
    out = []
    for j in range(M):
        a, b = F.col(f"a{j}"), F.col(f"b{j}")
        place = lambda x: x.bitwiseAND(F.lit(_POS))
        key = lambda x: F.shiftright(x, POS_BITS)
        first = place(a) <= place(b)
        out.append(F.lpad(F.lower(F.hex(F.xxhash64(F.when(first, key(a)).otherwise(key(b)), F.when(first, key(b)).otherwise(key(a))).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return out


def likeness(a: Column, b: Column) -> Column:
    same = lambda j: (F.substring(a, 8 * j + 1, 8) == F.substring(b, 8 * j + 1, 8)).cast("int")
    total = same(0)
    for j in range(1, M):
        total = total + same(j)
    return total / F.lit(float(M))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``fingerprint`` of ``text`` for each distinct value of ``keys`` (columns that identify a row)."""
    rows = docs.select(*keys, numbered_kmers(F.coalesce(F.col(text), F.lit(""))).alias("e"))
    rows = rows.select(*keys, F.explode_outer("e").alias("e")).select(*keys, "e.x", "e.o")
    return rows.groupBy(*keys).agg(*fingerprint_columns()).select(*keys, F.concat(*tuple_hashes()).alias("fingerprint"))


def digest(docs: DataFrame) -> DataFrame:
    rows = neighbours(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", 1, n - third), F.substring(F.coalesce("next_text", F.lit("")), 1, third))
    rows = rows.select("r", "rn", "ghost", "doc_id", n.cast("long").alias("n_chars"), "text", F.when(F.col("ghost") == 0, edited).alias("edited"))
    rows = rows.select("r", "rn", "ghost", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("v", "t"))
    prints = fingerprints(rows, ["r", "rn", "v", "ghost", "doc_id", "n_chars", "edited_sha256"], "t")
    own = W.partitionBy("r").orderBy("rn", "v")
    out = prints.select("*", F.lead("fingerprint", 1).over(own).alias("edited_fingerprint"), F.lead("fingerprint", 2).over(own).alias("next_fingerprint"))
    return out.where("v = 0 AND ghost = 0").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
