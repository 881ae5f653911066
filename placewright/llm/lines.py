"""Line deduplication with a sharded minimal perfect hash.

A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of at least ``least_chars`` code
points that occur in at least ``least_docs`` documents lose all their lines except in the largest doc_id holding them.

1. Rows are written in packed blocks of some ``BLOCK`` bytes. Every block gives the 128-bit hashes of its distinct keys with the number
   of its documents that hold them and the largest doc_id; Spark adds these up by hash.
2. All distinct hashes are dealt to shards of some ``SHARD_KEYS``. A shard is a minimal perfect hash over their low halves; its index
   reaches arrays of 64-bit fingerprints (the high halves), document counts and largest doc_ids.
3. Documents probe these arrays by block: the distinct hashes of a block go to the shards, and those whose count reaches the limit come
   back with the doc_id that keeps them. A key of any frequency is one probe a block. A shard is probed in as many groups as
   hold ``GROUP`` blocks each, so no task's probes grow with the corpus.

There is one way for every size; nothing is shipped to all tasks. Null or empty text is one empty line. Every row is a document: rows
that repeat a doc_id count each, and all rows of the largest doc_id keep their lines. A null doc_id ranks below all others. Other
columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewright.llm.common import WHITE, blocks, cut, numbers, parts, settled, unpacked
from placewright.llm.perfect_hash import PerfectHash

BLOCK = 1 << 20
SHARD_KEYS = 100_000
GROUP = 1_000_000
NO_ID = -(1 << 63)


def line_hashes(text: str | None, least_chars: int) -> tuple[list[bytes], list[int], list[int], list[int]]:
    """Raw lines, and for those long enough: row numbers, low and high halves of the key's hash."""
    raw = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    rows, low, high = [], [], []
    for i, line in enumerate(raw):
        if len(line) < least_chars:
            continue
        key = line.strip(WHITE).lower()
        if len(key) < least_chars or len(key) < 4 * least_chars and len(key.decode("utf-8", "surrogatepass")) < least_chars:
            continue
        h = xxhash.xxh3_128_intdigest(key)
        rows.append(i)
        low.append(h & (1 << 64) - 1)
        high.append(h >> 64)
    return raw, rows, low, high


def _signed(x) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def _signed(x) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def _ids(table: pa.Table) -> list[int]:
    return [NO_ID if i is None else i for i in table.column("doc_id").to_pylist()]


def keys_of_blocks(packed: DataFrame, least_chars: int) -> DataFrame:
    """block, low, high, n (documents of the block that hold the key), top (their largest doc_id)."""

    def run(batches):
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body")):
                table, found = unpacked(body), {}
                for i, text in zip(_ids(table), table.column("text").to_pylist()):
                    _, _, low, high = line_hashes(text, least_chars)
                    for key in {*zip(low, high)}:
                        n, top = found.get(key, (0, NO_ID))
                        found[key] = n + 1, max(top, i)
                low, high, n, top = _signed([k[0] for k in found]), _signed([k[1] for k in found]), [v[0] for v in found.values()], [v[1] for v in found.values()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block)), pa.array(low), pa.array(high), pa.array(n, pa.int64()), pa.array(top, pa.int64())], ["block", "low", "high", "n", "top"])

    return cut(packed.select("block", "body").mapInArrow(run, "block long, low long, high long, n long, top long"))


class Shard:
    """Compact arrays under a minimal perfect hash. Of keys with one low half, the spare holds all but one."""

    def __init__(self, low: np.ndarray, high: np.ndarray, count: np.ndarray, keep: np.ndarray):
        _, first = np.unique(low, return_index=True)
        self.hash, n = PerfectHash(low[first]), len(first)
        at = self.hash.index(low[first])
        self.marks, self.count, self.keep = np.empty(n, np.uint64), np.empty(n, np.int64), np.empty(n, np.int64)
        self.marks[at], self.count[at], self.keep[at] = high[first], count[first], keep[first]
        self.spare = {(int(low[i]), int(high[i])): (int(count[i]), int(keep[i])) for i in np.setdiff1d(np.arange(len(low)), first)}

    def look(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document count and largest doc_id of each key; count 0 for others."""
        at = self.hash.index(low)
        found = at >= 0
        found[found] = self.marks[at[found]] == high[found]
        count, keep = np.zeros(len(low), np.int64), np.full(len(low), NO_ID)
        count[found], keep[found] = self.count[at[found]], self.keep[at[found]]
        for i in np.flatnonzero(~found) if self.spare else ():
            count[i], keep[i] = self.spare.get((int(low[i]), int(high[i])), (0, NO_ID))
        return count, keep


def frequent(keys: DataFrame, least_docs: int, shard_keys: int, group: int) -> DataFrame:
    """block, low, high, keep of the keys of each block that are in at least ``least_docs`` documents."""
    n_keys, n_blocks = keys.agg(F.count("*"), F.approx_count_distinct("block")).first()
    shards, groups = max(1, parts(keys.sparkSession), n_keys // shard_keys), max(1, n_blocks // group)
    shard = F.pmod(F.xxhash64("low"), F.lit(shards)).alias("shard")
    counted = keys.groupBy("low", "high").agg(F.sum("n").alias("n"), F.max("top").alias("keep"))
    index = counted.select(shard, "low", "high", "n", "keep", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    probes = keys.select(shard, F.pmod("block", F.lit(groups)).cast("int").alias("part"), F.col("block").alias("of"), F.col("low").alias("a"), F.col("high").alias("b"))  # columns of its own: both sides come from one table

    def probe(held: pa.Table, asked: pa.Table) -> pa.Table:
        low, high = numbers(asked, "a"), numbers(asked, "b")
        arrays = Shard(numbers(held, "low").view(np.uint64), numbers(held, "high").view(np.uint64), numbers(held, "n"), numbers(held, "keep"))
        count, keep = arrays.look(low.view(np.uint64), high.view(np.uint64))
        hit = count >= least_docs
        return pa.table([pa.array(x[hit]) for x in (numbers(asked, "of"), low, high, keep)], ["block", "low", "high", "keep"])

    return index.groupBy("shard", "part").cogroup(probes.groupBy("shard", "part")).applyInArrow(probe, "block long, low long, high long, keep long")


def _kept(raw: list[bytes], gone: set[int]) -> str:
    return b"\n".join(x for i, x in enumerate(raw) if i not in gone).decode("utf-8", "surrogatepass") if gone else b"\n".join(raw).decode("utf-8", "surrogatepass")


def dedup(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, shard_keys: int = SHARD_KEYS, group: int = GROUP, most: int = BLOCK) -> DataFrame:
    """``docs`` with ``text`` of the kept lines, ``n_lines`` and ``n_dropped``."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    packed = blocks(docs.select(*names), "text", most)
    found = settled(lambda: frequent(keys_of_blocks(packed, least_chars), least_docs, shard_keys, group))()
    schema = T.StructType([T.StructField("text", T.StringType()) if c == "text" else docs.schema[c] for c in names] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def apply(rows: pa.Table, found: pa.Table) -> pa.Table:
        table = unpacked(rows.column("body")[0])
        keep = {(a, b): k for a, b, k in zip(numbers(found, "low").view(np.uint64).tolist(), numbers(found, "high").view(np.uint64).tolist(), numbers(found, "keep").tolist())}
        texts, lines, dropped = [], [], []
        for i, text in zip(_ids(table), table.column("text").to_pylist()):
            raw, at, low, high = line_hashes(text, least_chars)
            gone = {x for x, key in zip(at, zip(low, high)) if i < keep.get(key, NO_ID)} if keep else set()
            texts.append(_kept(raw, gone))
            lines.append(len(raw))
            dropped.append(len(gone))
        return pa.table([pa.array(texts, pa.string()) if c == "text" else table.column(c) for c in names] + [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    return packed.select("block", "body").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(apply, schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
