"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-cased runs of letters and digits joined by single spaces. An item of m characters may
differ by ``m // EDIT_SHARE`` edits; split into one piece more than that, at least one piece of any match is exact. One
Aho-Corasick pass finds all pieces of all items in a text; around each, Myers' bit-parallel distance decides, and gives the
best place. Items under ``LEAST_CHARS`` characters match exactly and as whole words only; items without letters or digits match
nothing.

Items are taken in blocks of at most ``BLOCK_BYTES`` of text, each block shipped once to the tasks that scan all documents, so
a large benchmark costs more passes, not more memory. Null and empty texts match nothing; items that repeat a text match
each; rows that repeat a doc_id are reported each. Other columns of documents pass through ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import small_batches

EDIT_SHARE = 12
LEAST_CHARS = 24
BLOCK_BYTES = 8 << 20
_RUN = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    return " ".join(_RUN.findall((text or "").lower()))


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of ``text``, and the end of the first such substring."""
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = ((eq & up) + up ^ up) | eq
        plus, minus = down | ~(xh | up), up & xh
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1, minus << 1
        up, down = (minus | ~(xv | plus)) & full, plus & xv & full
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    def __init__(self, rows: list[tuple]):
        self.items, pieces = [], {}
        for item_id, text in rows:
            t = normal(text)
            if not t:
                continue
            k, errors = len(self.items), len(t) // EDIT_SHARE if len(t) >= LEAST_CHARS else 0
            self.items.append((item_id, t, errors, masks_of(t), masks_of(t[::-1])))
            cuts = [len(t) * i // (errors + 1) for i in range(errors + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(t[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton() if pieces else None
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str | None, first_only: bool = False) -> Iterator[tuple]:
        """(item_id, distance, start, end) of the best place of each item within its budget."""
        own = normal(text)
        if not self.automaton or not own:
            return
        best: dict[int, tuple] = {}
        done: dict[tuple, int] = {}
        for last, (size, uses) in self.automaton.iter(own):
            for k, at in uses:
                item_id, t, errors, forward, backward = self.items[k]
                start = last - size + 1 - at
                if errors == 0:
                    if len(t) >= LEAST_CHARS or (start == 0 or own[start - 1] == " ") and own[start + len(t) : start + len(t) + 1] in ("", " "):
                        best.setdefault(k, (0, start, start + len(t)))
                    continue
                slot = (k, start // (errors + 1))
                if slot in done and abs(done[slot] - start) <= errors or k in best and best[k][0] == 0:
                    continue
                done[slot] = start
                lo = max(0, start - 2 * errors)
                d, end = myers(forward, len(t), own[lo : start + len(t) + 2 * errors])
                if d <= errors and (k not in best or d < best[k][0]):
                    end += lo
                    _, back = myers(backward, len(t), own[max(0, end - len(t) - errors) : end][::-1])
                    best[k] = (d, end - back, end)
            if first_only and best:
                break
        for k in sorted(best):
            yield self.items[k][0], *best[k]


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    small_batches(benchmark.sparkSession)
    rows = benchmark.select("item_id", "text")
    size = rows.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // block_bytes))
    for b in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield sorted(((r[0], r[1]) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, distance, start, end (in the compared text) of each item's best place in each document."""
    out, kind = None, docs.schema["doc_id"].dataType.simpleString()
    item = benchmark.schema["item_id"].dataType.simpleString()
    for rows in blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def scan(batches, shared=shared):
            items = Items(shared.value)
            for batch in batches:
                found = [(i, *m) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for m in items.matches(t)]
                cols = [*zip(*found)] or [[]] * 5
                kinds = [batch.schema.field("doc_id").type] + [None] + [pa.int64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t or (pa.int64() if item == "bigint" else None)) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "distance", "start", "end"])

        own = docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, item_id {item}, distance long, start long, end long")
        out = own if out is None else out.unionByName(own)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without those in which any item occurs."""
    for rows in blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def keep(batches, shared=shared):
            items = Items(shared.value)
            for batch in batches:
                yield batch.filter(pa.array([not any(True for _ in items.matches(t, True)) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
