"""Language identification by prediction by partial matching (PPM, escape method C) over bytes.

Each language has a context tree of orders 4 to 0, held as sorted arrays of n-gram counts. A byte costs the
escapes from the longest known context down to the first that has seen it, then its own code; below order 0 all
256 bytes are equally likely. Statistics are frozen after training, so the cost of a byte depends only on itself
and the four bytes before it, and each distinct 5-gram is costed once a worker. The language with the
shortest code wins, ties by name.

Training takes at most ``per_language`` (default 200) labelled documents a language, by seeded hash of the id;
prediction reads every whole text. Null or letterless text gives ``und`` with score 0, as does an untrained model.
Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import chunks, held_out, smallest_hashed, text_buffers

ORDER = 4
CHUNK = 1 << 18
CACHE = 400_000
#: Bits a byte of difference between two languages that make odds of 2 ** SHARP.
SHARP = 40.0
_LETTER = re.compile(r"[^\W\d_]")


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every byte, itself (lowest 8 bits) and the four before it; before a text come newlines."""
    lens = np.diff(offsets)
    at = np.arange(len(data)) + ORDER * (np.repeat(np.arange(len(lens)), lens) + 1)
    padded = np.full(len(data) + ORDER * (len(lens) + 1), 10, np.uint64)
    padded[at] = data
    out = padded[at]
    for back in range(1, ORDER + 1):
        out |= padded[at - back] << np.uint64(8 * back)
    return out


class Tree:
    """Frozen PPM statistics of one language."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels = []
        for k in range(ORDER + 1):
            full, inv = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(inv, counts, len(full))
            ctx, inv = np.unique(full >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(inv, n, len(ctx)), np.bincount(inv, minlength=len(ctx))
            base = np.log2(total + kinds)
            self.levels.append((full, base[inv] - np.log2(n), ctx, base - np.log2(kinds)))

    def bits(self, g: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(g)), np.arange(len(g))
        for k in range(ORDER, -1, -1):
            full, code, ctx, escape = self.levels[k]
            if not len(full) or not len(open_):
                continue
            own = g[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            i = np.minimum(np.searchsorted(full, own), len(full) - 1)
            hit = full[i] == own
            out[open_[hit]] += code[i[hit]]
            open_, own = open_[~hit], own[~hit] >> np.uint64(8)
            i = np.minimum(np.searchsorted(ctx, own), len(ctx) - 1)
            known = ctx[i] == own
            out[open_[known]] += escape[i[known]]
        out[open_] += 8.0
        return out


class Model:
    def __init__(self, counts: dict):
        self.names = sorted(counts)
        self.trees = [Tree(*counts[x]) for x in self.names]
        self._keys, self._bits = np.zeros(0, np.uint64), np.zeros((len(self.names), 0))

    def __getstate__(self):
        return self.names, self.trees

    def __setstate__(self, state):
        self.names, self.trees = state
        self._keys, self._bits = np.zeros(0, np.uint64), np.zeros((len(self.names), 0))

    def _costs(self, u: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self._keys, u)
        known = np.zeros(len(u), bool)
        inside = at < len(self._keys)
        known[inside] = self._keys[at[inside]] == u[inside]
        new = u[~known]
        if len(new):
            bits = np.stack([t.bits(new) for t in self.trees])
            if len(self._keys) + len(new) > CACHE:
                out = np.empty((len(self.trees), len(u)))
                out[:, known], out[:, ~known] = self._bits[:, at[known]], bits
                self._keys, self._bits = new, bits
                return out
            where = np.searchsorted(self._keys, new)
            self._keys, self._bits = np.insert(self._keys, where, new), np.insert(self._bits, where, bits, axis=1)
            at = np.searchsorted(self._keys, u)
        return self._bits[:, at]

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text (column) under each language (row)."""
        if not len(data):
            return np.zeros((len(self.trees), len(offsets) - 1))
        u, inv = np.unique(grams(data, offsets), return_inverse=True)
        costs = self._costs(u)
        out = np.empty((len(self.trees), len(offsets) - 1))
        for i, row in enumerate(costs):
            total = np.concatenate([[0.0], np.cumsum(row[inv])])
            out[i] = total[offsets[1:]] - total[offsets[:-1]]
        return out


def count_grams(batches):
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        names = batch.column("lang").to_pylist()
        for i, j in chunks(offsets, CHUNK):
            for name in {*names[i:j]}:
                for d in (d for d in range(i, j) if names[d] == name):
                    own = data[offsets[d] : offsets[d + 1]]
                    u, n = np.unique(grams(own, np.array([0, len(own)])), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(u), pa.string()), pa.array(u.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def train(docs: DataFrame, per_language: int = 200, seed: int = 11) -> Model:
    """Learns from documents with a non-null ``lang`` and text that aren't held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = [x for v in smallest_hashed(known.select("doc_id", "lang"), "lang", per_language, seed).values() for x in v]
    if not ids:
        return Model({})
    rows = known.where(F.col("doc_id").isin(ids)).select("lang", "text").mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return Model({name: (g["gram"].to_numpy().astype(np.uint64), g["n"].to_numpy().astype(float)) for name, g in rows.groupby("lang")})


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = data | 32
    total = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    found = total[offsets[1:]] > total[offsets[:-1]]
    for d in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[d] = _LETTER.search(data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")) is not None
    return found


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text and any others) with ``lang_pred``, ``score`` and ``bits_per_byte`` of the winner."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]

    def score(batches):
        m = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            n = batch.num_rows
            names, best, rate = np.full(n, "und", object), np.zeros(n), np.zeros(n)
            for i, j in chunks(offsets, CHUNK):
                own, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                ok = _letters(own, off)
                if not m.trees or not ok.any():
                    continue
                bits = m.code_lengths(own, off)
                win, per = bits.argmin(0), np.maximum(1, np.diff(off))
                odds = np.exp2(-SHARP * np.minimum((bits - bits.min(0)) / per, 20.0))
                names[i:j] = np.where(ok, np.array(m.names, object)[win], "und")
                best[i:j], rate[i:j] = np.where(ok, 1 / odds.sum(0), 0), np.where(ok, bits.min(0) / per, 0)
            cols = [batch.column(c) for c in keep] + [pa.array(names, pa.string()), pa.array(best), pa.array(rate)]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "lang_pred", "score", "bits_per_byte"])

    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    return docs.select(*keep).mapInArrow(score, schema)


def identify(docs: DataFrame, per_language: int = 200) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    out = predict(docs.select("doc_id", "text"), train(docs, per_language))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, per_language: int = 200, least_score: float = 0.3, most_bits: float = 7.0) -> DataFrame:
    """``docs`` without those of no letter, of no clear language or that no learned language describes."""
    out = predict(docs, train(docs, per_language))
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score) & (F.col("bits_per_byte") <= most_bits)).select(*docs.columns)
