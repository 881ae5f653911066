"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text, one on what toxic text says far more often than ordinary text
does (words and word beginnings). A window is a word with the space before it, written with every byte ``STRETCH`` times,
so that lengths, which are whole bytes, resolve a match of a few letters. Each window is compressed with either dictionary;
its saving is the ordinary length less the toxic one. How many windows of a document save at least each of several bars,
and the largest saving, are its features; a logistic curve calibrated on the labelled sample turns them into a score.

Training takes at most ``toxic`` and ``ordinary`` labelled documents of either class, by seeded hash of the id, and of these
only texts of up to ``MOST_CHARS``; scoring reads every whole text. Null and empty texts have no window and get the score of no saving.
Conflicting labels of one doc_id count as toxic; repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewright.llm.common import chunks, held_out, smallest_hashed, text_buffers

STRETCH = 2
CHUNK = 1 << 19
MOST_CHARS = 1 << 20
DICT_BYTES = 4 << 10
SAMPLE_WORDS = 6
BARS = (3, 4, 5, 7, 9, 11)
PARAMS = zstandard.ZstdCompressionParameters.from_level(8, window_log=18, min_match=6, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False)
#: Toxic units: bytes of a word beginning, how much likelier in toxic text, share of the toxic sample.
SHORTEST, LONGEST, ODDS, LEAST_SHARE = 4, 12, 8.0, 0.008
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Punctuation and symbols of ASCII become spaces, so that a word is the same wherever it stands.
_FOLD = _LOWER.copy()
_FOLD[[i for i in range(128) if not chr(i).isalnum()]] = 32


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the words of texts in folded bytes; a space before a word is part of it."""
    word = data != 32
    starts, ends = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    starts[offsets], ends[offsets] = True, True
    first = np.flatnonzero(word & (starts[:-1] | ~np.concatenate([[False], word[:-1]])))
    last = np.flatnonzero(word & (ends[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    row = np.searchsorted(offsets, first, "right") - 1
    return np.maximum(first - 1, offsets[row]), last, row


class Model:
    """Raw dictionary contents and the logistic curve."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic, self.weights, self.scale = ordinary, toxic, np.zeros(len(BARS) + 2), (np.zeros(len(BARS) + 1), np.ones(len(BARS) + 1))
        self._made = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def _packers(self):
        if self._made is None:
            self._made = [zstandard.ZstdCompressor(compression_params=PARAMS, **({"dict_data": zstandard.ZstdCompressionDict(np.repeat(np.frombuffer(d, np.uint8), STRETCH).tobytes(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if len(d) >= 8 else {})) for d in (self.ordinary, self.toxic)]
        return self._made

    def _sizes(self, packer, data: bytes, segments: np.ndarray) -> np.ndarray:
        out = packer.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments.tobytes()), threads=1)
        return np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out)) if not hasattr(out, "segments") else np.frombuffer(out.segments(), np.uint64).reshape(-1, 2)[:, 1].astype(np.int64)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text, how many windows reach each bar (log) and the largest saving."""
        folded, n = _FOLD[data], len(offsets) - 1
        a, b, r = windows(folded, offsets)
        out = np.zeros((n, len(BARS) + 1))
        if not len(a):
            return out
        segments, raw = np.stack([a, b - a], 1).astype(np.uint64) * np.uint64(STRETCH), np.repeat(folded, STRETCH).tobytes()
        plain, toxic = (self._sizes(p, raw, segments) for p in self._packers())
        saved = plain - toxic
        for k, bar in enumerate(BARS):
            out[:, k] = np.log1p(np.bincount(r[saved >= bar], minlength=n))
        np.maximum.at(out[:, -1], r, saved)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(x)), (x - self.scale[0]) / self.scale[1]]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Ridge logistic regression by Newton's method."""
        self.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        z, w = np.column_stack([np.ones(len(x)), (x - self.scale[0]) / self.scale[1]]), np.zeros(len(BARS) + 2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), z.T @ (p - y) + 0.1 * w)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w


def _folded(text: str) -> bytes:
    return _FOLD[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].tobytes()


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary, or the samples themselves if they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def _heads(word: bytes) -> set[bytes]:
    return {word, *(word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1))}


def _count_heads(docs: list[list[bytes]], only: set[bytes] | None = None) -> Counter:
    """Words and word beginnings (of ``only``) by distinct pairs of a word and the one before it, so that copies and set phrases count once."""
    seen, out = set(), Counter()
    starts = None if only is None else {x[:SHORTEST] for x in only}
    for d in docs:
        for pair in zip([b"", *d], d):
            if (starts is None or pair[1][:SHORTEST] in starts) and (h := hash(pair)) not in seen:
                seen.add(h)
                out.update(_heads(pair[1]) if only is None else _heads(pair[1]) & only)
    return out


def toxic_units(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Words and word beginnings used at least ODDS times as often in toxic texts, rarest first; none begins with another."""
    own = {x: n for x, n in _count_heads(toxic).items() if n >= max(4, LEAST_SHARE * len(toxic))}
    other, n_own, n_other = _count_heads(ordinary, set(own)), sum(map(len, toxic)), sum(map(len, ordinary))
    odd = {x for x, n in own.items() if n / max(1, n_own) >= ODDS * (other[x] + 0.5) / max(1, n_other)}
    whole = {x for x in odd if not any(y.startswith(x) and len(y) == len(x) + 1 and own[y] >= 0.8 * own[x] for y in odd)}
    first = [x for x in whole if not any(x[:n] in whole for n in range(1, len(x)))]
    return sorted(first, key=lambda x: (own[x], x))


def build(texts: list[str], labels: list[int]) -> Model:
    docs = [_folded(t).split() for t in texts]
    by = {y: [d for d, l in zip(docs, labels) if l == y] for y in (0, 1)}
    units = toxic_units(by[1], by[0])
    plain = [b" ".join(d[i : i + SAMPLE_WORDS]) for d in by[0] for i in range(0, len(d), SAMPLE_WORDS)]
    toxic = b"".join(b" " + u for u in units)[-DICT_BYTES:]  # the likeliest last, where offsets are shortest
    model = Model(_dictionary(plain, DICT_BYTES), toxic)
    del docs, by, plain
    if texts:
        model.fit(np.concatenate([_features_of(model, texts[i : i + 200]) for i in range(0, len(texts), 200)]), np.array(labels, float))
    return model


def _features_of(model: Model, texts: list[str]) -> np.ndarray:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return model.features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))


def train(docs: DataFrame, labels: DataFrame, toxic: int = 1200, ordinary: int = 3000, seed: int = 5) -> Model:
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = {y: v[: toxic if y else ordinary] for y, v in smallest_hashed(own, "toxic", max(toxic, ordinary), seed, groups=2).items()}
    label = {i: int(y) for y, v in ids.items() for i in v}
    if not label:
        return Model(b"", b"")
    rows = docs.where(F.col("doc_id").isin(list(label)) & F.col("text").isNotNull() & (F.length("text") <= MOST_CHARS)).select("doc_id", "text").collect()
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    model = build([r[1] for r in rows], [label[r[0]] for r in rows])
    sizes, held = {int(r[0]): r[1] for r in own.groupBy("toxic").count().collect()}, Counter(label[r[0]] for r in rows)
    if held[0] and held[1]:  # classes are sampled alike; the curve is for their shares of all labels
        model.weights[0] += np.log(sizes[1] * held[0] / (sizes[0] * held[1]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1)."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), [c for c in docs.columns if c != "score"]

    def run(batches):
        m = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            out = np.zeros(batch.num_rows)
            for i, j in chunks(offsets, CHUNK):
                out[i:j] = m.scores(m.features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(out)], [*names, "score"])

    return docs.select(*names).mapInArrow(run, T.StructType([docs.schema[c] for c in names] + [T.StructField("score", T.DoubleType())]))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
