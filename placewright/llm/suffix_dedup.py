"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (in a smaller doc_id, or in the same text before) goes.

1. Discarding by hash. A string's anchor is its ``GRAM``-byte substring of least hash, so equal strings have equal anchors in the same
   place. Consecutive strings with one anchor form a snippet of some 135 bytes. Each block counts its snippets by the anchor's hash; an
   anchor found once in all proves its strings unique, and they go no further. Nothing is removed on a hash.
2. Shards. The bytes of all other snippets are dealt to shards by anchor, so equal strings meet in one shard. An anchor with more than
   ``SPLIT`` different snippets (summed over blocks) is dealt to several, a block's snippets never apart. A shard builds the suffix array of its different snippets by
   Larsson-Sadakane refinement (ranks of 8 bytes, doubled while groups are unsorted) and Kasai's common prefixes (in step over all
   snippets). Runs of common prefixes of ``LENGTH`` or more are equal strings; all their places but the earliest go.
3. Merging. Strings of split anchors may recur in other shards. Each shard gives them in the order of its suffix array with their
   least doc_id; each list is cut at common bounds, the pieces of a range are merged by binary search, and a shard whose least doc_id isn't the least of all
   removes its first places too.

Rows are first written in blocks of some ``BLOCK`` bytes, packed, and a place is a block and a position in its texts. Blocks meet
their snippets and their verdicts by cogroups; nothing of the corpus is shipped to all tasks or to the driver but counts, and there is
one way for every size.

Every row is a text of its own. Null and empty texts have no bytes. Of rows of one doc_id (or of null
ids, which count as the smallest) neither is earlier than the other; each is judged against smaller ids and its own text. ``dedup``
decodes what is left, replacing cut code points, and passes other columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewright.llm.common import blocks, chunks, cut, numbers, parts, text_buffers, unpacked
from placewright.llm.perfect_hash import mix
from placewright.llm.shingles import inverses, powers

LENGTH = 100
GRAM = 24
WINDOW = LENGTH - GRAM + 1
SEGMENT = 1 << 18
BLOCK = 4 << 20
SHARD = 1 << 20
SPLIT = 4000
RANGE, PREFIX = 16 << 20, 16
NO_ID = -(1 << 63)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64), 77)
_PLACE = np.uint64((1 << 24) - 1)


def window_least(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of ``w`` values."""
    n = len(key)
    a = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    a[:n] = key
    a = a.reshape(-1, w)
    before = np.minimum.accumulate(a, 1).ravel()
    after = np.minimum.accumulate(a[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def snippets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes of anchor and bytes, first and last string start of every snippet, in order; strings stay within texts."""
    out: list[tuple] = []
    n = len(data)
    for lo in range(0, max(0, n - LENGTH + 1), SEGMENT):
        hi = min(n, lo + SEGMENT + LENGTH - 1)
        own = data[lo:hi]
        m = len(own) - LENGTH + 1
        if m <= 0:
            break
        start = np.arange(m, dtype=np.int64)
        row = np.searchsorted(offsets, start + lo, "right") - 1
        inside = start + lo + LENGTH <= offsets[row + 1]
        if not inside.any():
            continue
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[own] * powers(len(own)))])
            back = inverses(len(own))
            h = mix((total[GRAM:] - total[:-GRAM]) * back[: len(own) - GRAM + 1], 5)
            at = (window_least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), WINDOW) & _PLACE).astype(np.int64)[:m]
            i = start[inside]
            a = at[i]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (i[1:] != i[:-1] + 1)])
            i0, i1, a = i[new], i[np.concatenate([new[1:], [True]])], a[new]
            s = mix((total[i1 + LENGTH] - total[i0]) * back[i0] + (i1 - i0).astype(np.uint64), 6)
        out.append((h[a], s, i0 + lo, i1 + lo))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _blobs(flat: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary values: the rows of ``flat`` between edges, without copying."""
    flat = np.ascontiguousarray(flat)
    width = flat.itemsize * (flat.shape[1] if flat.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int32)), pa.py_buffer(flat)])


def _unpack(column, kind, width: int = 1) -> np.ndarray:
    data = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.frombuffer(text_buffers(data)[0].tobytes(), kind)
    return flat.reshape(-1, width) if width > 1 else flat


def _edges(sorted_: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    new = np.ones(len(sorted_) + 1, bool)
    new[1:-1] = sorted_[1:] != sorted_[:-1]
    return np.flatnonzero(new) if len(sorted_) else np.zeros(1, np.int64)


def texts_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return text_buffers(table.column("text").combine_chunks())


def block_snippets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a whole block, as ``snippets``."""
    found = [(h, s, i0 + offsets[i], i1 + offsets[i]) for i, j in chunks(offsets, SEGMENT) for h, s, i0, i1 in [snippets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]]
    return tuple(np.concatenate(x) for x in zip(*found))


def anchors(packed: DataFrame) -> DataFrame:
    """h, block, n: how many snippets with an anchor a block has, k: how many of them differ."""

    def run(batches):
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body")):
                h, s, _, _ = block_snippets(*texts_of(unpacked(body)))
                order = np.lexsort((s, h))
                h, s = h[order], s[order]
                edges, new = _edges(h), np.ones(len(h), np.int64)
                new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
                k = np.add.reduceat(new, edges[:-1]) if len(h) else new
                yield pa.RecordBatch.from_arrays([pa.array(h[edges[:-1]].view(np.int64)), pa.array(np.full(len(k), block)), pa.array(np.diff(edges)), pa.array(k)], ["h", "block", "n", "k"])

    return packed.select("block", "body").mapInArrow(run, "h long, block long, n long, k long")


def recurring(found: DataFrame, shards: int, split: int) -> DataFrame:
    """block, h, shard, open (whether the anchor is split) of anchors that recur. A frequent anchor has a row a block at most."""
    whole = W.partitionBy("h")
    before = F.sum("k").over(whole.orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    found = found.select("*", F.sum("n").over(whole).alias("all"), F.sum("k").over(whole).alias("unlike"), F.coalesce(before, F.lit(0)).alias("before")).where("all > 1")
    sub = F.when(F.col("unlike") > split, F.floor(F.col("before") / split)).otherwise(0)
    return found.select("block", "h", F.pmod(F.xxhash64("h", sub), F.lit(shards)).alias("shard"), (F.col("unlike") > split).cast("long").alias("open"))


_OF_BYTES = (("size", np.int32), ("open", np.int8))
_OF_PLACE = (("which", np.int32), ("doc", np.int64), ("row", np.int32), ("spot", np.int64))


def snippet_rows(packed: DataFrame, at: DataFrame) -> DataFrame:
    """shard, block, k, n, body: of each shard's snippets in a block the k different ones and their n places (doc_id, row, spot), compressed."""

    def run(texts: pa.Table, at: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if at.num_rows:
            table = unpacked(texts.column("body")[0])
            data, offsets = texts_of(table)
            docs, pack, raw = table.column("doc_id").fill_null(NO_ID).to_numpy(), zstandard.ZstdCompressor(level=1), data.tobytes()
            wanted, shard, open_ = (at.column(c).to_numpy() for c in ("h", "shard", "open"))
            order = np.argsort(wanted)
            wanted, shard, open_ = wanted[order], shard[order], open_[order]
            h, _, i0, i1 = block_snippets(data, offsets)
            k = np.minimum(np.searchsorted(wanted, h.view(np.int64)), len(wanted) - 1)
            hit = np.flatnonzero(wanted[k] == h.view(np.int64))
            hit = hit[np.argsort(shard[k[hit]], kind="stable")]
            k, i0, i1 = k[hit], i0[hit], i1[hit]
            row, spot, edges = np.searchsorted(offsets, i0, "right") - 1, i0 << 7 | (i1 - i0), _edges(shard[k])
            for a, b in zip(edges, edges[1:]):
                different: dict[bytes, int] = {}
                which = [different.setdefault(raw[x : y + LENGTH], len(different)) for x, y in zip(i0[a:b].tolist(), i1[a:b].tolist())]
                first = np.unique(which, return_index=True)[1] + a
                own = (np.array([len(x) for x in different]), open_[k[first]], np.array(which), docs[row[a:b]], row[a:b], spot[a:b])
                body = b"".join([x.astype(kind).tobytes() for (_, kind), x in zip((*_OF_BYTES, *_OF_PLACE), own)] + list(different))
                out.append((int(shard[k[a]]), int(texts.column("block")[0].as_py()), len(different), int(b - a), pack.compress(body)))
        cols = [*zip(*out)] or [[]] * 5
        return pa.table([pa.array(c, kind) for c, kind in zip(cols, (*[pa.int64()] * 4, pa.binary()))], ["shard", "block", "k", "n", "body"])

    return packed.select("block", "body").groupBy("block").cogroup(at.groupBy("block")).applyInArrow(run, "shard long, block long, k long, n long, body binary")


def read_snippets(t: pa.Table) -> tuple[list[bytes], np.ndarray, dict]:
    """Different snippets of a shard, whether each is open, and of all places which it is, block, doc, row and spot."""
    unpack, different, open_ = zstandard.ZstdDecompressor(), {}, []
    cols: dict = {c: [] for c, _ in (*_OF_BYTES, *_OF_PLACE)}
    for k, n, body in zip(*(t.column(c).to_pylist() for c in ("k", "n", "body"))):
        raw, at = unpack.decompress(body), 0
        for fields, count in ((_OF_BYTES, k), (_OF_PLACE, n)):
            for c, kind in fields:
                cols[c].append(np.frombuffer(raw, kind, count, at))
                at += count * np.dtype(kind).itemsize
        ends = at + np.cumsum(cols["size"][-1], dtype=np.int64)
        names = np.array([different.setdefault(raw[b - size : b], len(different)) for b, size in zip(ends.tolist(), cols["size"][-1].tolist())], np.int64)
        cols["which"][-1] = names[cols["which"][-1]]
        open_.append(np.stack([names, cols["open"][-1]]))
    known = np.zeros(len(different), bool)
    for names, flag in open_:
        known[names[flag > 0]] = True
    out = {c: np.concatenate(cols[c]) for c, _ in _OF_PLACE} | {"block": np.repeat(t.column("block").to_numpy(), t.column("n").to_numpy())}
    return list(different), known, out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """All suffixes in order, by refinement of unsorted groups. Kasai's step needs the whole order, not one to LENGTH."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n]
    order = np.argsort(key)
    sorted_ = key[order]
    head = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    rank = np.empty(n + 1, np.int64)
    first = np.flatnonzero(head)
    rank[order] = first[np.cumsum(head) - 1]
    rank[n] = -1
    h = 8
    while True:
        size = np.diff(np.concatenate([first, [n]]))
        open_ = np.repeat(size > 1, size)  # places in the order whose group is unsorted
        at = np.flatnonzero(open_)
        if not len(at):
            break
        own = order[at]
        past = own + h - n  # a text that ends before stands first, the shortest foremost
        group, next_ = rank[own], np.where(past >= 0, -1 - past, rank[np.minimum(own + h, n)])
        move = np.argsort(group * (n + h + 2) + next_ + h + 1)
        own, group, next_ = own[move], group[move], next_[move]
        order[at] = own
        head[at] = np.concatenate([[True], (group[1:] != group[:-1]) | (next_[1:] != next_[:-1])])
        first = np.flatnonzero(head)
        rank[order[at]] = first[np.searchsorted(first, at, "right") - 1]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the order, the common prefix with the place before, up to LENGTH; by Kasai in step over all snippets."""
    n = len(data)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    out, carry = np.zeros(n, np.int64), np.zeros(len(starts), np.int64)
    for step in range(int(lens.max(initial=0))):
        live = np.flatnonzero(lens > step)
        i = starts[live] + step
        j = order[np.maximum(place[i] - 1, 0)]
        has = place[i] > 0
        size = np.maximum(carry[live] - 1, 0)
        size[~has] = 0
        room = np.minimum(np.minimum(n - i, n - j), LENGTH)
        size = np.minimum(size, room)
        grow = np.flatnonzero(has)
        while len(grow):
            g = grow[size[grow] < room[grow]]
            g = g[data[i[g] + size[g]] == data[j[g] + size[g]]]
            size[g] += 1
            grow = g
        out[place[i]] = size
        carry[live] = size
    return out


def runs_of(block: np.ndarray, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """block and spot of runs of starts, each of at most 128."""
    order = np.lexsort((at, block))
    block, at = block[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (block[1:] != block[:-1]) | (np.diff(at) > 1)
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) if len(at) else at
    new |= (np.arange(len(at)) - first) % 128 == 0
    edges = np.append(np.flatnonzero(new), len(at))
    return pa.array(block[new]), pa.array(at[new] << 7 | (np.diff(edges) - 1))


def equal_strings(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of different snippets: their bytes, starts, and of each byte's string its run of equal strings and whether it is whole; runs are in order."""
    lens = np.array([len(b) for b in blobs], np.int64)
    starts = np.cumsum(lens) - lens
    data = np.frombuffer(b"".join(blobs), np.uint8)
    order = suffix_array(data)
    lcp = common_prefixes(data, starts, lens, order)
    run = np.empty(len(data), np.int64)
    run[order] = np.cumsum(lcp < LENGTH) - 1
    return data, starts, lens, run


_JUDGED = "block long, spot long, shard long, strings binary, least binary, run binary, blocks binary, starts binary"


def judged(rows: DataFrame) -> DataFrame:
    """block, spot of starts that go; of split anchors a row a shard with strings in order, their least doc_id, and the places that have it."""

    def run(t: pa.Table) -> pa.Table:
        different, open_, cols = read_snippets(t)
        which, block, doc, start = cols["which"], cols["block"], cols["doc"], cols["spot"] >> 7
        data, starts, lens, runs = equal_strings(different)
        n = lens[which] - LENGTH + 1  # strings of each place
        place = np.repeat(np.arange(len(which)), n)
        inside = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        own = runs[starts[which[place]] + inside]
        least = np.full(len(data), np.iinfo(np.int64).max)
        np.minimum.at(least, own, doc[place])
        again = doc[place] > least[own]
        # in the least doc_id's texts an earlier start counts too: only texts with several places here can have one
        order = np.lexsort((cols["row"], block))
        same = (block[order][1:] == block[order][:-1]) & (cols["row"][order][1:] == cols["row"][order][:-1])
        shared, text = np.zeros(len(order), bool), np.zeros(len(order), np.int64)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        text[order] = np.cumsum(np.concatenate([[True], ~same]))
        few = np.flatnonzero(~again & shared[place])
        at = start[place] + inside
        few = few[np.lexsort((at[few], text[place[few]], own[few]))]
        again[few[1:]] |= (own[few[1:]] == own[few[:-1]]) & (text[place[few[1:]]] == text[place[few[:-1]]])
        gone, spot = runs_of(block[place[again]], at[again])
        out = [gone, spot, pa.nulls(len(gone), pa.int64()), *[pa.nulls(len(gone), pa.binary())] * 5]
        rest = np.flatnonzero(~again & open_[which][place])
        if len(rest):
            rest = rest[np.argsort(own[rest], kind="stable")]
            keys, first, number = np.unique(own[rest], return_index=True, return_inverse=True)
            where = starts[which[place[rest[first]]]] + inside[rest[first]]
            more = [x.tobytes() for x in (data[where[:, None] + np.arange(LENGTH)], least[keys], number.astype(np.int64), block[place[rest]], at[rest])]
            last = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([t.column("shard")[0].as_py()]), *[pa.array([x], pa.binary()) for x in more]]
            out = [pa.concat_arrays([x, y]) for x, y in zip(out, last)]
        return pa.table(out, [c.split()[0] for c in _JUDGED.split(", ")])

    return rows.groupBy("shard").applyInArrow(run, _JUDGED)


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Strings in order and their least doc_id, of sorted runs of such; two by two, by binary search."""
    while len(runs) > 1:
        out = []
        for (s, a), (t, b) in zip(runs[::2], runs[1::2]):
            at = np.searchsorted(s, t)
            same = s[np.minimum(at, len(s) - 1)] == t
            a = a.copy()
            a[at[same]] = np.minimum(a[at[same]], b[same])
            out.append((np.insert(s, at[~same], t[~same]), np.insert(a, at[~same], b[~same])))
        runs = out + (runs[-1:] if len(runs) % 2 else [])
    return runs[0]


def merged(judged_: DataFrame) -> DataFrame:
    """block, spot: places of split anchors' strings that other shards have in a smaller doc_id."""
    held = judged_.where("shard IS NOT NULL")

    total = held.agg(F.sum(F.length("strings"))).first()[0]
    if not total:
        return held.select("block", "spot")
    ranges_ = max(parts(judged_.sparkSession), total // RANGE)
    step = max(1, total // LENGTH // (ranges_ * 32))

    def sample(batches):
        for batch in batches:
            found = [x for s in batch.column("strings").to_pylist() for x in np.frombuffer(s, f"S{LENGTH}")[:: -step].astype(f"S{PREFIX}").tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["s"])

    seen = sorted(bytes(r[0]) for r in held.select("strings").mapInArrow(sample, "s binary").collect())  # prefixes, some 32 a range
    bounds = np.array(sorted({seen[len(seen) * i // ranges_] for i in range(1, ranges_)}), f"S{PREFIX}")

    def cut_up(batches):
        for batch in batches:
            for shard, s, least in zip(batch.column("shard").to_pylist(), batch.column("strings").to_pylist(), batch.column("least").to_pylist()):
                edges = [0, *np.searchsorted(np.frombuffer(s, f"S{LENGTH}"), bounds.astype(f"S{LENGTH}")).tolist(), len(s) // LENGTH]
                rows = [(i, shard, a, s[a * LENGTH : b * LENGTH], least[8 * a : 8 * b]) for i, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["range", "shard", "first", "strings", "least"])

    def merge(t: pa.Table) -> pa.Table:
        pieces = [(np.frombuffer(s, f"S{LENGTH}"), np.frombuffer(x, np.int64)) for s, x in zip(t.column("strings").to_pylist(), t.column("least").to_pylist())]
        all_, least = merge_runs(pieces)
        late = [(first + np.flatnonzero(least[np.searchsorted(all_, s)] < own)).tobytes() for (s, own), first in zip(pieces, t.column("first").to_pylist())]
        return pa.table([t.column("shard"), pa.array(late, pa.binary())], ["shard", "late"])

    pieces = held.select("shard", "strings", "least").mapInArrow(cut_up, "range long, shard long, first long, strings binary, least binary")
    late = pieces.groupBy("range").applyInArrow(merge, "shard long, late binary")

    def resolve(own: pa.Table, late: pa.Table) -> pa.Table:
        run, block, start = (_unpack(own.column(c), np.int64) for c in ("run", "blocks", "starts"))
        hit = np.isin(run, _unpack(late.column("late"), np.int64) if late.num_rows else run[:0])
        return pa.table(list(runs_of(block[hit], start[hit])), ["block", "spot"])

    return held.select("shard", "run", "blocks", "starts").groupBy("shard").cogroup(late.groupBy("shard")).applyInArrow(resolve, "block long, spot long")


def removed(docs: DataFrame, split: int = SPLIT, most: int = BLOCK) -> DataFrame:
    """``docs`` with text as bytes in ``kept``, and ``n_bytes``, ``n_removed``, ``n_spans``."""
    names = [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans")]
    packed = blocks(docs.select(*names), "text", most)
    shards = max(1, 4 * parts(docs.sparkSession), (packed.agg(F.sum("size")).first()[0] or 0) // SHARD)
    verdicts = cut(judged(snippet_rows(packed, recurring(anchors(packed), shards, split))))
    gone = verdicts.where("spot IS NOT NULL").select("block", "spot").union(merged(verdicts))
    counts = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("kept", T.BinaryType()), *counts])

    def finish(texts: pa.Table, gone: pa.Table) -> pa.Table:
        rows = unpacked(texts.column("body")[0])
        data, offsets = texts_of(rows)
        spot, mark = numbers(gone, "spot"), np.zeros(len(data) + LENGTH + 129, np.int32)
        np.add.at(mark, spot >> 7, 1)
        np.add.at(mark, (spot >> 7) + (spot & 127) + LENGTH, -1)
        bad = np.cumsum(mark)[: len(data)] > 0
        first = bad.copy()
        first[1:] &= ~bad[:-1]
        at = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[at] = bad[at]  # spans end with their text
        count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
        n_gone, size = count(bad), np.diff(offsets)
        kept = _blobs(data[~bad], np.concatenate([[0], np.cumsum(size - n_gone)]))
        return pa.table([rows.column(c) for c in names] + [kept, pa.array(size), pa.array(n_gone), pa.array(count(first))], [*names, "kept", *[f.name for f in counts]])

    return packed.select("block", "body").groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(finish, schema)


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the text that is left, and counts."""
    out = removed(docs)
    return out.select(*[F.decode(F.col("kept"), "UTF-8").alias(c) if c == "text" else F.col(c) for c in docs.columns], "n_bytes", "n_removed", "n_spans")


def digest(docs: DataFrame) -> DataFrame:
    return removed(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
