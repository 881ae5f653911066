"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

A document's set is its distinct word shingles as 64-bit hashes. Documents of one set are one node. Two nodes link when
100 * overlap >= percent * union, so linked sets x, y overlap in at least percent * (x + y) / (100 + percent) shingles, their
sizes differ by the same share at most, and, under any one order of all shingles, they share one of the first
``size - ceil(percent * size / 100) + 1`` of each (the prefix). The product runs over prefix columns only:

1. Columns in ``HOT`` or more prefixes (common lines and passages), and those as common among the next columns of the documents
   these touch, are put last in the order, and prefixes are taken again.
2. Columns are dealt to blocks by hash; each block multiplies its columns and adds up overlaps of pairs of rows. A pair goes
   on if its prefix overlap plus the rest of the larger set can reach the bound, and is then counted over whole sets.
3. A column that is still hot (large groups of near copies) isn't multiplied out. Its rows are compared with one row of
   each size class, and found links join into components. Rows that hot columns connect are then dealt to row blocks, and
   blocks of rows outside the family's main component are multiplied with all its blocks over whole sets. So every pair that
   could join two components is compared, and no group costs its square unless its members differ.

Components come from alternating large-star and small-star steps over tables; nothing of the corpus goes to the driver but
counts. Hot columns are shipped as an array while at most ``MOST_SHIPPED``, else joined.

Every row is a document of its own, whatever its doc_id, which may repeat or be null: rows are told apart by a number given when
they are first written. Null and empty texts have no shingles, link with nothing and are their own component. A component's id is
the least doc_id of its rows, null only if all are null. Node ids are 64 bits of a set's hash. Other columns pass through ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import chunks, cut, free, numbered, settled, text_buffers
from placewright.llm.perfect_hash import mix
from placewright.llm.shingles import shingle_sets

HOT = 100
MOST_SHIPPED = 1_000_000
BLOCK = 256
CHUNK = 1 << 18


def prefix_size(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def stored_size(n: int, percent: int) -> int:
    p = prefix_size(n, percent)
    return min(n, 2 * p + 8)


def sets(docs: DataFrame, width: int, percent: int, whole: bool = False) -> DataFrame:
    """row, doc_id, n (set size), node, low (its least hashes, or all with ``whole``) of every document. ``docs``: row, doc_id, text."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            rows, ids = batch.column("row"), batch.column("doc_id")
            for i, j in chunks(offsets, CHUNK):
                n, node, low = [], [], []
                for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width):
                    with np.errstate(over="ignore"):
                        h = mix(np.array([mix(s, 7).sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.bitwise_xor.reduce(mix(s, 8), initial=np.uint64(len(s)))]), 9)[0]
                    n.append(len(s))
                    node.append(h)
                    low.append((s if whole else s[: stored_size(len(s), percent)]).tobytes())
                yield pa.RecordBatch.from_arrays([rows.slice(i, j - i), ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(low, pa.binary())], ["row", "doc_id", "n", "node", "low"])

    return docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "row long, doc_id long, n long, node long, low binary")


def prefixes(nodes: DataFrame, percent: int, hot: np.ndarray | None, whole: bool = False, short: bool = False, only: str = "") -> DataFrame:
    """token, node, n of prefixes, hot columns last; ``hot`` is sorted, or each row brings its own ``hots``.

    With ``short``, only the nodes whose stored hashes don't reach (node alone); else all other nodes. ``only``: that column.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(hot) if hot is not None else None
    listed = "hots" in nodes.columns

    def run(batches):
        all_hot = shared.value if shared else None
        for batch in batches:
            node, size = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            data, offsets = text_buffers(batch.column("low"))
            flat, held = np.frombuffer(data.tobytes(), np.uint64), np.diff(offsets) // 8
            row = np.repeat(np.arange(len(held)), held)
            if listed:
                bad = np.zeros(len(flat), bool)
                for k, own in enumerate(batch.column("hots").to_pylist()):
                    if own:
                        at = slice(offsets[k] // 8, offsets[k + 1] // 8)
                        bad[at] = np.isin(flat[at], np.array(own, np.int64).view(np.uint64))
            elif len(all_hot):
                bad = all_hot[np.minimum(np.searchsorted(all_hot, flat), len(all_hot) - 1)] == flat
            else:
                bad = np.zeros(len(flat), bool)
            wanted = prefix_size(size, percent)
            total = np.concatenate([[0], np.cumsum(~bad)])
            base = offsets[:-1] // 8
            good_before = total[:-1] - total[base][row]
            n_good = total[offsets[1:] // 8] - total[base]
            lacking = (n_good < wanted) & (held < size) & (not whole)
            if short:
                yield pa.RecordBatch.from_arrays([pa.array(node[lacking])], ["node"])
                continue
            bad_before = np.arange(len(flat)) - base[row] - good_before
            take = np.where(bad, bad_before < (wanted - n_good)[row], good_before < wanted[row]) & ~lacking[row]
            columns = {"token": flat[take].view(np.int64), "node": node[row[take]], "n": size[row[take]]}
            names = [only] if only else list(columns)
            yield pa.RecordBatch.from_arrays([pa.array(columns[c]) for c in names], names)

    kinds = "node long" if short else f"{only} long" if only else "token long, node long, n long"
    return nodes.select("node", "n", "low", *["hots"] * listed).mapInArrow(run, kinds)


def multiply(columns: DataFrame, percent: int) -> DataFrame:
    """a, b, c, n_a, n_b: overlaps over columns, each of fewer than HOT rows, of pairs whose sizes fit."""

    def product(token, node, n):
        """Pairs within runs of equal tokens, by shifting the block against itself."""
        out = []
        for k in range(1, len(token)):
            same = np.flatnonzero(token[k:] == token[:-k])
            if not len(same):
                break
            x, y = same, same + k
            fits = (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (node[x] != node[y])
            x, y = x[fits], y[fits]
            swap = node[x] > node[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            out.append(np.stack([node[x], node[y], n[x], n[y]], 1))
        return np.concatenate(out) if out else np.zeros((0, 4), np.int64)

    def run(batches):
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            now = [np.concatenate([r, batch.column(c).to_numpy()]) for r, c in zip(rest, ("token", "node", "n"))]
            last = np.searchsorted(now[0], now[0][-1]) if len(now[0]) else 0  # the last run may go on
            rest = [x[last:] for x in now]
            yield block(*[x[:last] for x in now])
        yield block(*rest)

    def block(token, node, n):
        p = product(token, node, n)
        u, c = np.unique(p, axis=0, return_counts=True) if len(p) else (p, np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (u[:, 0], u[:, 1], c, u[:, 2], u[:, 3])], ["a", "b", "c", "n_a", "n_b"])

    dealt = columns.select("token", "node", "n").repartition("token").sortWithinPartitions("token")
    pairs = dealt.mapInArrow(run, "a long, b long, c long, n_a long, n_b long")
    return pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))


def sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def side(df: DataFrame) -> DataFrame:
    """A written table as the side of a join that is shipped if it has few rows."""
    return F.broadcast(df) if df.count() <= MOST_SHIPPED else df


def subset(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (one column of that name); shipped if few, else joined."""
    return df.join(side(ids), key, "left_semi")


@settled
def verify(pairs: DataFrame, leads: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of distinct pairs a, b those that link, by overlap of whole sets."""
    nodes = cut(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
    own = subset(leads, nodes, "node")
    full = cut(whole_sets(docs, own, width, percent).select("node", "low"))

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(full.select(F.col("node").alias("a"), F.col("low").alias("x")), "a").join(full.select(F.col("node").alias("b"), F.col("low").alias("y")), "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct())


@settled
def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (least node of its component) of all nodes with an edge but the roots. ``edges``: a, b."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seal = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    mark = seal(now)
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = cut(small.distinct())
        before, mark = mark, seal(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def whole_sets(docs: DataFrame, leads: DataFrame, width: int, percent: int) -> DataFrame:
    """node, n, low (the whole set) of the nodes of ``leads``."""
    own = cut(leads.select(F.col("lead").alias("row")))
    return sets(subset(docs, own, "row"), width, percent, True).select("node", "n", "low")


def all_columns(nodes: DataFrame) -> DataFrame:
    """token, node of all hashes in ``low``."""

    def run(batches):
        for batch in batches:
            own = [np.frombuffer(x, np.int64) for x in batch.column("low").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), [len(x) for x in own]))], ["token", "node"])

    return nodes.select("node", "low").mapInArrow(run, "token long, node long")


@settled
def block_links(hot_rows: DataFrame, roots: DataFrame, docs: DataFrame, leads: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: roots that some link between their rows joins, among rows that share hot columns.

    Rows that hot columns connect are a family, dealt to blocks of about ``BLOCK`` by hash. Blocks of rows outside the
    family's main component are multiplied with all its blocks.
    """
    chained = hot_rows.join(hot_rows.groupBy("token").agg(F.min("node").alias("b")), "token").select(F.col("node").alias("a"), "b").where("a <> b")
    family = components(chained).select("node", F.col("root").alias("family"))
    rows = hot_rows.select("node").distinct().join(family, "node", "left").join(roots, "node", "left").select("node", F.coalesce("family", "node").alias("family"), F.coalesce("root", "node").alias("root"))
    rows = cut(rows)
    main = rows.groupBy("family", "root").agg(F.count("*").alias("k")).groupBy("family").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.ceil(F.sum("k") / F.lit(float(BLOCK))).cast("int").alias("blocks"), F.count("*").alias("roots")).where("roots > 1")
    rows = rows.join(main, "family").select("node", "family", "root", "main", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    rows = cut(rows)
    full = whole_sets(docs, subset(leads, rows.select("node"), "node"), width, percent)
    packed = cut(rows.join(full.select("node", "low"), "node").groupBy("family", "block", (F.col("root") != F.col("main")).alias("odd")).agg(F.collect_list(F.struct("root", "low")).alias("rows"), F.max("blocks").alias("blocks")))  # about BLOCK rows each
    left = packed.where("odd").select("family", F.col("block").alias("i"), F.col("rows").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    both = left.join(packed.select("family", "block", "odd", F.col("rows").alias("y")), ["family", "block"]).where("NOT odd OR i <= block")

    def run(batches):
        for batch in batches:
            a, b = [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                for p, q in linked_roots([(r["root"], np.frombuffer(r["low"], np.uint64)) for r in x.as_py()], [(r["root"], np.frombuffer(r["low"], np.uint64)) for r in y.as_py()], percent):
                    a.append(p)
                    b.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cut(both.select("x", "y").mapInArrow(run, "a long, b long").distinct())


def linked_roots(xs: list, ys: list, percent: int) -> set:
    """Pairs of different roots with a link, by the product of two blocks of rows over the columns they share."""
    flat = lambda v: (np.concatenate([s for _, s in v]), np.repeat(np.arange(len(v)), [len(s) for _, s in v]))
    (tx, rx), (ty, ry) = flat(xs), flat(ys)
    shared = np.intersect1d(tx, ty)
    total = np.zeros((len(xs), len(ys)), np.float32)
    for lo in range(0, len(shared), 4096):
        columns = shared[lo : lo + 4096]
        dense = []
        for t, r, n in ((tx, rx, len(xs)), (ty, ry, len(ys))):
            at = np.minimum(np.searchsorted(columns, t), len(columns) - 1)
            hit = columns[at] == t
            m = np.zeros((n, len(columns)), np.float32)
            m[r[hit], at[hit]] = 1
            dense.append(m)
        total += dense[0] @ dense[1].T
    nx, ny = np.array([len(s) for _, s in xs])[:, None], np.array([len(s) for _, s in ys])[None]
    hit = np.argwhere(100 * total >= percent * (nx + ny - total))
    pairs = np.array([[xs[i][0], ys[j][0]] for i, j in hit], np.int64).reshape(-1, 2)
    return {(int(p), int(q)) for p, q in np.unique(np.sort(pairs, axis=1), axis=0) if p != q}


@settled
def candidates(docs: DataFrame, found: DataFrame, leads: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """a, b of the pairs to verify; token, node, n of columns that are still hot; number of these columns."""
    copies = cut(found.where("n > 0").select("node", "row").join(leads.select("node", "lead"), "node").where("row <> lead").select("row"))
    reps = found.where("n > 0").join(side(copies), "row", "left_anti").select("node", "n", "low")
    none = np.zeros(0, np.uint64)
    common = cut(prefixes(reps, percent, none, only="token").groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") >= HOT).select("token"))
    touched = cut(prefixes(reps, percent, none).select("token", "node").join(side(common), "token").select("node").distinct())
    ahead = all_columns(reps.join(side(touched), "node", "left_semi"))
    hot = cut(common.union(ahead.groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") >= HOT).select("token")).distinct())
    if hot.count() <= MOST_SHIPPED:
        shipped, with_lists = np.sort(hot.toPandas()["token"].to_numpy(np.int64).view(np.uint64)), lambda df: df
    else:
        shipped = None
        with_lists = lambda df: df.join(all_columns(df).join(hot, "token").groupBy("node").agg(F.collect_set("token").alias("hots")), "node", "left")  # noqa: E731  at most a set each
    reach = cut(prefixes(with_lists(reps), percent, shipped, short=True).select("node").distinct())
    full = cut(whole_sets(docs, subset(leads, reach, "node"), width, percent)) if reach.count() else None

    def all_prefixes(only: str = "") -> DataFrame:
        out = prefixes(with_lists(reps), percent, shipped, only=only)
        return out if full is None else out.union(prefixes(with_lists(full), percent, shipped, whole=True, only=only))

    columns = all_prefixes()
    still = cut(all_prefixes("token").groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") >= HOT).select("token"))
    n_still = still.count()
    cold = columns.join(side(still), "token", "left_anti")
    hot_rows = cut(columns.join(side(still), "token").select("token", "node", "n"))
    held = hot_rows.groupBy("node").agg(F.count("*").alias("h"))
    pairs = multiply(cold, percent)
    need = -F.floor(-(percent * (F.col("n_a") + F.col("n_b"))) / (100 + percent))
    rest = -F.floor(-(percent * F.greatest("n_a", "n_b")) / 100) - 1
    left = pairs.join(held.select(F.col("node").alias("a"), F.col("h").alias("h_a")), "a", "left").join(held.select(F.col("node").alias("b"), F.col("h").alias("h_b")), "b", "left")
    left = left.where(F.col("c") + rest + F.least(F.coalesce("h_a", F.lit(0)), F.coalesce("h_b", F.lit(0))) >= need).select("a", "b")
    if n_still:
        band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100) if percent < 100 else 1.0))
        rows = hot_rows.withColumn("band", band)
        centres = rows.groupBy("token", "band").agg(F.min("node").alias("a"))
        near = centres.select("token", "a", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band"))
        left = left.union(rows.join(near, ["token", "band"]).where("a <> node").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct())
    return left.distinct(), hot_rows, n_still


@settled
def paired(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """row, doc_id, n, node of all rows; node, lead (least row), n of all nodes; then as ``candidates``. The hashes of prefixes go."""
    found = cut(sets(docs, width, percent))
    leads = cut(found.where("n > 0").groupBy("node").agg(F.min("row").alias("lead"), F.max("n").alias("n")))
    pairs, hot_rows, n_still = candidates(docs, found, leads, width, percent)
    return found.select("row", "doc_id", "n", "node"), leads, pairs, hot_rows, n_still


@settled
def members(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """row, doc_id, n, root (a node that names the row's class; null without shingles). ``docs``: row, doc_id, text."""
    found, leads, pairs, hot_rows, n_still = paired(docs, width, percent)
    roots = components(verify(pairs, leads, docs, width, percent))
    if n_still:
        more = block_links(hot_rows, roots, docs, leads, width, percent)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    roots = side(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()))
    own = found.select("row", "doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    return own.join(roots, "node", "left").select("row", "doc_id", "n", F.coalesce("root", "node").alias("root"))


def classes(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    own = settled(lambda: members(numbered(docs.select("doc_id", "text"), "row"), width, percent))()
    least = cut(own.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component"), F.count("*").alias("k")))
    out = own.where("root IS NOT NULL").join(side(least.where("k > 1").select("root", "component")), "root", "left")
    out = out.unionByName(own.where("root IS NULL").withColumn("component", F.lit(None).cast("long")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


@settled
def spare_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """row of every row but the first of its class. ``docs``: row, doc_id, text."""
    own = members(docs, width, percent)
    best = own.where("root IS NOT NULL").groupBy("root").agg(F.count("*").alias("k"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("first"))
    return own.join(side(cut(best.where("k > 1"))), "root").where("row <> first").select("row")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id, nulls last; of several such rows the first. Rows without words all stay."""
    row = free(docs.columns, "_row")
    keyed = numbered(docs, row)
    gone = spare_rows(keyed.select(F.col(row).alias("row"), "doc_id", "text"), width, percent)
    return keyed.join(side(gone).withColumnRenamed("row", row), row, "left_anti").select(*docs.columns)
