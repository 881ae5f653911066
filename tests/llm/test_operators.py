"""Each operator against a brute-force version on small tables, and on odd rows and empty tables."""

import functools
import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from placewright.llm import common, contamination, fingerprints, html, language, licenses, lines, mixing, ngram_join, perfect_hash, suffix_dedup, toxicity

sha = lambda s: hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


# 1


def brute_components(docs, width, num):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= num * len(x | y):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[root(i)].append(d)
    best = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sorted(((d, len(sets[i]), best[root(i)]) for i, (d, _) in enumerate(docs)), key=repr)


def test_ngram_join(small, odd):
    for docs in (small, odd):
        got = ngram_join.classes(docs)
        assert rows(got, "doc_id", "n_shingles", "component_id") == brute_components(pairs_of(docs), 4, 85)


def test_ngram_join_hot_groups(spark, monkeypatch):
    """A group of near copies, a common passage, few rows a hot column; once with hot columns shipped, once joined."""
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randint(0, 5000)}"
    base, passage = [word() for _ in range(80)], [word() for _ in range(12)]
    docs = []
    for i in range(120):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(80)] = word()
        docs.append((i, " ".join(w)))
    docs += [(i, " ".join(passage + [word() for _ in range(rnd.randint(10, 60))])) for i in range(120, 200)]
    docs += [(i, docs[i - 200][1]) for i in range(200, 240)]
    want = brute_components(docs, 4, 85)
    monkeypatch.setattr(ngram_join, "HOT", 12)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(ngram_join.classes(df), "doc_id", "n_shingles", "component_id") == want
    monkeypatch.setattr(ngram_join, "MOST_SHIPPED", 0)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    assert rows(ngram_join.classes(df), "doc_id", "n_shingles", "component_id") == want


def test_ngram_join_empty(none, odd):
    assert ngram_join.classes(none).count() == 0
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {1, 4, 5, 6, 10, 12}


def test_disk_holds_only_what_results_read(spark, odd):
    """Tables of near copies and of line dedup go when nothing reads them any more, shuffle files when their query ends."""
    made = lambda: set(os.listdir(common.scratch_dir(spark)))
    before = made()
    kept = ngram_join.keep_one(odd)
    assert len(made() - before) == 2 and kept.count() < odd.count()  # numbered rows, rows to drop
    before = made()
    dropped = lines.dedup(odd)
    assert len(made() - before) == 2 and dropped.count() == odd.count()  # packed rows, frequent lines

    @common.settled
    def fails():
        common.cut(spark.range(3))
        raise ValueError

    before = made()
    pytest.raises(ValueError, fails)
    assert made() == before

    [local] = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {f for _, _, names in os.walk(local) for f in names if re.match("shuffle_.*data$", f)}
    before = shuffled()
    sevens = common.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if shuffled() - before:
            time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(common.CLEANUP) == "false"
    assert rows(sevens, "k") == [(k,) for k in range(7)]


def test_rows_of_one_doc_id_are_documents_of_their_own(spark):
    rnd = random.Random(8)
    a, b, c = (" ".join(f"w{rnd.randint(0, 900)}" for _ in range(60)) for _ in range(3))
    data = [(3, a), (5, a + " zz"), (5, b), (None, c), (7, c), (8, c), (None, "lone words of a row without id here"), (9, ""), (9, None), (None, " ")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("row", F.lit("clash")).repartition(3)
    assert rows(ngram_join.classes(df, 5, 80), "doc_id", "n_shingles", "component_id") == brute_components(pairs_of(df), 5, 80)
    got = sorted(pairs_of(ngram_join.keep_one(df)), key=repr)
    assert got == sorted([(3, a), (5, b), (7, c), *data[6:]], key=repr)


# 2


def brute_lines(docs, least_chars=20, least_docs=3):
    split = [(d, (t or "").split("\n")) for d, t in docs]
    key = lambda s: lower(s.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(list)
    for d, ls in split:
        for k in {key(s) for s in ls}:
            if len(k) >= least_chars:
                held[k].append(-(1 << 63) if d is None else d)
    top = {k: max(v) for k, v in held.items() if len(v) >= least_docs}
    out = []
    for d, ls in split:
        own = -(1 << 63) if d is None else d
        kept = [s for s in ls if not (key(s) in top and own < top[key(s)])]
        out.append((d, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limits", [{}, {"shard_keys": 2, "group": 1, "most": 3000}])
def test_line_dedup(small, odd, none, limits):
    for docs in (small, odd):
        out = lines.dedup(docs, **limits).withColumn("kept", F.sha2(F.col("text").cast("binary"), 256))
        assert rows(out, "doc_id", "n_lines", "n_dropped", "kept") == brute_lines(pairs_of(docs))
        assert set(docs.columns) <= set(out.columns)
    assert lines.dedup(none, **limits).count() == 0


def test_perfect_hash():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        h = perfect_hash.PerfectHash(keys)
        assert sorted(h.index(keys).tolist()) == list(range(len(keys))) and len(h) == len(keys)


def test_shard_with_equal_halves():
    low, high = np.array([5, 5, 9], np.uint64), np.array([1, 2, 3], np.uint64)
    s = lines.Shard(low, high, np.array([3, 4, 5]), np.array([10, 20, 30]))
    count, keep = s.look(np.array([5, 5, 5, 9, 8], np.uint64), np.array([1, 2, 7, 3, 1], np.uint64))
    assert count.tolist() == [3, 4, 0, 5, 0] and keep.tolist()[:2] == [10, 20] and keep[3] == 30


# 3


def test_language(small, odd, none):
    out = {r["doc_id"]: r for r in language.identify(small).collect()}
    truth = {r["doc_id"]: r["lang"] for r in small.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    held = [out[i]["lang_pred"] == truth[i] for i in out if out[i]["held_out"]]
    assert sum(held) / len(held) > 0.95 and all(0 <= r["score"] <= 1 for r in out.values())
    odd_out = language.identify(odd).collect()
    assert len(odd_out) == odd.count() and all(r["lang_pred"] == "und" and r["score"] == 0 for r in odd_out if r["doc_id"] in (4, 5, 12, 13))
    assert language.identify(none).count() == 0 and language.accepted(none).count() == 0
    assert language.accepted(odd).columns == odd.columns


def test_code_lengths_are_exact():
    """The tables agree with a byte-by-byte walk down the orders."""
    texts = [b"abracadabra abracadabra", b"abc"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.array([0, len(texts[0]), len(data)])
    u, n = np.unique(language.grams(data, offsets), return_counts=True)
    model = language.Model({"x": (u, n.astype(float))})
    grams = Counter()
    for t in texts:
        p = b"\n" * 4 + t
        for i in range(4, len(p)):
            for k in range(5):
                grams[p[i - k : i + 1]] += 1

    def cost(ctx, c):
        bits = 0.0
        for k in range(4, -1, -1):
            own = ctx[4 - k :]
            seen = {g[-1]: m for g, m in grams.items() if len(g) == k + 1 and g[:-1] == own}
            total = sum(seen.values())
            if not seen:
                continue
            if c in seen:
                return bits - np.log2(seen[c] / (total + len(seen)))
            bits -= np.log2(len(seen) / (total + len(seen)))
        return bits + 8

    for t in (b"abra", b"zzz", b"cab abc"):
        p = b"\n" * 4 + t
        want = sum(cost(p[i - 4 : i], p[i]) for i in range(4, len(p)))
        assert model.code_lengths(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0, 0] == pytest.approx(want)


# 4


def brute_bytes(docs, n=100):
    order = sorted(((-(1 << 63) if d is None else d, k) for k, (d, _) in enumerate(docs)))
    first, marks = {}, {}
    texts = [(t or "").encode() for _, t in docs]
    for d, k in order:
        for i in range(len(texts[k]) - n + 1):
            w = texts[k][i : i + n]
            if w not in first or (d, i) < first[w]:
                first[w] = (d, i)
    out = []
    for d, k in order:
        b, mark = texts[k], np.zeros(len(texts[k]) + 1, int)
        local = set()
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            if first[w][0] < d or w in local:
                mark[i] += 1
                mark[i + n] -= 1
            local.add(w)
        gone = np.cumsum(mark)[: len(b)] > 0
        out.append((docs[k][0], len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [suffix_dedup.SPLIT, 2])
def test_suffix_dedup(small, odd, none, split):
    for docs in (small, odd):
        out = suffix_dedup.removed(docs, split).withColumn("sha", F.sha2("kept", 256))
        assert rows(out, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == brute_bytes(pairs_of(docs))
        assert set(docs.columns) < set(out.columns)
    assert suffix_dedup.dedup(odd).count() == odd.count() and suffix_dedup.dedup(none).count() == 0


@pytest.mark.parametrize("split", [suffix_dedup.SPLIT, 3])
def test_suffix_dedup_of_repeated_ids(spark, split):
    """Rows of one doc_id are judged alone; a common passage among different neighbours is split over shards and merged."""
    rnd = random.Random(6)
    line = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    p, x = line(232), line(119)
    data = [(1, p), (5, p + x), (5, line(351)), (None, x * 2), (None, x * 2), (6, x * 3)] + [(rnd.randint(10, 30), line(rnd.randint(0, 150)) + p[: rnd.randint(90, 232)] + line(rnd.randint(0, 150))) for _ in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    out = suffix_dedup.removed(df, split, 2000).withColumn("sha", F.sha2("kept", 256))
    got = rows(out, "doc_id", "n_bytes", "n_removed", "n_spans", "sha")
    assert got == brute_bytes(pairs_of(df)) and (5, 351, 0, 0, sha(data[2][1])) in got


def test_merge_of_sorted_runs():
    rnd = random.Random(3)
    lists = [sorted({bytes(rnd.choice(b"ab") for _ in range(6)) for _ in range(rnd.randint(1, 30))}) for _ in range(7)]
    want: dict = {}
    runs = []
    for i, own in enumerate(lists):
        for s in own:
            want[s] = min(want.get(s, 99), i)
        runs.append((np.array(own, "S6"), np.full(len(own), i)))
    s, least = suffix_dedup.merge_runs(runs)
    assert dict(zip(s.tolist(), least.tolist())) == want and s.tolist() == sorted(want)


def test_suffix_array():
    rnd = random.Random(2)
    for _ in range(20):
        data = bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randint(1, 300)))
        assert suffix_dedup.suffix_array(np.frombuffer(data, np.uint8)).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


# 5


def brute_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(t):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (a != b)))
        row = new
    return min(row)


def test_myers():
    rnd = random.Random(5)
    for _ in range(200):
        p, t = ("".join(rnd.choice("abc") for _ in range(rnd.randint(1, n))) for n in (12, 40))
        assert contamination.myers(contamination.masks_of(p), len(p), t)[0] == min(brute_distance(p, t), len(p))


def test_contamination(spark, odd, none):
    rnd = random.Random(9)
    item = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8))) for _ in range(n))
    items = [(i, item(20)) for i in range(8)] + [(8, "Tiny one"), (9, None), (10, "!!"), (11, "")]
    docs = []
    for d in range(40):
        own = item(30)
        if d % 2:
            x = list(items[d % 8][1])
            for _ in range(rnd.randint(0, len(x) // 8)):
                x[rnd.randrange(len(x))] = rnd.choice(["", "z", "qq"])
            own = own[:50] + " " + "".join(x).upper() + ", " + own[50:]
        docs.append((d, own))
    docs += [(50, "a tiny, ONE!"), (51, "untiny one"), (52, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(50, 8, 0)}
    for d, t in docs[:40]:
        for i, x in items[:8]:
            p = contamination.normal(x)
            k = brute_distance(p, contamination.normal(t))
            if k <= len(p) // contamination.EDIT_SHARE:
                want.add((d, i, k))
    for block in (8 << 20, 200):
        got = contamination.leaks(df, bench, block)
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got.collect()} == want
        assert {r["doc_id"] for r in contamination.clean(df, bench, block).collect()} == {d for d, _ in docs} - {w[0] for w in want}
    assert contamination.leaks(none, bench).count() == 0 and contamination.clean(odd, bench.limit(0)).count() == odd.count()


# 6


def test_html_text():
    page = '<nav>Menu</nav><div class="cookie-notice">Cookies</div><article><header><h1>A &amp;  b</h1></header><p>One<br>two <b>three<p>Four &#x65e5;<div class="share-bar">Tweet</div><!-- x --><script>if (a < b) "</p>"</script></article><section id="comments"><article>bad</article></section><footer>f</footer>'
    assert html.main_text(page) == "A & b\n\nOne two three\n\nFour 日"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p><form>x</form>") == ""
    assert html.main_text("<p>a<p>b<li>c") == "a\n\nb\n\nc" and html.main_text("no tags") == "no tags"
    assert html.main_text("<div>" * 5000 + "deep") == "deep"


def test_html_templates(spark):
    page = lambda i: f"<body><div><p>Site slogan, always here</p></div><div><p>Own text {i}</p></div><div>by {i}</div></body>"
    data = [(i, "http://a.example/x", page(i)) for i in range(10)] + [(20, "http://b.example/", page(1)), (21, None, page(2)), (22, "http://[bad", None), (23, "http://a.example/x", "<article><p>Site slogan, always here</p></article>")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    assert got[3]["text"] == "Own text 3\n\nby 3" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[20]["text"].startswith("Site slogan") and got[21]["text"].startswith("Site slogan") and got[22]["text"] == "" and got[23]["text"] == "Site slogan, always here"
    assert html.digest(df.limit(0)).count() == 0


def test_html_repeated_articles_keep_their_words(spark):
    whole = "<article><h1>T</h1><ul><li>one</li><li><a href=x>two</a></li></ul><table><tr><td>a</td><td>1</td></tr></table><section><div>bare</div></section><dl><dt>k</dt></dl><ol><li><a href=y>menu</a></li></ol><div><img src=z>&nbsp;</div></article>"
    df = spark.createDataFrame([(i, "http://a.example/x", f"<body><div>site</div>{whole}</body>") for i in range(6)], "page_id long, url string, html string")
    assert {r["text"] for r in html.extract(df).collect()} == {"T\n\none\n\ntwo\n\na\n\n1\n\nbare\n\nk"}


def test_html_blocks_take_little_disk(spark, monkeypatch):
    pages, made, blocks = "/root/testdata/sf0.1/pages.parquet", [], html.blocks
    monkeypatch.setattr(html, "blocks", lambda *a: made.append(blocks(*a)) or made[-1])
    html.extract(spark.read.parquet(pages))
    packed = made[0].agg(F.sum(F.length("body"))).first()[0]
    assert 2 * packed <= 1.25 * os.path.getsize(pages)  # written once and shuffled once


def test_html_slots_against_a_plain_count(spark):
    """On a host of many pages counts alone find slots, whatever they are called; keys that the operator finds are those of a plain count."""
    rnd = random.Random(12)
    words = lambda n, k: " ".join(rnd.choice("abcdefgh") * rnd.randint(2, 5) + str(rnd.randint(0, k)) for _ in range(n))
    slot = [words(6, 10**6) for _ in range(12)]
    body = lambda i: f"<body><div class='x1'><p>{rnd.choice(slot)}</p></div><div class='x2'><h1>T{i}</h1><p>{words(40, 10**6)}</p><p>{words(30, 10**6)}</p></div><div class='x3'>{words(3, 10**6)}</div></body>"
    data = [(i, "http://many.example/a" if i < 60 else "http://few.example/a", body(i)) for i in range(66)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r for r in html.extract(df, 5000).collect()}
    seen, had, again = Counter(), Counter(), Counter()
    for i, u, h in data:
        for x in {(html.host_of(u), x.place, x.zone, html.key_of(x)) for x in html.hash_subtrees(html.parse(h))}:
            seen[x] += 1
    for x, n in seen.items():
        had[x[:3]] += n
        again[x[:3]] += n * (n > 1)
    for i, u, h in data:
        keys = {x for x in {(html.host_of(u), x.place, x.zone, html.key_of(x)) for x in html.hash_subtrees(html.parse(h))}}
        out = {x[3] for x in keys if seen[x] >= 5 and x[2] != html.BULK or x[2] == html.AROUND and had[x[:3]] >= html.MANY and again[x[:3]] >= html.SHARE * had[x[:3]]}
        assert got[i]["n_template"] == len(out) and (len(out) > 0) == (i < 60)
        lost = re.search("x1'><p>(.*?)</p>", h)[1]
        assert got[i]["text"].startswith(f"T{i}\n\n") == (i < 60) and (lost in got[i]["text"]) == (i >= 60)


@pytest.mark.parametrize("text", ["<a " * 200_000, "</x>" * 200_000, "<p>" + "<b>" * 20_000 + "<hr>" * 20_000, "<a ='\">" * 60_000, "<li><ul>" + "<div>" * 20_000 + "<li></li>" * 20_000, "<article>" * 20_000 + "x", "<script>" * 50_000, "<!--" * 200_000])
def test_html_hostile_pages_take_linear_time(text):
    began = time.process_time()
    html.main_text(text, frozenset([1]), frozenset([2]))
    assert time.process_time() - began < 20


# 7


def test_toxicity(spark, none, odd):
    rnd = random.Random(1)
    clean = lambda n: " ".join(f"{rnd.choice('bcdfg')}{rnd.choice('aeiou')}{rnd.choice('lmnr')}{rnd.choice('aeiou')}{rnd.choice('stk')}" for _ in range(n))
    docs, labels = [], []
    for i in range(600):
        text, bad = clean(rnd.randint(20, 120)).split(), i % 4 == 0
        if bad:
            for _ in range(6):
                text.insert(rnd.randrange(len(text)), rnd.choice(["wretched", "vilest", "scoundrel"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.digest(df, lab).collect()}
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert len(held) > 100 and sum(p == y for p, y in held) / len(held) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    odd_got = toxicity.digest(odd, lab).collect()
    assert len(odd_got) == odd.count() and all(0 <= r["score"] <= 1 for r in odd_got)
    assert toxicity.digest(none, lab).count() == 0 and toxicity.digest(df, lab.limit(0)).count() == 600


# 8


def brute_mix(spark, docs, total, epochs):
    """By the plain definition, with the operator's own hash."""
    data = docs.select("doc_id", "lang", "source", mixing.domain_of(F.col("source")).alias("d"), "text").collect()
    leaf = lambda r: tuple("\x00" if x is None else x for x in (r["d"], r["lang"], r["source"]))
    n = lambda r: len(re.findall(r"[^ \t\n\x0b\f\r]+", r["text"] or ""))
    sizes = Counter()
    for r in data:
        sizes[leaf(r)] += n(r)
    given = mixing.budgets(dict(sizes), sum(sizes.values()) // 2 if total is None else total, epochs, mixing.natural_weight)
    hashed = docs.select("doc_id", *[mixing.order_hash(17, F.lit(e)).alias(f"h{e}") for e in range(4)]).collect()
    h = {(r["doc_id"], e): r[f"h{e}"] for r in hashed for e in range(4)}
    out = []
    for x in sizes:
        own = [r for r in data if leaf(r) == x]
        full, room = divmod(given[x], sizes[x]) if sizes[x] else (0, 0)
        out += [(r["doc_id"], e) for r in own for e in range(full)]
        if room:
            used = 0
            for k in sorted({h[r["doc_id"], full] for r in own}):
                group = [r for r in own if h[r["doc_id"], full] == k]
                used += sum(map(n, group))
                if used > room:
                    break
                out += [(r["doc_id"], full) for r in group]
    return sorted(out, key=repr)


@pytest.mark.parametrize("budget,epochs", [(None, 3.0), (60_000, 3.0), (10, 1.0), (10**9, 2.0), (0, 1.0)])
def test_mixing(spark, small, budget, epochs):
    assert rows(mixing.mix(small, budget, epochs), "doc_id", "epoch") == brute_mix(spark, small, budget, epochs)


def test_mixing_odd(spark, odd, none):
    assert rows(mixing.mix(odd), "doc_id", "epoch") == brute_mix(spark, odd, None, 3.0)
    assert mixing.mix(none).count() == 0


def test_budgets():
    leaves = {("a", "x", "1"): 100, ("a", "x", "2"): 1000, ("a", "y", "3"): 50, ("b", "x", "4"): 10}
    got = mixing.budgets(leaves, 400, 1.0, mixing.equal_weight)
    # b can only give 10; y only 50; source 1 only 100
    assert got == {("b", "x", "4"): 10, ("a", "y", "3"): 50, ("a", "x", "1"): 100, ("a", "x", "2"): 240}
    assert sum(mixing.budgets(leaves, 10**6, 1.0, mixing.equal_weight).values()) == 1160
    assert mixing.deal(10, {"a": 5, "b": 5, "c": 5}, {"a": 1, "b": 1, "c": 1}) == {"a": 4, "b": 3, "c": 3}


# 9


def test_fingerprints(small, odd, none):
    docs = sorted(pairs_of(small), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.digest(small).collect()}
    for (d, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        k = len(t) // 3
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == sha(t[: len(t) - k] + after[:k])
    by_text = defaultdict(set)
    for d, t in docs:
        by_text[t].add(got[d]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.15 > np.mean([r["near_next"] for r in got.values()])
    assert fingerprints.digest(odd).count() == odd.count() and fingerprints.digest(none).count() == 0
    plan = fingerprints.digest(small)._jdf.queryExecution().executedPlan().toString() if hasattr(small, "_jdf") else ""
    assert "Python" not in plan and "Arrow" not in plan


def brute_fingerprint(text):
    """By the definition, with the standard XXH64 in place of the engine's function."""
    bits, mask = fingerprints.POS_BITS, (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = lambda *xs: functools.reduce(lambda seed, x: xxhash.xxh64_intdigest(x if isinstance(x, bytes) else (x[0] & (1 << 8 * x[1]) - 1).to_bytes(x[1], "little"), seed), xs, 42)
    words = [h(w.encode()) for w in re.split("[ \t\n\x0b\f\r]+", text or "") if w]
    k = fingerprints.K
    kmers = [h(*[(w, 8) for w in words[i : i + k]]) for i in range(len(words) - k + 1)] if len(words) >= k else [functools.reduce(lambda seed, w: xxhash.xxh64_intdigest(w.to_bytes(8, "little"), seed), words, 42)] * bool(words)
    seen, entries = Counter(), []
    for place, x in enumerate(kmers):
        x = (x << bits | place) & mask
        entries.append((x, seen[x >> bits]))
        seen[x >> bits] += 1
    out = []
    for j in range(fingerprints.M):
        keys = [signed(h((x >> bits, 8), (o, 4), (j, 4)) & ~fingerprints._POS & mask | x & fingerprints._POS) for x, o in entries]
        if not keys:
            out.append(42)
            continue
        two = sorted((min(keys), max(keys)), key=lambda x: x & fingerprints._POS)
        out.append(h(*[(x >> bits, 8) for x in two]) & 0xFFFFFFFF)
    return "".join(f"{x:08x}" for x in out)


def test_fingerprints_against_brute_force(small, odd):
    """Every signature and likeness, also of repeated k-mers, short and empty texts."""
    for docs in (small, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        texts = {d: t or "" for d, t in pairs_of(docs) if len(t or "") < 30_000}
        order = sorted(pairs_of(docs), reverse=True)
        after = {d: t or "" for (d, _), (_, t) in zip(order, order[1:] + order[:1])}
        like = lambda a, b: sum(a[8 * i : 8 * i + 8] == b[8 * i : 8 * i + 8] for i in range(fingerprints.M)) / fingerprints.M
        for r in fingerprints.digest(docs).collect():
            d = r["doc_id"]
            if d in texts and len(after[d]) < 30_000:
                t, n = texts[d], len(texts[d]) // 3
                own, edited, following = brute_fingerprint(t), brute_fingerprint(t[: len(t) - n] + after[d][:n]), brute_fingerprint(after[d])
                assert (r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) == (own, edited, like(own, edited), like(own, following))


def test_occurrences(spark):
    texts = ["a b c d", "a b a b a b a b", "x y", "", "a b c a b c a b c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fingerprints.numbered_kmers(F.col("t")).alias("e"))
    for i, e in df.collect():
        w = texts[i].split()
        kmers = [tuple(w[k : k + fingerprints.K]) for k in range(len(w) - fingerprints.K + 1)] or ([tuple(w)] if w else [])
        seen, want = Counter(), {}
        for pos, k in enumerate(kmers):
            want[pos] = seen[k]
            seen[k] += 1
        assert {x["x"] & fingerprints._POS: x["o"] for x in e} == want


# 10


def test_licenses(odd, none):
    s = licenses.Scanner()
    n, base, spans = s.scan("Code. CC-BY 4.0; all rights  reserved, All Rights Reserved")
    assert n == 11 and sorted(base) == [("cc-by", 1), ("reserved", 5), ("reserved", 8)]
    assert {x[0] for x in s.scan("Licensed undr the Apache Licence, Version 2.0")[2]} == {"apache-2.0"}
    assert [x[0] for x in s.scan("Relased under the MIT License.")[2]] == ["mit"] and s.scan("plain words only")[2] == []
    assert len(s.scan("cc by cc by")[1]) == 2 and s.scan(None) == (0, [], [])
    out = licenses.scan(odd).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out) and licenses.digest(none).count() == 0


def test_license_overlaps(spark):
    texts = ["gnu leser general public license", "gnu afero general public license", "gnu leser generl public license", "licensed under the apache license version 2 O", "licensed under cc by nc 4 0", "licensed under the gnu genral public license", "mozilla public license eclipse public license", "gnu lesser general public license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.digest(df).collect()}
    assert [got[i] for i in range(len(texts))] == ["gpl,lgpl", "agpl,gpl", "gpl,lgpl", "apache-2.0", "cc-by,cc-by-nc", "gpl", "epl,mpl", "gpl,lgpl"]


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    at = sorted((i, x) for p, x in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def test_license_counts(small, odd):
    """All rows, hits or not."""
    for docs in (small, odd):
        texts, got = defaultdict(list), defaultdict(list)
        for d, t in pairs_of(docs):
            texts[d].append(brute_base(t))
        for r in licenses.digest(docs).collect():
            got[r["doc_id"]].append((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]))
            assert set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""}
        assert got == texts and (docs is odd or any(v[0][1] for v in texts.values()))


def test_license_spans_against_all_distances():
    """Labels of misspelt notices among other words: exactly those whose least edit distance to a stretch of the text is within bounds."""
    rnd, s = random.Random(4), licenses.Scanner()
    for _ in range(150):
        notice, label = rnd.choice(list(licenses.NOTICES.items()))
        x = list(notice)
        for _ in range(rnd.randint(0, len(notice) // licenses.EDIT_SHARE + 2)):
            x[rnd.randrange(len(x))] = rnd.choice(["", "z", "qq"])
        text = " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(5)) + " " + "".join(x) + " delta"
        own = " " + " ".join(w.decode() for w in licenses.words_of(text)) + " "
        within = {y for n, y in licenses.NOTICES.items() if brute_distance(n, own) <= len(n) // licenses.EDIT_SHARE}
        spans = s.scan(text)[2]
        assert bool(spans) == bool(within) and {p[0] for p in spans} <= within
        for _, first, a, b, edits, size in spans:
            assert own[:a].strip().count(" ") + bool(own[:a].strip()) in (first, first + 1) and edits <= size // licenses.EDIT_SHARE


def test_license_scan_grows_with_the_text():
    """Ten times as many notices: some ten times the work, not a hundred times."""
    s, text = licenses.Scanner(), " licensed under the apache license version 2 O or so all rights reserved"
    times = []
    for n in (500, 5000):
        began = time.process_time()
        count, base, spans = s.scan(text * n)
        times.append(time.process_time() - began)
        assert count == 13 * n and [w for _, w in base] == [13 * i + 10 for i in range(n)] and len(spans) == 2 * n
    assert times[1] < 30 * times[0]
