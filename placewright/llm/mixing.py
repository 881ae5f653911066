"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, lang, source). A token budget for the whole goes down the tree by the weights of siblings. A node can
use at most ``max_epochs`` times the tokens below it; what one cannot use is dealt to its siblings by their weights, and only what
all siblings cannot use is left to the ancestors' other branches. Whole tokens are dealt by largest remainder, ties by name.

A leaf's tokens are read in seeded epochs: in epoch e its documents stand in the order of a hash of seed, e and doc_id. Full
epochs take all of them; the last takes the longest prefix that fits the rest of the budget. Where that prefix ends is found
without ordering a leaf in one task: token sums of ``2 ** BITS`` hash ranges show the range in which it ends, sums of that range's
parts the part, and so on to single hash values. Rows of one doc_id in one leaf have one hash, and are taken together.

Tokens are words (runs without ASCII white space). Null and empty texts have none and are taken with their hash's place. Null
lang, source and doc_id are values like others. Leaf totals go to the driver, at most ``MOST_LEAVES`` of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placewright.llm.common import cut, free

MOST_LEAVES = 100_000
BITS = 8
LEVELS = 7
PATH = ["domain", "lang", "source"]


def domain_of(source: Column) -> Column:
    """Default top level: four groups of sources by checksum of the name."""
    return F.concat(F.lit("d"), F.pmod(F.crc32(F.coalesce(source, F.lit("")).cast("binary")), F.lit(4)).cast("string"))


def equal_weight(path: tuple, tokens: int) -> float:
    return 1.0


def natural_weight(path: tuple, tokens: int) -> float:
    """Equal for domains and languages, by the root of their size for sources."""
    return 1.0 if len(path) < 3 else float(tokens) ** 0.5


def deal(budget: int, most: dict, weights: dict) -> dict:
    """``budget`` over names by weight, none above its ``most``; what some cannot take goes to the others."""
    out, open_, left = dict.fromkeys(most, 0), [n for n in most if most[n] > 0 and weights[n] > 0], min(budget, sum(most[n] for n in most if weights[n] > 0))
    while open_ and left > 0:
        total = sum(weights[n] for n in open_)
        full = [n for n in open_ if left * weights[n] / total >= most[n] - out[n]]
        if not full:
            parts = {n: left * weights[n] / total for n in open_}
            for n in open_:
                out[n] += int(parts[n])
            spare = left - sum(int(x) for x in parts.values())
            for n in sorted(open_, key=lambda n: (int(parts[n]) - parts[n], str(n))):
                if spare <= 0:
                    break
                if out[n] < most[n]:
                    out[n] += 1
                    spare -= 1
            break
        for n in full:
            left -= most[n] - out[n]
            out[n] = most[n]
        open_ = [n for n in open_ if n not in set(full)]
    return out


def budgets(leaves: dict[tuple, int], total: int, max_epochs: float, weight: Callable[[tuple, int], float]) -> dict[tuple, int]:
    """Tokens for each leaf path."""
    own: dict[tuple, int] = defaultdict(int)
    kids: dict[tuple, list] = defaultdict(list)
    for path, n in leaves.items():
        for d in range(len(path) + 1):
            own[path[:d]] += n
            if d and path[:d] not in kids[path[: d - 1]]:
                kids[path[: d - 1]].append(path[:d])
    cap: dict[tuple, int] = {}
    for path in sorted(own, key=len, reverse=True):
        cap[path] = sum(cap[k] for k in kids[path] if weight(k, own[k]) > 0) if kids[path] else int(own[path] * max_epochs)
    given = {(): min(total, cap.get((), 0))}
    for path in sorted(kids, key=len):
        if path in given:
            given |= deal(given[path], {k: cap[k] for k in kids[path]}, {k: weight(k, own[k]) for k in kids[path]})
    return {p: given.get(p, 0) for p in leaves}


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def order_hash(seed: int, epoch: Column) -> Column:
    """A position from 0 to 2 ** 56 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(seed), epoch), 64 - BITS * LEVELS)


def ends(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """leaf, last: the largest hash that the prefix takes (-1: none). ``rows``: leaf, h, n; ``rest``: leaf, room (tokens)."""
    now = rest.select("leaf", F.col("room"), F.lit(0).cast("long").alias("base"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = rows.join(F.broadcast(now), "leaf").where(F.shiftright("h", shift + BITS) == F.col("base"))
        sums = inside.groupBy("leaf", "room", F.shiftright("h", shift).alias("part")).agg(F.sum("n").alias("n"))  # at most 2 ** BITS a leaf
        run = sums.withColumn("upto", F.sum("n").over(W.partitionBy("leaf").orderBy("part")))
        step = run.groupBy("leaf", "room").agg(F.min(F.when(F.col("upto") > F.col("room"), F.struct("part", (F.col("upto") - F.col("n")).alias("before")))).alias("x"))
        # a leaf whose rest takes all of a range can only be one without rows there
        now = cut(step.select("leaf", (F.col("room") - F.col("x.before")).alias("room"), F.col("x.part").alias("base")).where("base IS NOT NULL"))
    return now.select("leaf", (F.col("base") - 1).alias("last"))


def mix(docs: DataFrame, budget: int | None = None, max_epochs: float = 3.0, weight: Callable[[tuple, int], float] = natural_weight, domain: Callable[[Column], Column] = domain_of, seed: int = 17) -> DataFrame:
    """``docs`` once for each epoch that takes them, with ``domain``, ``n_tokens`` and ``epoch`` (from 0).

    Without ``budget``, half of all tokens are drawn.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("domain", "n_tokens", "epoch")]
    keyed = docs.select(*names).withColumn("domain", domain(F.col("source")))
    leaf = F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit("\x00")).alias(c) for c in PATH]))
    small = cut(keyed.select("doc_id", leaf.alias("leaf"), n_tokens(F.col("text")).alias("n")))
    totals = small.groupBy("leaf").agg(F.sum("n").alias("n")).limit(MOST_LEAVES + 1).collect()
    if len(totals) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    import json

    paths = {r["leaf"]: tuple(json.loads(r["leaf"])[c] for c in PATH) for r in totals}
    sizes = {paths[r["leaf"]]: r["n"] for r in totals}
    given = budgets(sizes, sum(sizes.values()) // 2 if budget is None else budget, max_epochs, weight)
    plan = [(key, given[p] // sizes[p] if sizes[p] else 0, given[p] % sizes[p] if sizes[p] else 0) for key, p in paths.items()]
    plan = spark.createDataFrame(plan, "leaf string, full int, room long")
    hashed = small.join(F.broadcast(plan.select("leaf", "full")), "leaf").select("leaf", order_hash(seed, F.col("full")).alias("h"), "n")
    last = ends(hashed, plan.where("room > 0"))
    key, full, end = (free([*names, "domain"], c) for c in ("leaf", "full", "last"))
    draws = plan.join(last, "leaf", "left").select(F.col("leaf").alias(key), F.col("full").alias(full), F.coalesce("last", F.lit(-1)).alias(end))  # one row a leaf
    out = keyed.withColumn(key, leaf).join(F.broadcast(draws), key)
    taken = F.col(full) + (order_hash(seed, F.col(full)) <= F.col(end)).cast("int")
    epochs = F.when(taken > 0, F.sequence(F.lit(0), taken - 1)).otherwise(F.array().cast("array<int>"))
    return out.select(*names, "domain", n_tokens(F.col("text")).alias("n_tokens"), F.explode(epochs).alias("epoch"))


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")
