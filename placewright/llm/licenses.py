"""Fuzzy search for short licence notices.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z; a text is searched as its words
joined by spaces. Base phrases are exact word runs. A notice of m characters allows ``m // 9`` edits; it is split
into one piece more than that, at least one of which any match keeps whole (pigeonhole). One Aho-Corasick pass
finds all pieces and phrases; around each piece the ``regex`` library's bounded-error matching verifies the notice
and gives its span and edits.

All verified finds count, also overlapping ones, with two exceptions: of finds of notices of like length over the same words (as nc and
sa) the one of the smallest share of edits stays; and a find inside that of a longer notice goes if it names the same licence, or the
same less exactly (``apache`` in ``apache-2.0``). A shorter notice never displaces a longer one that is within its edits.

Null and empty texts have no words. Each row is scanned on its own, whole and at any length; rows may repeat, and
other columns pass through.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewright.llm.contamination import masks_of, myers

# Phrases and notices with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the apache license": "apache",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
EDIT_SHARE = 9
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 even parts."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def alike(s: tuple, t: tuple) -> bool:
    """Whether the notices of two finds are of like length: one could be a misspelling of the other."""
    return abs(s[5] - t[5]) <= max(s[5], t[5]) // EDIT_SHARE


def same_words(s: tuple, t: tuple) -> bool:
    """Whether two finds share more than half of the shorter one."""
    return 2 * (min(s[3], t[3]) - max(s[2], t[2])) > min(s[3] - s[2], t[3] - t[2])


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES):
        self.base, self.notices = list(base.items()), list(notices.items())
        found: dict[str, list] = {}
        for k, (phrase, _) in enumerate(self.base):
            found.setdefault(f" {phrase} ", []).append((True, k, 0))
        self.patterns, self.errors, self.masks = [], [], [masks_of(n) for n, _ in self.notices]
        for k, (notice, _) in enumerate(self.notices):
            e = len(notice) // EDIT_SHARE
            self.errors.append(e)
            self.patterns.append(regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={e}}}"))
            for at, piece in pieces(notice, e):
                found.setdefault(piece, []).append((False, k, at))
        self.automaton = ahocorasick.Automaton()
        for key, uses in found.items():
            self.automaton.add_word(key, (len(key), uses))
        self.automaton.make_automaton()
        self.verify = lru_cache(1 << 14)(self.verify)  # notices mostly recur as they are
        self.cell = 2 * max((len(n) for n, _ in self.notices), default=1)  # no find is longer than a cell

    def verify(self, k: int, window: str) -> tuple[int, int, int] | None:
        """(start, end, edits) of the best match of notice k in a window; windows that Myers' distance rules out never reach ``regex``."""
        if myers(self.masks[k], len(self.notices[k][0]), window)[0] > self.errors[k]:
            return None
        m = self.patterns[k].search(window)
        return (*m.span(), sum(m.fuzzy_counts)) if m else None

    def scan(self, text: str | None):
        """(number of words, [(label, first word)] of base phrases, [(label, first word, start, end, edits, length)])."""
        words = words_of(text)
        own = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
        base, spans, tried = [], {}, set()
        blanks = np.flatnonzero(np.array([own]).view(np.uint32) == 32) if own.isascii() else np.array([m.start() for m in re.finditer(" ", own)], np.int64)
        word_at = lambda i: int(np.searchsorted(blanks, i)) - (own[i] != " ")  # noqa: E731  of the word at i, or after the blank at i
        for end, (size, uses) in self.automaton.iter(own):
            for exact, k, at in uses:
                start = end - size + 1
                if exact:
                    base.append((self.base[k][1], word_at(start)))
                    continue
                e, notice = self.errors[k], self.notices[k][0]
                if (k, start - at) in tried:
                    continue
                tried.add((k, start - at))
                lo = max(0, start - at - e)
                m = self.verify(k, own[lo : start - at + len(notice) + e])
                if m:
                    a, b, edits = lo + m[0], lo + m[1], m[2]
                    same = (k, a // max(1, e))
                    if same not in spans or edits < spans[same][4]:
                        spans[same] = (self.notices[k][1], word_at(a), a, b, edits, len(notice))
        # of finds of like length the one of the smallest share of edits, then the longest; finds that overlap stand in neighbouring cells
        best: dict[int, list] = {}
        near = lambda s: (t for c in range(s[2] // self.cell - 1, s[2] // self.cell + 2) for t in best.get(c, ()))
        for s in sorted(spans.values(), key=lambda s: (s[4] / s[5], -s[5], s[2], s[0])):
            if not any(alike(s, t) and same_words(s, t) for t in near(s)):
                best.setdefault(s[2] // self.cell, []).append(s)
        kept = [s for own_cell in best.values() for s in own_cell if not any(t[5] > s[5] and not alike(s, t) and (t[0] == s[0] or t[0].startswith(f"{s[0]}-")) and same_words(s, t) for t in near(s))]
        return len(words), base, sorted(kept, key=lambda s: (s[2], s[3], s[0]))


FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.LongType())]))),
])
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """``docs`` with counts, labels, ``score`` (1 less the share of edits of the best find, 0 if none) and ``spans``."""
    names = [c for c in docs.columns if c not in FIELDS.names]

    def run(batches):
        scanner = Scanner(base, notices)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                n, exact, spans = scanner.scan(text)
                at, labels = [w for _, w in exact], {x for x, _ in exact}
                best = max([1.0] * bool(exact) + [1 - s[4] / s[5] for s in spans], default=0.0)
                rows.append((n, len(exact), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {s[0] for s in spans})), best, [dict(zip(("label", "first_word", "start", "end", "edits"), s)) for s in spans]))
            cols = [*zip(*rows)] or [[]] * len(FIELDS)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), _SPANS]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(c, t) for c, t in zip(cols, kinds)], [*names, *FIELDS.names])

    return docs.select(*names).mapInArrow(run, T.StructType([docs.schema[c] for c in names] + FIELDS.fields))


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select("doc_id", *[F.col(c) for c in FIELDS.names if c != "spans"])
