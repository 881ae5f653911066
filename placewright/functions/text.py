"""Bilingual text functions. Column functions stay native where the text is ASCII; other text goes through one Arrow pass."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewright.functions.lexicons import ROMAN_LETTERS, ROMAN_WORDS, SYNONYMS

# What folding does to characters.
MARKS = "ً-ٰٟۖ-ۭ"
FOLD_FROM, FOLD_TO, FOLD_GONE = "آأإٱىةؤئ", "اااايهوي", "ـء"
APOSTROPHES = "'’ʼʻ`´"
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO, FOLD_GONE) | {base + d: str(d) for base in (0x0660, 0x06F0) for d in range(10)}
_MARKS = re.compile(f"[{MARKS}]")
_QUOTES = re.compile(f"[{APOSTROPHES}]")
_BREAK = re.compile(r"[^\w\s؀-ۿ]+")
_ARTICLE = re.compile(r"\b[اأإ]ل(\w{3,})")
_ARABIC = re.compile("[؀-ۿ]")


def strip_marks(text: str | None) -> str:
    return _MARKS.sub("", text or "")


def fold(text: str) -> str:
    return strip_marks(text).translate(_FOLD)


@lru_cache(65536)
def normalize(text: str | None) -> str:
    if not text:
        return ""
    flat = fold(unicodedata.normalize("NFKC", text).casefold())
    return " ".join(_BREAK.sub(" ", _QUOTES.sub("", flat)).split())


def without_article(text: str) -> str:
    return _ARTICLE.sub(r"\1", text)


def synonym(token: str) -> str:
    return SYNONYMS.get(token, token)


def tokenize(text: str | None, expand: bool = True) -> list[str]:
    """Distinct tokens in order; expanded ones are replaced by their synonym and followed by their forms without article."""
    tokens = normalize(text).split()
    if expand:
        tokens = [synonym(t) for t in tokens]
        tokens += [bare for t in tokens if (bare := without_article(t)) != t]
    return list(dict.fromkeys(tokens))


def search_text(*fields: str | None) -> str:
    return " ".join(dict.fromkeys(t for f in fields for t in tokenize(f)))


def is_arabic(text: str | None) -> bool:
    return bool(_ARABIC.search(text or ""))


def romanize(text: str | None) -> str:
    """A Latin consonant skeleton of Arabic text; '' for text without Arabic."""
    if not is_arabic(text):
        return ""
    latin = "".join(ROMAN_LETTERS.get(c, c) for c in normalize(text))
    for word, spelling in ROMAN_WORDS:
        latin = re.sub(rf"\b{word}\s+" if word == "al" else rf"\b{word}\b", spelling, latin)
    return " ".join(latin.split())


def variants(*names: str | None) -> list[str]:
    """Distinct non-empty normalised and romanised forms."""
    return sorted({form for n in names if n for form in (normalize(n), romanize(n)) if form})


def _vector(function, returns: T.DataType):
    @F.pandas_udf(returns)
    def run(values: pd.Series) -> pd.Series:
        known = {v: function(v) for v in values.unique()}
        return values.map(known) if len(values) else values

    return run


_normalize_udf = _vector(lambda v: None if v is None else normalize(v), T.StringType())
_tokens_udf = _vector(lambda v: None if v is None else tokenize(v), T.ArrayType(T.StringType()))
_plain_tokens_udf = _vector(lambda v: None if v is None else tokenize(v, expand=False), T.ArrayType(T.StringType()))
_roman_udf = _vector(lambda v: None if v is None else romanize(v), T.StringType())


def ascii_only(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7F]")


def normalized(c: Column) -> Column:
    """Normalised text, '' for null; only non-ASCII values reach Python."""
    native = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "['`]", ""), r"[^a-z0-9_]+", " "))
    return F.coalesce(F.when(ascii_only(c), native), _normalize_udf(F.when(~ascii_only(c), c)), F.lit(""))


def _native_tokens(c: Column, expand: bool) -> Column:
    split = F.filter(F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "['`]", ""), r"[^a-z0-9_]+", " ")), " "), lambda t: t != "")
    if expand:
        table = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() if kv[0].isascii() for x in kv])
        split = F.transform(split, lambda t: F.coalesce(F.try_element_at(table, t), t))
    # ASCII words may have become Arabic synonyms; none of those begins with an article
    return F.array_distinct(split)


def tokens(c: Column, expand: bool = True) -> Column:
    udf = _tokens_udf if expand else _plain_tokens_udf
    return F.coalesce(F.when(ascii_only(c), _native_tokens(c, expand)), udf(F.when(~ascii_only(c), c)), F.array().cast("array<string>"))


def search_blob(*cols: Column) -> Column:
    return F.array_join(F.array_distinct(F.concat(*[tokens(c) for c in cols])), " ")


def has_arabic(c: Column) -> Column:
    return F.coalesce(c.rlike("[\\u0600-\\u06FF]"), F.lit(False))


def romanized(c: Column) -> Column:
    return F.coalesce(_roman_udf(F.when(has_arabic(c), c)), F.lit(""))


def match_variants(*cols: Column) -> Column:
    forms = F.array(*[f for c in cols for f in (normalized(c), romanized(c))])
    return F.array_sort(F.array_distinct(F.filter(forms, lambda f: f != "")))


def nullif_blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def clean_phone(raw: Column, country: str = "+966") -> Column:
    """One canonical form of a phone number; null without digits."""
    s = F.regexp_replace(raw, r"[^\p{Nd}+]", "")
    short = F.length(s).isin(4, 5, 9, 10) & s.rlike("^[98]")
    return (
        F.when(raw.isNull() | (s == ""), None).when(s.startswith("+"), s).when(s.startswith("00"), F.concat(F.lit("+"), F.substr(s, F.lit(3)))).when(s.startswith("966"), F.concat(F.lit("+"), s))
        .when(s.startswith("0"), F.concat(F.lit(country), F.substr(s, F.lit(2)))).when(short, s).otherwise(F.concat(F.lit(country), s))
    )


# Fixed values: (label, pattern) of addresses that are no website of one's own, in order.
_AT = r"(?:^|[./])"
PLATFORMS = [
    ("instagram", _AT + r"instagram\.com"),
    ("facebook", _AT + r"facebook\.com|(?:^|[./])fb\.(?:com|me)"),
    ("twitter/x", _AT + r"(?:twitter|x)\.com"),
    ("tiktok", _AT + r"tiktok\.com"),
    ("snapchat", r"snapchat"),
    ("linkedin", _AT + r"linkedin\.com"),
    ("link aggregator", _AT + r"(?:linktr\.ee|linkin\.bio|beacons\.ai|bio\.link|taplink\.)"),
    ("whatsapp", _AT + r"(?:wa\.me|whatsapp\.com|api\.whatsapp)"),
    ("google business stub", _AT + r"business\.site"),
    ("free site builder", _AT + r"(?:blogspot\.|wordpress\.com|wixsite\.com|weebly\.com|blogger\.com|sites\.google\.com)"),
    ("delivery aggregator", _AT + r"(?:easymenu|hungerstation|jahez|talabat|zomato|foodpanda|deliveroo|ubereats|thechefz)"),
    ("google link", _AT + r"(?:google\.|maps\.app|goo\.gl)"),
    ("youtube", _AT + r"(?:youtube\.com|youtu\.be)"),
]


def classify_website(url: Column) -> Column:
    """'none', the label of a platform, or 'real site'."""
    out = F.when(url.isNull() | (F.trim(url) == ""), "none")
    for label, pattern in PLATFORMS:
        out = out.when(url.rlike(f"(?i){pattern}"), label)
    return out.otherwise("real site")


def plain(html: Column) -> Column:
    """Text without tags, white space squeezed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", ""), r"\s+", " ")), F.lit(""))


def commons_url(file: Column, base: str = "https://commons.wikimedia.org/wiki/Special:FilePath/") -> Column:
    """Address of a media file; spaces become underscores and slashes stay."""
    return F.concat(F.lit(base), F.regexp_replace(F.regexp_replace(F.url_encode(F.regexp_replace(file, " ", "_")), "%2F", "/"), "%7E", "~"))


def maps_url(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), lat.cast("string"), F.lit(","), lon.cast("string"))
