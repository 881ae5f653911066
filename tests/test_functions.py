"""Truth tables of the scalar functions."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from placewright.functions import fuzzy, hours, text
from placewright.functions.geo import BBox, haversine_m
from placewright.operators import leads, quality


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(expr(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_normalize_pairs():
    assert text.normalize("الْقَهْوَة") == text.normalize("القهوه")
    assert text.normalize("أحمد") == text.normalize("احمد") == text.normalize("إحمد")
    assert text.normalize("شارع ٩") == text.normalize("شارع ۹") == "شارع 9"
    assert text.normalize("Hardee's") == "hardees"
    assert text.normalize("Al-Nakheel  Mall!") == "al nakheel mall"
    assert text.normalize(None) == text.normalize("") == ""
    assert "،" in text.normalize("ا، ب")  # punctuation in the Arabic block stays


def test_tokens():
    assert text.tokenize("النخيل مول") == ["النخيل", "مول", "نخيل"]
    assert text.tokenize("coffee COFFEE cafe") == ["قهوه"]
    assert text.tokenize("coffee", expand=False) == ["coffee"]
    assert text.tokenize("الكافيه") == ["الكافيه", "كافيه"]  # articles go after synonyms
    assert text.search_text("Red Mall", None, "red") == "red مول"


def test_columns_follow_scalars(spark):
    names = ["Hardee's  Café", "مقهى الرياض", None, "plain ascii_name 7", "`tick", "", "STRASSE ß"]
    assert column(spark, names, text.normalized) == [text.normalize(n) for n in names]
    assert column(spark, names, text.tokens) == [text.tokenize(n) for n in names]
    assert column(spark, names, lambda c: text.tokens(c, expand=False)) == [text.tokenize(n, expand=False) for n in names]
    assert column(spark, names, text.romanized) == [text.romanize(n) for n in names]


def test_romanize():
    assert text.romanize("Latin only") == ""
    for a, b in (("كوفي هيل", "coffee hill"), ("بنك الجزيره", "bank aljazyrh"), ("مول", "mall")):
        assert fuzzy.token_set_ratio(text.romanize(a), b) >= 80


def test_ratios():
    assert fuzzy.ratio("", "") == 100 and fuzzy.ratio("abc", "abc") == 100
    assert math.isclose(fuzzy.ratio("abcd", "abxd"), 75.0)
    assert fuzzy.token_set_ratio("a b", "b a c") == 100 and fuzzy.token_set_ratio("", "a") == 0
    assert fuzzy.wratio("", "a") == 0 and fuzzy.wratio("pharmcy", "pharmacy") > 90
    assert fuzzy.wratio("ring", "a long ring of words") >= 82


def test_phones(spark):
    raw = [None, "", "abc", "+966 11 205", "00966112", "966500", "011 205 3727", "920020088", "9200", "55512345"]
    assert column(spark, raw, text.clean_phone) == [None, None, None, "+96611205", "+966112", "+966500", "+966112053727", "920020088", "9200", "+96655512345"]


def test_websites(spark):
    urls = [None, " ", "https://instagram.com/x", "https://linktr.ee/x", "https://notinstagram.com", "https://x.com/a", "http://shop.example.com", "https://my.business.site", "HTTPS://WA.ME/1", "https://fb.me/x"]
    assert column(spark, urls, text.classify_website) == ["none", "none", "instagram", "link aggregator", "real site", "twitter/x", "real site", "google business stub", "whatsapp", "facebook"]


@pytest.mark.parametrize(
    "spec,when,expected",
    [
        ("24/7", "2026-09-05 03:00", True), ("Mo-Su 06:00-02:00", "2026-09-05 01:00", True), ("Mo-Su 06:00-02:00", "2026-09-05 03:00", False),
        ("Sa-Th 08:00-23:00", "2026-09-04 12:00", False), ("Sa-Th 08:00-23:00", "2026-09-05 08:00", True), ("Sa-Th 08:00-23:00", "2026-09-05 23:00", False),
        ("Mo-Su 08:00-24:00", "2026-09-05 23:59", True), ("Mo-Su 08:00-12:00; Sa off", "2026-09-05 09:00", False), ("sunrise-sunset", "2026-09-05 09:00", None),
        ("24/7; PH off", "2026-09-05 09:00", None), ("Mo off", "2026-09-05 09:00", None), ("", "2026-09-05 09:00", None), (None, "2026-09-05 09:00", None),
    ],
)
def test_hours(spark, spec, when, expected):
    df = hours.with_intervals(spark.createDataFrame([(spec, datetime.fromisoformat(when))], "opening_hours string, w timestamp"))
    assert df.select(hours.is_open(F.col("intervals"), F.col("w"))).first()[0] is expected


def test_next_change_and_week(spark):
    df = hours.with_intervals(spark.createDataFrame([("Sa-Th 08:00-23:00", datetime(2026, 9, 5, 12, 0)), ("24/7", datetime(2026, 9, 5, 12, 0))], "opening_hours string, w timestamp"))
    rows = {r[0]: r[1:] for r in df.select("opening_hours", hours.next_change(F.col("intervals"), F.col("w")), hours.schedule(F.col("intervals"))).collect()}
    assert rows["Sa-Th 08:00-23:00"][0] == datetime(2026, 9, 5, 23, 0) and rows["24/7"][0] is None
    week = rows["Sa-Th 08:00-23:00"][1]
    assert [d["closed"] for d in week] == [False] * 4 + [True] + [False] * 2 and week[0]["periods"][0]["open"] == "08:00"
    assert rows["24/7"][1][3]["periods"][0]["close"] == "24:00"


def test_distance(spark):
    d = spark.range(1).select(haversine_m(46.6744, 24.7114, 46.6950, 24.7000)).first()[0]
    assert 2400 < d < 2700
    with pytest.raises(ValueError):
        BBox(2, 0, 1, 1)


def test_fit_chain_tags(spark):
    names = ["restaurant", "مطعم شعبي", "مستشفى طبي", "atm", None, "odd", "عيادة اسنان"]
    assert column(spark, names, leads.category_fit) == [1.0, 1.0, 0.95, 0.0, 0.55, 0.55, 1.0]
    chain = lambda c: leads.is_chain(text.normalized(c), F.lit(None).cast("string"), F.lit(""), F.lit(False))
    assert column(spark, ["Rosh Rayhaan by Rotana", "Hardee's", "Hardees Olaya", "Corner shop", "", None], chain) == [True, True, True, False, False, False]
    brands = lambda c: quality.brand_category(text.normalized(c))
    assert column(spark, ["Krispy Kreme", "krispy kreme olaya", "krispykreme", None], brands) == ["donuts", "donuts", None, None]
    tags = column(spark, [{"amenity": "cafe", "shop": "bakery"}, {"amenity": "x", "shop": "bakery"}, {}, None], quality.tag_category, "map<string,string>")
    assert tags == ["cafe", "bakery", None, None]
