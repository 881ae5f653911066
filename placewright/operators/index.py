"""The weighted inverted index: postings, document lengths and document frequencies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.functions.text import tokens
from placewright.operators.corpus import final_category, live

# Weight of each field's tokens.
FIELDS = {"name_primary": 3, "name_ar": 3, "name_en": 3, "brand_name": 3, "category": 2, "address_freeform": 1}


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame

    def write(self, path: str) -> None:
        """Postings sorted by term, so that row groups outside a term or prefix are skipped."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "place_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")

    @staticmethod
    def read(spark, path: str) -> Index:
        return Index(*[spark.read.parquet(f"{path}/{x}") for x in ("postings", "lengths", "terms")])


def weighted_tokens(places: DataFrame) -> DataFrame:
    """place_id, term, tf."""
    df = live(places)

    def entry(w: int):
        return lambda t: F.struct(t.alias("term"), F.lit(w).alias("w"))

    entries = [F.transform(tokens(final_category() if c == "category" else F.col(c)), entry(w)) for c, w in FIELDS.items()]
    rows = df.select(F.col("id").alias("place_id"), F.explode(F.concat(*entries)).alias("e")).select("place_id", "e.term", "e.w")
    return rows.groupBy("place_id", "term").agg(F.sum("w").cast("int").alias("tf"))


def from_postings(postings: DataFrame) -> Index:
    """Lengths and document frequencies of postings (term, place_id, tf)."""
    lengths = postings.groupBy("place_id").agg(F.sum("tf").cast("int").alias("len"))
    return Index(postings.select("term", "place_id", "tf"), lengths, postings.groupBy("term").agg(F.countDistinct("place_id").cast("int").alias("df")))


def build(places: DataFrame) -> Index:
    """The index of a corpus. Postings are persisted: lengths and frequencies come from them, and queries read all three."""
    return from_postings(weighted_tokens(places).persist())


def stats(index: Index) -> DataFrame:
    return index.lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
