"""Lineage cuts by tables in a folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, the warehouse on a cluster and a folder of our own on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/placewright-scratch"
    if not named:
        named = getattr(spark, "_placewright_shared", None)
        if not named:
            named = tempfile.mkdtemp(prefix="placewright-")
            spark._placewright_shared = named
            atexit.register(shutil.rmtree, named, True)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` and reads it back, so that a lost executor costs no recomputation of what led to it."""
    path = f"{shared_dir(df.sparkSession)}/placewright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
