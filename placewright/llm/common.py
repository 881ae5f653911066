"""Shared helpers: Arrow text buffers as numpy arrays, lineage cuts, bounded samples."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = b" \t\n\x0b\x0c\r"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Sessions and paths of the tables cut since the innermost ``settled`` function began.
_made: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("_made", default=None)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of fewer rows than Spark's default, unless the user has set a number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where that is unset: on a cluster the warehouse, on one machine a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/placewright-scratch"
    if not named:
        named = getattr(spark, "_placewright_scratch", None)
        if not named:
            named = tempfile.mkdtemp(prefix="placewright-")
            spark._placewright_scratch = named
            atexit.register(shutil.rmtree, named, True)
    return named


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Spark deletes the shuffle files of a query as it ends, not when the driver next collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch_dir(spark)}/placewright-{uuid.uuid4().hex}"
    if _made.get() is not None:
        _made.get().append((spark, path))
    with shuffles_freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._placewright_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settled(f: Callable) -> Callable:
    """``f``, with its result (a frame, or a tuple of frames and other values) cut and all other tables that it cut deleted.

    For functions that hand out nothing else which reads those tables.
    """

    def written(x):
        return cut(x) if isinstance(x, DataFrame) and "_placewright_path" not in vars(x) else x

    @functools.wraps(f)
    def run(*args, **options):
        own: list[tuple[SparkSession, str]] = []
        token, kept = _made.set(own), set()
        try:
            out = f(*args, **options)
            out = tuple(map(written, out)) if isinstance(out, tuple) else written(out)
            kept = {vars(x)["_placewright_path"] for x in (out if isinstance(out, tuple) else (out,)) if isinstance(x, DataFrame)}
        finally:
            _made.reset(token)
            for spark, path in own:
                if path not in kept:
                    delete(spark, path)
        if _made.get() is not None:
            _made.get().extend(x for x in own if x[1] in kept)
        return out

    return run


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number for each row, written so that it stays the same."""
    return cut(docs.withColumn(name, F.monotonically_increasing_id()))


def free(columns: list[str], name: str) -> str:
    """``name``, or a longer one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id) == 1, F.lit(False))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array without copying; nulls are empty."""
    n = len(column)
    if n == 0 or column.null_count == n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    wide = str(column.type).startswith("large")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may span bytes; close the gap
        lens = np.diff(offsets) * np.asarray(column.is_valid().to_numpy(zero_copy_only=False), np.int64)
        if lens.sum() != offsets[-1] - offsets[0]:
            keep = [raw[o : o + k] for o, k in zip(offsets[:-1], lens)]
            return np.concatenate(keep), np.concatenate([[0], np.cumsum(lens)])
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int):
    """(first, last) row ranges of at most ``most`` bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def smallest_hashed(df: DataFrame, group: str, k: int, seed: int, groups: int = 256) -> dict:
    """Up to about ``k`` ids of each value of ``group``, those of least seeded hash: {value: [doc_id]}.

    At most ``groups`` values are allowed and about ``4 k`` ids a value reach the driver, at any input size.
    """
    small_batches(df.sparkSession)
    sizes = df.groupBy(group).agg(F.approx_count_distinct("doc_id").alias("n")).limit(groups + 1).collect()
    if len(sizes) > groups:
        raise ValueError(f"more than {groups} values of {group}")
    if not sizes:
        return {}
    share = {r[0]: min(1.0, 4.0 * k / max(1, r[1])) for r in sizes}
    unit = (F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)).alias("u")
    bar = F.lit(0.0)
    for value, s in share.items():
        bar = F.when(F.col(group) == F.lit(value), F.lit(s)).otherwise(bar)
    rows = df.select(group, "doc_id", unit, bar.alias("bar")).where("u < bar OR bar >= 1").distinct().collect()
    out: dict = {v: [] for v in share}
    for r in sorted(rows, key=lambda r: (r["u"], r["doc_id"])):
        if len(out[r[0]]) < k:
            out[r[0]].append(r["doc_id"])
    return out


def blocks(docs: DataFrame, text: str, most: int, level: int = 1) -> DataFrame:
    """block, size (bytes of its texts), body (some ``most`` bytes of whole rows as an Arrow stream, compressed at a zstd ``level``), written."""

    def body(held: list) -> tuple[int, bytes]:
        table = pa.Table.from_batches(held)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as out:
            out.write_table(table.combine_chunks())
        return sink.getvalue().to_pybytes()

    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 20, [], 0
        for batch in batches:
            _, offsets = text_buffers(batch.column(text))
            for i, j in chunks(offsets, most):
                if held and size + offsets[j] - offsets[i] > most:
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size]), pa.array([body(held)], pa.binary())], ["block", "size", "body"])
                    number, held, size = number + 1, [], 0
                held.append(batch.slice(i, j - i))
                size += int(offsets[j] - offsets[i])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size]), pa.array([body(held)], pa.binary())], ["block", "size", "body"])

    return cut(docs.mapInArrow(run, "block long, size long, body binary"))


def unpacked(body) -> pa.Table:
    """Rows of a block."""
    return pa.ipc.open_stream(body.as_buffer()).read_all()


def numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column of numbers; a side of a cogroup that has no rows for a key may come without columns."""
    return table.column(name).to_numpy() if name in table.column_names else np.zeros(0, np.int64)
