"""What the operators share: settled tables, size-checked joins, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many rows is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 20_000
#: Keys that are broadcast, at most, as they have too many rows for one task.
HOT_KEYS = 5_000
#: Texts are handed to Python in batches of at most this many rows and about this many bytes.
ARROW_ROWS, ARROW_BYTES = 1_000, 32 << 20

_own_roots: dict[str, str] = {}
_marked: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """Folder that every executor sees: spark.checkpoint.dir. Where that is unset a local master gets a folder of its own; a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that all executors see in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own_roots[app]


def app_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one. The file system removes it when the driver's JVM ends."""
    path = f"{shared_root(spark)}/{spark.sparkContext.applicationId}"
    if path not in _marked:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _marked.add(path)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{app_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most so many rows, else as it is. df should be settled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_by_key(rows: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with one(key, ..., n), which has a row for each key and n, how many of the `total` rows have it; n goes.

    Keys with more than a HOT_KEYS-th of the rows, at most HOT_KEYS, are broadcast, so that none of them lands in one
    task; the others are shuffled.
    """
    cut = total // HOT_KEYS
    hot, cold = F.broadcast(one.filter(F.col("n") > cut)), one.filter(F.col("n") <= cut)
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).drop("n").unionByName(rest.join(cold, key).drop("n"))


def small_batches(spark: SparkSession) -> None:
    """Texts vary from nothing to megabytes; ten thousand of them a batch is too much for a worker.

    Spark reads both limits from the session when a plan runs, so they are lowered there, for all that follows; they are never raised.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        if not 0 < _number(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Hand freed memory back to the system: glibc keeps what training has freed for the driver's lifetime. Elsewhere nothing is done."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _number(size: str) -> int:
    """A setting's number, with or without a byte unit."""
    size = size.strip().lower().removesuffix("b")
    return int(size[:-1]) << (10 * (1 + "kmgt".index(size[-1]))) if size[-1:] in "kmgt" and size else int(size)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for functions of one batch."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def text_columns(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text as string, null texts empty, under names of our own."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.col(c) for c in more],
    )


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, in whatever case: what an operator adds under them takes their place."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def with_doc_columns(docs: DataFrame, added: list[tuple[str, str]]) -> str:
    """DDL of docs' own columns plus added (name, type) ones."""
    have = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return ", ".join([have, *[f"`{n}` {t}" for n, t in added]])


def strings(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array end to end, and its n + 1 offsets. Nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if offs is not None and len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def parts(offsets: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def int_lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))

