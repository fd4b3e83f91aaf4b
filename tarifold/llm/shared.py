"""Shared-folder tables, ordered blocks of documents and vectorised text helpers of the document operators."""

from __future__ import annotations

import ctypes
import gc
import math
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space: 0x20 and 0x09 to 0x0D. Words are the runs of other characters.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session without the setting gets a temporary one; a cluster must have it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


@contextmanager
def rows_at_once(spark: SparkSession, n: int | None) -> Iterator[None]:
    """Within: the number of rows that go to Python at once, for functions over rows so large that the session's number of them wouldn't fit."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    if n is not None:
        spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, usual)


def store(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, and survives lost executors.

    batch: rows that go to Python at once, as in rows_at_once()."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with rows_at_once(spark, batch):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete a table that store() wrote, when nothing will read it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of the table has: each is given underscores until it is free."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """The table's columns by name, whatever signs the names hold; helper columns beside them are left out."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free_exchanges(spark: SparkSession) -> None:
    """Let Spark delete the exchange files of queries that are over: it does so when the driver's JVM collects their plans."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, giving freed memory back to the system when its task ends: Spark keeps idle Python workers."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
            if trim is not None:
                trim(0)

    return wrapped


def sample_texts(docs: DataFrame, n: int, id_column: str, text_column: str) -> pa.Array:
    """Whole texts of the n ids whose MD5 is least, in its order, one text an id (that of least hash). Rows without an id aren't sampled.

    Only ids are ordered; texts are read of the sampled ids alone."""
    ids = docs.select(F.col(id_column).cast("string").alias("i")).where("i IS NOT NULL").select(F.md5("i").alias("h"))
    least = ids.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).orderBy("h").limit(n).select("h")  # at most n rows
    rows = docs.select(F.md5(F.col(id_column).cast("string")).alias("h"), text_of(text_column).alias("t"))
    texts = rows.join(F.broadcast(least), "h").groupBy("h").agg(F.min_by("t", F.struct(F.xxhash64("t"), F.col("t"))).alias("t")).orderBy("h").select("t").toArrow()
    return texts.column("t").combine_chunks() if texts.num_rows else pa.array([], pa.string())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """A text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(id_column: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def id_bounds(ids: DataFrame, id_column: str, n: int) -> list[int]:
    """Least id of each of about n ranges of ids with like numbers of rows, ascending: one value per range comes to the driver."""
    ranges = (ids.select(F.col(id_column).cast("long").alias("i")).where("i IS NOT NULL").repartitionByRange(n, "i")
              .groupBy(F.spark_partition_id().alias("p")).agg(F.min("i").alias("i")))
    return sorted({r.i for r in ranges.collect()})


def block_of(id_column: str, bounds: list[int]) -> Column:
    """Number of the range of an id; ids below the first bound, and null, are in range 0. Only ids go to Python."""
    cut = np.array(bounds[1:], dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def block(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cut, ids.fillna(-(1 << 63)).to_numpy("int64"), "right").astype("int32"))

    return block(F.col(id_column).cast("long"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts or binaries of a column, and where each starts (one more at the end). No null may be left in it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset:] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text (or of a binary column); a longer text is a part of its own."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[ord(c) for c in SPACES]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets] = True
    before = np.concatenate(([True], space[:-1]))
    after = np.concatenate((space[1:], [True]))
    starts = np.flatnonzero(~space & (before | first[:-1]))
    ends = np.flatnonzero(~space & (after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n + (1 << 16), base, dtype=np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from running sums of byte times power."""
    powers, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def counts_of(index: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, minlength=n)


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and position in its row of each element of rows with these lengths."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class UnitIds:
    """Ids of text units, found once per distinct unit. Memory is bounded: beyond `most` units the table starts anew."""

    def __init__(self, encode, most: int = 200_000):  # noqa: ANN001
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.at: dict = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, units: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units in their order, and how many each unit has."""
        at = self.at
        fresh = list(set(units).difference(at))
        if fresh:
            if len(at) + len(fresh) > self.most and at:
                self.clear()
                at, fresh = self.at, list(set(units))
            flat, lengths = self.encode(fresh)
            at.update(zip(fresh, range(len(at), len(at) + len(fresh))))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.flat = np.concatenate((self.flat, flat))
        index = np.fromiter(map(at.__getitem__, units), np.int64, len(units))
        lengths = self.lengths[index]
        rows, pos = ragged(lengths)
        return self.flat[self.starts[index][rows] + pos], lengths


def task_sums(rows: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], tuple | None]) -> tuple | None:
    """The sums, place by place, of the tuples that fold() makes of each task's batches; None where no task gives one.

    fold() gives arrays of a size that doesn't depend on the rows. Tasks' tuples are added up by about the square root of
    their number of tasks first, so the driver adds few."""
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = fold(batches)
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(got)], pa.binary())], ["sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for got in batch.column(0).to_pylist():
                total = add(total, pickle.loads(got))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["sums"])

    def add(total: tuple | None, got: tuple) -> tuple:
        return got if total is None else tuple(a + b for a, b in zip(total, got))

    tasks = rows.mapInArrow(one, "sums binary")
    n = max(1, math.isqrt(max(1, rows.rdd.getNumPartitions())))
    total = None
    for r in tasks.repartition(n).mapInArrow(added, "sums binary").collect():  # n rows
        total = add(total, pickle.loads(r["sums"]))
    return total
