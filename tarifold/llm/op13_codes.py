"""Vector codes: product quantisation with integer codebooks; nearest entries are found by Orchard's search.

Vectors become integers floor(4096 x) and are cut into PARTS equal consecutive parts. Each part position has a codebook of
ENTRIES entries, begun as that part of the vectors of the smallest ids, and refined ROUNDS times: every part is assigned to its nearest
entry (squared Euclidean distance; ties go to the lower index), and an entry becomes the rounded-down mean of its parts.

Orchard's search: for every entry the others are listed by distance from it. A query begins at some entry and goes through that
entry's list. A nearer entry is jumped to at once and its own list is taken from the start; entries already measured are marked
and passed over; the search ends where the list's distance from the current entry exceeds twice the query's distance from it,
since no entry beyond can be nearer or as near. All parts of a position advance side by side in numpy. Everything is in integers, so
results don't depend on how rows are dealt.

A round is one pass over the stored integers: a task sends back sums and counts per entry, a size that doesn't depend on the rows.

Cases: rows whose vector is null or holds null, NaN or infinite components are dropped; of vectors of different lengths those
of the most frequent length stay (of equally frequent ones the longest), and a length that PARTS doesn't divide is filled
with zeros; vectors without components have parts of no length, code 0 and error 0; null vec_ids come last when codebooks are begun, and equal
ids in the order of their vectors; with fewer rows than ENTRIES the codebooks are as short; null labels are one label; an integer
beyond 53 bits is rounded as doubles are and held within 62 bits, and an error or a sum beyond 63 bits is null; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarifold.llm.shared import store, task_sums

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers below this keep all distances within 64 bits; beyond, Python's integers do the work.
SMALL = 1 << 24


@dataclass(frozen=True)
class Codebooks:
    """Entries by part position: an array of positions, entries and components."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(e)) for e in self.entries.ravel()).encode()).hexdigest()


def kept(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = PARTS) -> DataFrame:
    """vec_id, label, size and the vector's integers as bytes of the rows that stay; a stored table."""
    v = F.col(vector_column).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = embeddings.where(fine).select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).alias("label"), v.alias("v"))
    schema = rows.select("vec_id", "label").schema.add("size", T.IntegerType()).add("x", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = np.clip(np.floor(lists.flatten().to_numpy(zero_copy_only=False) * SCALE), -(2.0 ** 62), 2.0 ** 62).astype("<i8").tobytes()
            ends = (np.concatenate(([0], np.cumsum(lengths))) * 8).tolist()
            data = [flat[a:b] + bytes(-(b - a) % (8 * parts)) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "label", "size", "x"])

    table = store(rows.mapInArrow(run, schema), "codes-rows")
    sizes = table.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return table.where(F.col("size") == (sizes[0]["size"] if sizes else 0))


def parted(vectors: list[bytes], parts: int) -> np.ndarray:
    """Integers as positions, rows and components."""
    width = len(vectors[0]) // (8 * parts) if vectors else 0
    return np.frombuffer(b"".join(vectors), "<i8").reshape(len(vectors), parts, width).transpose(1, 0, 2)


def pieces(column: pa.Array, parts: int) -> np.ndarray:
    """Integers as positions, rows and components; Python's integers where 64 bits might not do."""
    x = parted(column.to_pylist(), parts)
    return x.astype(object) if x.size and max(-int(x.min()), int(x.max())) >= SMALL else x


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def neighbours(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry of a codebook all entries by distance from it, itself first, and those squared distances."""
    wide = entries.astype(object) if entries.size and max(-int(entries.min()), int(entries.max())) >= SMALL else entries
    apart = squares(wide[:, None], wide[None, :])
    order = np.array([sorted(range(len(wide)), key=lambda j, i=i: (apart[i, j], j != i, j)) for i in range(len(wide))], np.int64).reshape(apart.shape)
    return order, np.take_along_axis(apart, order, axis=1)


def orchard(queries: np.ndarray, entries: np.ndarray, lists: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of each query's nearest entry (ties: the lower one) and the squared distance."""
    order, apart = lists or neighbours(entries)
    if queries.dtype == object or apart.dtype == object:
        queries, entries, apart = queries.astype(object), entries.astype(object), apart.astype(object)
    n, k = len(queries), len(entries)
    # begin at the entry whose components' sum is nearest: any start is right, a good one is short
    totals = entries.sum(axis=1)
    by_total = np.argsort(totals, kind="stable")
    at = by_total[np.minimum(np.searchsorted(totals[by_total], queries.sum(axis=1)), k - 1)]
    best = squares(queries, entries[at])
    seen = np.zeros((n, k), bool)
    seen[np.arange(n), at] = True
    place, live = np.zeros(n, np.int64), np.arange(n)
    while True:
        place[live] += 1
        live = live[place[live] < k]
        # beyond twice the distance, nothing is nearer or as near: squares beyond four times the square
        live = live[(apart[at[live], place[live]] <= 4 * best[live]).astype(bool)]
        if not len(live):
            return at, best
        other = order[at[live], place[live]]
        new = ~seen[live, other]
        q, e = live[new], other[new]
        seen[q, e] = True
        d = squares(queries[q], entries[e])
        nearer = ((d < best[q]) | ((d == best[q]) & (e < at[q]))).astype(bool)
        at[q[nearer]], best[q[nearer]], place[q[nearer]] = e[nearer], d[nearer], 0


def first_entries(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the vectors of the smallest ids."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()
    return np.ascontiguousarray(parted([bytes(r["x"]) for r in first], parts))


def refined(rows: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The codebooks after every part was assigned and every entry became its parts' mean. Entries without parts stay."""
    parts, k, width = entries.shape

    def fold(batches: Iterator[pa.RecordBatch]) -> tuple | None:
        sums, counts, lists = np.zeros((parts, k, width), object), np.zeros((parts, k), np.int64), [neighbours(e) for e in entries]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                for p, queries in enumerate(pieces(batch.column(0).slice(at, 4096), parts)):
                    codes, _ = orchard(queries, entries[p], lists[p])
                    counts[p] += np.bincount(codes, minlength=k)
                    own = np.zeros((k, width), queries.dtype)
                    np.add.at(own, codes, queries)
                    sums[p] += own
        return (sums, counts) if counts.any() else None

    got = task_sums(rows.select("x"), fold)
    if got is None:
        return entries
    sums, counts = got
    means = sums // np.maximum(counts, 1)[:, :, None]
    return np.where(counts[:, :, None] > 0, means, entries).astype(np.int64)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    books = first_entries(rows, parts, entries)
    for _ in range(rounds if books.size else 0):  # nothing to refine without components
        books = refined(rows, books)
    return Codebooks(books)


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error and codebooks_sha256 of every kept row."""
    entries, sha = books.entries, books.sha256()
    parts = len(entries)
    schema = rows.select("vec_id", "label").schema.add("code", T.StringType()).add("error", T.LongType()).add("codebooks_sha256", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [neighbours(e) for e in entries]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                codes, errors = zip(*(orchard(q, e, own) for q, e, own in zip(pieces(part.column(2), parts), entries, lists)))
                error = [x if x < 1 << 63 else None for x in map(int, sum(errors))]
                text = [c.tobytes().hex() for c in np.stack(codes, axis=1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64()), pa.array([sha] * part.num_rows)], schema.names)

    return rows.select("vec_id", "label", "x").mapInArrow(run, schema)


def decode(codes: DataFrame, books: Codebooks, code_column: str = "code") -> DataFrame:
    """The rows with `approximation`, the entries' components over SCALE, end to end."""
    entries = books.entries
    schema = T.StructType([*codes.schema.fields, T.StructField("approximation", T.ArrayType(T.DoubleType()))])
    column = codes.columns.index(code_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [None if c is None else np.concatenate([entries[p][e] for p, e in enumerate(bytes.fromhex(c))]) / SCALE for c in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], schema.names)

    return codes.mapInArrow(run, schema)


def compress(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (the errors of the row's label) and codebooks_sha256."""
    rows = kept(embeddings, id_column, vector_column, label_column)
    coded = store(encode(rows, fit(rows)), "codes-coded")
    # one row a label; stored, so that Spark knows its size when it plans the join
    labels = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"), F.max(F.col("error").isNull()).alias("beyond"))
    labels = store(labels.select(F.col("label").alias("own"), F.when(~F.col("beyond") & (F.col("s") <= F.lit((1 << 63) - 1)), F.col("s").cast("long")).alias("label_error")), "codes-labels")
    return coded.join(labels, coded["label"].eqNullSafe(labels["own"])).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
