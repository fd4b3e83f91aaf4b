"""Document fingerprints by locally consistent parsing.

The bytes of a text are parsed into phrases, these into longer phrases, and so on. On each level runs of one symbol become
one symbol; deterministic coin tossing then gives each symbol a colour that depends on few neighbours only: the lowest bit in
which it differs from its left neighbour, and that bit's value, repeated until six colours are left. Phrases begin where
a colour is greater than both neighbours'. Their names are hashes of what they hold. Equal substrings therefore have equal
phrases inside, at whatever offset, in all documents and on all executors.

A fingerprint holds REGISTERS registers of four hex digits ('----' if empty): of all phrases of level 2 and up, and the last
phrase that spans the text, those whose name falls in the register, the one with the least hash. The likeness of two
fingerprints is the share of equal registers among those that one of them has; two empty ones have 1.

The edited text of a document takes its tail from the document that follows in order of doc_id. Ranges of ids are dealt
to blocks by bounds found on ids alone; the first document of each block is sent to the block before it too. So texts
are shuffled once.

Cases: null texts count as empty; the empty text's fingerprint is all empty; of equal ids the lesser text comes first; null ids
come first, and after the last document comes the first whose id isn't null, or the first of all if all ids are null; a single document follows itself; an empty
table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarifold.llm.shared import _powers, id_bounds, mix, partitions, text_of

REGISTERS, LEAST_LEVEL, PART_BYTES = 64, 2, 1 << 20


def _toss(a: int, b: int) -> int:
    d = a ^ b
    k = (d & -d).bit_length() - 1
    return 2 * k + (a >> k & 1)


#: Next colour for (symbol, left neighbour): of bytes, and of colours below 128.
BYTE_COLOURS = np.array([[_toss(a, b) if a != b else 0 for b in range(256)] for a in range(256)], np.uint8)
COLOURS = BYTE_COLOURS[:128, :128].copy()


def parse(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of one level of all texts, one after the other, and how many each text has."""
    first = np.zeros(len(x) + 1, bool)
    first[np.cumsum(sizes) - sizes] = True
    runs = np.flatnonzero(first[:-1] | np.concatenate(([True], x[1:] != x[:-1])))
    symbol, length = x[runs], np.diff(np.append(runs, len(x))).astype(np.uint64)
    begins = first[runs]
    left = np.concatenate((symbol[:1], symbol[:-1]))
    left[begins] = ~symbol[begins]
    if symbol.dtype == np.uint8:
        colour = BYTE_COLOURS[symbol, left]
    else:
        d = symbol ^ left
        k = np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        colour = (np.uint64(2) * k + (symbol >> k & np.uint64(1))).astype(np.uint8)
    for _ in range(3):
        left = np.concatenate((colour[:1], colour[:-1]))
        left[begins] = colour[begins] ^ 1
        colour = COLOURS[colour, left]
    rising = np.concatenate(([True], colour[1:] > colour[:-1]))
    falling = np.concatenate(((colour[:-1] > colour[1:]) | begins[1:], [True]))  # a text's last symbol has no right neighbour
    starts = np.flatnonzero(begins | (rising & falling))
    ends = np.append(starts[1:], len(symbol))
    names = mix(mix(symbol.astype(np.uint64) + np.uint64(1)) + length)
    powers, inverse = _powers(len(names) + 1)
    sums = np.zeros(len(names) + 1, np.uint64)
    np.cumsum(names * powers[:len(names)], out=sums[1:])
    phrases = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    owner = np.cumsum(begins)[starts] - 1  # number of the text among those with symbols
    counts = np.zeros(len(sizes), np.int64)
    counts[np.flatnonzero(sizes)] = np.bincount(owner, minlength=int((sizes > 0).sum()))
    return phrases, counts


def registers(texts: list[bytes]) -> np.ndarray:
    """Register values of each text, -1 where empty."""
    n = len(texts)
    best = np.full(n * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    x = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    alive = np.arange(n)[sizes > 0]  # texts that haven't come down to one phrase
    sizes = sizes[sizes > 0]
    level = 0
    while len(alive):
        x, sizes = parse(x, sizes)
        level += 1
        done = sizes == 1
        rows = np.repeat(np.arange(len(alive)), sizes)
        use = np.ones(len(x), bool) if level >= LEAST_LEVEL else done[rows]
        h = mix(x[use] + np.uint64(level if level < LEAST_LEVEL else LEAST_LEVEL))
        np.minimum.at(best, alive[rows[use]] * REGISTERS + (x[use] % np.uint64(REGISTERS)).astype(np.int64), h)
        x, alive, sizes = x[~done[rows]], alive[~done], sizes[~done]
    out = (mix(best) & np.uint64(0xFFFF)).astype(np.int64)
    out[best == np.iinfo(np.uint64).max] = -1
    return out.reshape(n, REGISTERS)


def written(values: np.ndarray) -> list[str]:
    return ["".join("----" if v < 0 else f"{v:04x}" for v in row) for row in values.tolist()]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of register values, row by row."""
    either = ((a >= 0) | (b >= 0)).sum(axis=1)
    return np.where(either > 0, ((a == b) & (a >= 0)).sum(axis=1) / np.maximum(either, 1), 1.0)


def places(id_column: str, bounds: list[int]) -> Column:
    """Blocks of an id: its own, and with a sign of -1 - block the one before it if the id begins a block."""
    cuts = np.array(bounds or [0], np.int64)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        values = ids.fillna(0).to_numpy("int64")
        at = np.maximum(np.searchsorted(cuts, values, "right") - 1, 0)
        at[~known] = 0
        begins = known & (cuts[at] == values)
        return pd.Series([[a, -1 - (a - 1) % len(cuts)] if b else [a] for a, b in zip(at.tolist(), begins.tolist())])

    return of(F.col(id_column).cast("long"))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and likenesses of every document."""
    bounds = id_bounds(docs, id_column, partitions(docs.sparkSession))
    rows = docs.select(F.explode(places(id_column, bounds)).alias("place"), F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    rows = rows.select(F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("block"), (F.col("place") < 0).alias("ahead"), "doc_id", "text")
    if not bounds:  # no id begins a block: the least text does
        least = docs.agg(F.min(text_of(text_column)).alias("text")).where("text IS NOT NULL")
        rows = rows.unionByName(least.select(F.lit(0).alias("block"), F.lit(True).alias("ahead"), F.lit(None).cast("long").alias("doc_id"), "text"))
    ordered = rows.repartition(max(1, len(bounds)), "block").sortWithinPartitions("block", "ahead", F.col("doc_id").asc_nulls_first(), "text")

    def finish(held: list[tuple]) -> pa.RecordBatch:
        """Rows for all held documents that are their block's own and have a follower in the list."""
        texts = [t for _, _, _, t in held]
        edited, own = [], []
        for k in range(len(held) - 1):
            if not held[k][1]:
                half = len(texts[k]) // 2
                edited.append((texts[k][:len(texts[k]) - half] + texts[k + 1][:half]).encode("utf-8", "replace"))
                own.append(k)
        values = registers([t.encode("utf-8", "replace") for t in texts] + edited)
        at = np.array(own, np.int64)
        mine, following, changed = values[at], values[at + 1], values[len(texts):]
        return pa.RecordBatch.from_arrays(
            [pa.array([held[k][2] for k in own], pa.int64()), pa.array([len(texts[k]) for k in own], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
             pa.array(written(mine), pa.string()), pa.array(written(changed), pa.string()), pa.array(likeness(mine, changed), pa.float64()), pa.array(likeness(mine, following), pa.float64())],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                row = (*row[:3], row[3].as_py())
                held.append(row)
                size += len(row[3])
                if size >= PART_BYTES:
                    yield finish(held)
                    held, size = held[-1:], len(held[-1][3])
        if held:
            yield finish(held)

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
