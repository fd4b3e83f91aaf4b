"""Quality classifier by compression.

Two zstandard dictionaries are built, one of good and one of bad labelled text. A text is compressed in windows of WINDOW
bytes, each with either dictionary; x = (bytes with the bad one - bytes with the good one) / (their sum) says which of the
two it is more like. A logistic curve over x, fitted on labelled texts that the dictionaries haven't seen, makes x a
calibrated score.

Fitting uses a bounded sample of rows: at most SAMPLE labelled documents of each label, chosen by a hash of their id. Half of
them build the dictionaries, with windows spread evenly over each whole text, of SAMPLE_BYTES in all; the other half calibrate
by x of their whole texts, which the executors find. Scoring compresses every text whole, in one pass, without a shuffle.

Cases: null and empty texts have x = 0 and the score of that; labels of held-out rows, of ids without a document, and null
labels are not used; several labels for an id count each; with labels of one kind only, or none, the dictionaries are
empty and the score is the smoothed share of good labels; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifold.llm.shared import held_out, store, text_of, utf8

FOLDS, HELD = 3, 1
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, WINDOW, LEVEL = 2000, 6_000, 400_000, 2048, 3


@dataclass(frozen=True)
class Classifier:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def packers(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for d in (self.good, self.bad):
            extra = {}
            if d:
                extra["dict_data"] = zstandard.ZstdCompressionDict(d)
                extra["dict_data"].precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False, **extra))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.intercept, -50, 50)))


def difference(text: bytes, packers: list[zstandard.ZstdCompressor]) -> float:
    """Normalised difference of the compressed sizes of a whole text."""
    if not text:
        return 0.0
    good, bad = (sum(len(p.compress(text[k:k + WINDOW])) for k in range(0, len(text), WINDOW)) for p in packers)
    return (bad - good) / (bad + good)


def spread(text: bytes) -> bytes:
    """At most SAMPLE_BYTES of a text, in windows spread evenly over it, the first and the last among them."""
    if len(text) <= SAMPLE_BYTES:
        return text
    n, rest = -(-SAMPLE_BYTES // WINDOW), len(text) - SAMPLE_BYTES
    begins = [k * WINDOW + rest * k // (n - 1) for k in range(n)]
    return b"".join(text[at:at + min(WINDOW, SAMPLE_BYTES - k * WINDOW)] for k, at in enumerate(begins))


def dictionary(texts: list[bytes]) -> bytes:
    """Trained on the texts; if they are too few, their own bytes serve."""
    pieces = [t[k:k + WINDOW] for t in texts for k in range(0, len(t), WINDOW)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(texts)[:DICTIONARY_BYTES]


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, lightly held to 0; classes weigh the same, so that 0.5 lies between them."""
    scale = float(np.std(x)) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (y - p)) - 0.01 * w
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """From rows of labels outside the held-out fold."""
    own = labels.where(~held_out("doc_id", FOLDS, HELD) & F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"))
    own = own.withColumn("_h", F.md5(F.col("_id").cast("string")))
    # the sample's ids first: twice SAMPLE of each label at most, so that ids without a document leave enough
    ids = own.where("_y = 1").orderBy("_h").limit(2 * SAMPLE).unionByName(own.where("_y = 0").orderBy("_h").limit(2 * SAMPLE))
    texts = docs.select(F.col("doc_id").alias("_id"), text_of().alias("t"))
    rows = store(texts.join(F.broadcast(ids), "_id").select("_y", "_h", F.sha2(F.col("t").cast("binary"), 256).alias("_k"), "t"), "quality-sample")
    data = {}
    for y in (0, 1):  # only keys come to the driver, repeated as their rows are
        got = rows.where(F.col("_y") == y).groupBy("_h", "_k").agg(F.count(F.lit(1)).alias("n")).orderBy("_h", "_k").limit(SAMPLE).collect()
        data[y] = [(r["_h"], r["_k"]) for r in got for _ in range(min(r["n"], SAMPLE))][:SAMPLE]
    if min(len(data[0]), len(data[1])) < 4:
        share = (len(data[1]) + 1) / (len(data[0]) + len(data[1]) + 2)
        return Classifier(b"", b"", 0.0, math.log(share / (1 - share)))
    # even places build the dictionaries, odd ones calibrate
    parts = of_texts(rows, {k for y in (0, 1) for k in data[y][::2]}, lambda: spread, pa.binary(), "binary")
    model = Classifier(*(dictionary([bytes(parts[k]) for k in data[y][::2]]) for y in (1, 0)), 1.0, 0.0)

    def measure() -> Callable[[bytes], float]:
        packers = model.packers()
        return lambda t: difference(t, packers)

    xs = of_texts(rows, {k for y in (0, 1) for k in data[y][1::2]}, measure, pa.float64(), "double")
    x = np.array([xs[k] for y in (0, 1) for k in data[y][1::2]])
    y = np.array([y for y in (0, 1) for _ in data[y][1::2]])
    return Classifier(model.good, model.bad, *logistic(x, y))


def of_texts(rows: DataFrame, wanted: set[tuple[str, str]], use: Callable, kind: pa.DataType, name: str) -> dict:
    """use()(whole text) of each wanted key of rows, found by the executors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, left = use(), set(wanted)
        for batch in batches:
            out = []
            for h, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (h, k) in left:
                    left.discard((h, k))
                    out.append((h, k, value(t.as_py().encode("utf-8", "replace"))))
            h, k, v = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array(k, pa.string()), pa.array(v, kind)], ["h", "k", "v"])

    return {(r["h"], r["k"]): r["v"] for r in rows.select("_h", "_k", "t").mapInArrow(run, f"h string, k string, v {name}").collect()}


def classify(docs: DataFrame, model: Classifier, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out(id_column, FOLDS, HELD).alias("held_out"), text_of(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = model.packers()
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            view = memoryview(raw)
            x = np.array([difference(view[a:b], packers) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.float64)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
