r"""Language-model scores by a hidden Markov model.

Tokens are the ASCII-lower-cased words `[^\x20\x09-\x0D]+` of a text and one end. A word has a class, a hash of its last
three bytes; the end is a class of its own. The model is p(text) = p(classes) * product of p(token | class): the classes come
from a hidden Markov model with STATES states, a token from its class with add-one counts over the class's training tokens.
Baum-Welch trains the states: each task sums expected counts over its texts, Spark adds them up, and the driver gets the
sums, a table of fixed size. Training and scoring see each text whole. For training, texts are walked in segments of SEGMENT
tokens, all at once: products of the segments' steps give the forward and backward vectors at every cut exactly, and the
recursions inside the segments start from these, so memory and the chain of steps stay short for texts of any length.
Scoring runs the scaled forward recursion over each whole text, so its likelihood is exact.

Texts are read once. Chunks of about CHUNK_BYTES of text are kept in the shared folder as rows: distinct words (hashes of
64 bits, which name words from here on) in order, classes, and each text's tokens as numbers of these words. Word counts
travel packed: a row per chunk and range of hashes holds the chunk's words in the range with their counts. One group sums a
range, a slice of the vocabulary, and gives back the corpus counts of each chunk's words in it. The number of ranges grows
with the chunks' words, so no task or executor ever holds the vocabulary.

Cases: null and empty texts have the end as their only token; ids may repeat or be null; without training texts all counts
are 0 and the states stay as they begin; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifold.llm.shared import drop_stored, held_out, mix, partitions, ragged, returning, rows_at_once, slices, span_hashes, store, text_of, utf8, word_spans

FOLDS, HELD = 7, 2
STATES, CLASSES, ROUNDS, SEGMENT, CHUNK_BYTES = 6, 1024, 3, 256, 5 << 19
#: Words of all chunks that a range of hashes holds, about; segments that training walks at once; chunks that go to Python at once.
RANGE_WORDS, SEGMENTS, AT_ONCE = 1 << 20, 1 << 9, 2
END = 0  # hash and class of the end token
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of every token of all texts, end tokens included, and tokens per text."""
    n = len(offsets) - 1
    raw = _LOWER[raw]
    starts, ends, doc = word_spans(raw, offsets)
    hashes = span_hashes(raw, starts, ends)
    hashes[hashes == END] = 1
    tail = raw[ends - 1].astype(np.uint64)
    for back in (2, 3):
        inside = ends - back >= starts
        tail = tail * np.uint64(257) + np.where(inside, raw[np.maximum(ends - back, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    kind = (mix(tail) % np.uint64(CLASSES - 1)).astype(np.uint16) + np.uint16(1)
    counts = np.bincount(doc, minlength=n) + 1
    last = np.cumsum(counts) - 1
    own = np.ones(int(counts.sum()), bool)
    own[last] = False
    h, k = np.full(len(own), END, np.uint64), np.full(len(own), END, np.uint16)
    h[own], k[own] = hashes, kind
    return h, k, counts


CHUNK = "chunk long, n_words long, docs array<long>, held array<boolean>, sizes array<int>, words binary, classes binary, trained binary, tokens binary"


def chunked(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out(id_column, FOLDS, HELD).alias("held"), text_of(text_column).alias("text"), F.spark_partition_id().alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for part in slices(batch, 2, CHUNK_BYTES):
                h, k, sizes = tokens(*utf8(part.column(2)))
                words, first, index = np.unique(h, return_index=True, return_inverse=True)
                train = np.repeat(~part.column(1).to_numpy(zero_copy_only=False), sizes)
                counts = np.bincount(index[train], minlength=len(words))
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([(part.column(3)[0].as_py() << 32) + number], pa.int64()), "n_words": pa.array([len(words)], pa.int64()), "docs": pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                    "held": [part.column(1).to_pylist()], "sizes": pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())),
                    "words": [words.tobytes()], "classes": [k[first].tobytes()], "trained": [counts.astype("<u4").tobytes()], "tokens": [index.astype("<u4").tobytes()]})
                number += 1

    return rows.mapInArrow(returning(run), CHUNK)


def word_ranges(chunks: DataFrame, ranges: int) -> DataFrame:
    """A row per chunk and range of hashes with words in it: their hashes in order, classes and training counts in the chunk, packed."""
    cuts = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, kinds, counts in zip(*(batch.column(k) for k in range(4))):
                w, k, c = np.frombuffer(words.as_py(), np.uint64), np.frombuffer(kinds.as_py(), np.uint16), np.frombuffer(counts.as_py(), "<u4")
                at = np.concatenate(([0], np.searchsorted(w, cuts), [len(w)]))
                own = [(r, a, b) for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()] * len(own), pa.int64()), pa.array([r for r, _, _ in own], pa.int64()),
                                                  *(pa.array([x[a:b].tobytes() for _, a, b in own], pa.binary()) for x in (w, k, c))], ["chunk", "range", "words", "classes", "trained"])

    return chunks.select("chunk", "words", "classes", "trained").mapInArrow(returning(run), "chunk long, range long, words binary, classes binary, trained binary")


def corpus_counts(key: tuple, rows: pa.Table) -> pa.Table:
    """Of a range: the corpus counts of each chunk's words, in their order; and rows without a chunk, training tokens and distinct training words per class."""
    def flat(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)

    words, first, index = np.unique(flat("words", "<u8"), return_index=True, return_inverse=True)
    counts = np.zeros(len(words), np.int64)
    np.add.at(counts, index, flat("trained", "<u4").astype(np.int64))
    kinds = flat("classes", "<u2")[first]
    got = counts[index].astype("<i8")
    ends = np.cumsum([len(w.as_buffer()) // 8 for w in rows.column("words")])
    packed = [got[a:b].tobytes() for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist())]
    classes = np.unique(kinds[counts > 0])
    none, n = [None] * len(packed), len(classes)
    return pa.table({"chunk": pa.array(rows.column("chunk").to_pylist() + [None] * n, pa.int64()), "range": pa.array([key[0].as_py()] * (len(packed) + n), pa.int64()),
                     "counts": pa.array(packed + [None] * n, pa.binary()), "class": pa.array(none + classes.tolist(), pa.int32()),
                     "c": pa.array(none + np.bincount(kinds, counts, CLASSES).astype(np.int64)[classes].tolist(), pa.int64()),
                     "v": pa.array(none + np.bincount(kinds, counts > 0, CLASSES).astype(np.int64)[classes].tolist(), pa.int64())})


class Model:
    """Start, transition and emission probabilities over classes."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, class_totals: np.ndarray) -> Model:
        """Before training: the classes' shares, bent differently for each state by a fixed hash."""
        share = (class_totals + 1.0) / (class_totals + 1.0).sum()
        noise = mix(np.arange(STATES * CLASSES, dtype=np.uint64) + np.uint64(12345)).astype(np.float64) / 2.0**64
        emit = share * np.exp(noise.reshape(STATES, CLASSES) * 2)
        move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=1, keepdims=True))

    @classmethod
    def counted(cls, sums: np.ndarray, class_totals: np.ndarray) -> Model:
        """From summed expected counts; a little of each class's share keeps every class possible in every state."""
        start, move, emit = np.split(sums, [STATES, STATES + STATES * STATES])
        share = (class_totals + 1.0) / (class_totals + 1.0).sum()
        start, move, emit = start + 0.5, move.reshape(STATES, STATES) + 0.5, emit.reshape(STATES, CLASSES) + 50 * share
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def forward(model: Model, kinds: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each sequence of classes, by the scaled forward recursion over all at once."""
    order = np.argsort(-sizes, kind="stable")
    begin, size = starts[order], sizes[order]
    emit = np.ascontiguousarray(model.emit.T)
    total = np.zeros(len(size))
    alive = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    a = None
    for t, n in enumerate(alive.tolist()):
        e = emit[kinds[begin[:n] + t]]
        a = model.start * e if t == 0 else (a[:n] @ model.move) * e
        scale = a.sum(axis=1)
        a /= scale[:, None]
        total[:n] += np.log(scale)
    out = np.empty(len(size))
    out[order] = total
    return out


def expected(model: Model, kinds: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Baum-Welch sums over the sequences: starts, moves and emissions, in one array."""
    text, begin, size, number = segments(starts, sizes)
    entering, leaving, before = cut_vectors(model, kinds, text, begin, size, number)
    sums = np.zeros(STATES + STATES * STATES + STATES * CLASSES)
    order = np.argsort(-size, kind="stable")
    for at in range(0, len(order), SEGMENTS):
        own = order[at:at + SEGMENTS]
        sums += inside(model, kinds, begin[own], size[own], entering[own], leaving[own], before[own], number[own] == 0)
    return sums


def segments(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment of at most SEGMENT tokens: text, start, size and its number in the text."""
    parts = -(-sizes // SEGMENT)
    text, number = ragged(parts)
    return text, starts[text] + number * SEGMENT, np.minimum(SEGMENT, sizes[text] - number * SEGMENT), number


def products(model: Model, kinds: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each segment, up to a factor: what takes the distribution over states before its first token to the forward vector of its last."""
    out = np.empty((len(begin), STATES, STATES))
    emit = np.ascontiguousarray(model.emit.T)
    order = np.argsort(-size, kind="stable")
    for at in range(0, len(order), SEGMENTS):
        own = order[at:at + SEGMENTS]
        b, n = begin[own], size[own]
        p = emit[kinds[b]][:, :, None] * np.eye(STATES)
        alive = np.searchsorted(-n, -np.arange(int(n[0])), "left").tolist()
        for t in range(1, len(alive)):
            m = alive[t]
            q = (p[:m].reshape(-1, STATES) @ model.move).reshape(m, STATES, STATES) * emit[kinds[b[:m] + t]][:, None, :]
            p[:m] = q / q.sum(axis=(1, 2), keepdims=True)
        out[own] = p
    return out


def cut_vectors(model: Model, kinds: np.ndarray, text: np.ndarray, begin: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment: the distribution before its first token, the backward vector at its last token up to a factor, and the
    scaled forward vector at the last token of the segment before (0 for a text's first)."""
    n = len(text)
    entering, leaving, before = np.tile(model.start, (n, 1)), np.ones((n, STATES)), np.zeros((n, STATES))
    several = np.flatnonzero((number > 0) | (np.append(text[1:], -1) == text))  # of texts of two segments or more
    if not len(several):
        return entering, leaving, before
    product = np.zeros((n, STATES, STATES))
    product[several] = products(model, kinds, begin[several], size[several])
    by_number = several[np.argsort(number[several], kind="stable")]
    edges = np.searchsorted(number[by_number], np.arange(int(number.max()) + 2))
    for k in range(1, len(edges) - 1):
        own = by_number[edges[k]:edges[k + 1]]
        a = np.einsum("ni,nij->nj", entering[own - 1], product[own - 1])
        before[own] = a / a.sum(axis=1, keepdims=True)
        entering[own] = before[own] @ model.move
    for k in range(len(edges) - 2, 0, -1):
        own = by_number[edges[k]:edges[k + 1]]
        b = np.einsum("nij,nj->ni", product[own], leaving[own]) @ model.move.T
        leaving[own - 1] = b / b.sum(axis=1, keepdims=True)
    return entering, leaving, before


def inside(model: Model, kinds: np.ndarray, begin: np.ndarray, size: np.ndarray, entering: np.ndarray, leaving: np.ndarray, before: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Baum-Welch sums over segments, longest first, the moves into each from the one before it included."""
    emit = np.ascontiguousarray(model.emit.T)
    alive = np.searchsorted(-size, -np.arange(int(size[0])), "left").tolist()
    alphas, scales, emissions = [], [], []
    for t, n in enumerate(alive):
        e = emit[kinds[begin[:n] + t]]
        a = entering * e if t == 0 else (alphas[-1][:n] @ model.move) * e
        s = a.sum(axis=1, keepdims=True)
        alphas.append(a / s)
        scales.append(s)
        emissions.append(e)
    moves, gammas, beta = np.zeros((STATES, STATES)), [None] * len(alive), np.zeros((0, STATES))
    for t in range(len(alive) - 1, -1, -1):
        n, after = alive[t], len(beta)
        last = leaving[after:n] / (alphas[t][after:] * leaving[after:n]).sum(axis=1, keepdims=True)
        if after:
            coming = emissions[t + 1] * beta / scales[t + 1]
            moves += alphas[t][:after].T @ coming
            last = np.concatenate((coming @ model.move.T, last))
        beta = last
        gammas[t] = alphas[t] * beta
    moves += before.T @ (emissions[0] * beta / scales[0])
    seen = np.concatenate([kinds[begin[:n] + t] for t, n in enumerate(alive)])
    gamma = np.concatenate(gammas)
    by_class = np.array([np.bincount(seen, gamma[:, s], CLASSES) for s in range(STATES)])
    return np.concatenate((gammas[0][first].sum(axis=0), (moves * model.move).ravel(), by_class.ravel()))


def train_round(chunks: DataFrame, model: Model) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(STATES + STATES * STATES + STATES * CLASSES)
        for batch in batches:
            for held, size, classes, index in zip(*(batch.column(k) for k in range(4))):
                kinds = np.frombuffer(classes.as_py(), np.uint16)[np.frombuffer(index.as_py(), "<u4")]
                sizes, train = size.values.to_numpy().astype(np.int64), ~held.values.to_numpy(zero_copy_only=False)
                if train.any():
                    sums += expected(model, kinds, (np.cumsum(sizes) - sizes)[train], sizes[train])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["at", "value"])

    parts = chunks.select("held", "sizes", "classes", "tokens").mapInArrow(returning(run), "at long, value double")
    out = np.zeros(STATES + STATES * STATES + STATES * CLASSES)
    with rows_at_once(chunks.sparkSession, AT_ONCE):
        for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():  # a fixed number of rows
            out[r["at"]] = r["value"]
    return out


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text; logarithms are of base 10."""
    chunks = store(chunked(docs, id_column, text_column), "lm-chunks")
    n_words = chunks.agg(F.sum("n_words")).first()[0] or 0
    ranges = max(partitions(docs.sparkSession), -(-n_words // RANGE_WORDS))
    known = store(word_ranges(chunks, ranges).groupBy("range").applyInArrow(corpus_counts, "chunk long, range long, counts binary, class int, c long, v long"), "lm-counts", AT_ONCE)
    totals, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in known.where("chunk IS NULL").groupBy("class").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():  # at most CLASSES rows
        totals[r["class"]], distinct[r["class"]] = r["c"], r["v"]
    model = Model.first(totals)
    for _ in range(ROUNDS):
        model = Model.counted(train_round(chunks, model), totals)
    n, v = int(totals.sum()), int(distinct.sum())

    # a chunk's words are in order, and so are its ranges
    packed = known.where("chunk IS NOT NULL").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("range", "counts")))["counts"].alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.log10(n + v + 1)
        by_class = np.log10(totals + distinct + 1)
        for batch in batches:
            for docs_, held, size, classes, index, count in zip(*(batch.column(k) for k in range(6))):
                c, i = np.frombuffer(b"".join(count.as_py()), "<i8"), np.frombuffer(index.as_py(), "<u4")
                kinds = np.frombuffer(classes.as_py(), np.uint16)
                sizes = size.values.to_numpy().astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                own = np.log10(c + 1.0)
                sums = [np.add.reduceat(x[i], starts) for x in (own - base, own - by_class[kinds], (c > 0).astype(np.int64))]
                likely = forward(model, kinds[i], starts, sizes) / np.log(10)
                yield pa.RecordBatch.from_arrays([docs_.values, held.values, pa.array(sizes), pa.array(sums[2]), pa.array(np.full(len(sizes), n, np.int64)), pa.array(sums[0]), pa.array(sums[1] + likely)],
                                                 ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    joined = chunks.join(packed, "chunk").select("docs", "held", "sizes", "classes", "tokens", "counts")
    scores = joined.mapInArrow(returning(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = store(scores, "lm-scores", AT_ONCE)
    for done in (chunks, known):
        drop_stored(done)
    return out
