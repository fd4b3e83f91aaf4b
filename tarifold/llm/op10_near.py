"""Near-duplicate documents by ProbMinHash.

A text is the weighted set of its five-word shingles (weight: 1 + ln of how often it has the shingle, so that repeats in a
text don't outweigh the rest; a text of one to four words has
them all as one shingle). Each shingle sends a Poisson stream of arrivals, at the rate of its weight, to random registers;
a register keeps the shingle that arrived first, so two texts agree in a register with the probability Jaccard likeness of
their weighted sets. Streams of a text end when their next arrival comes after the latest first arrival of any register.
A text that repeats shingles is also signed with all weights 1 (by the same streams), since plain likeness counts too; for
other texts both signatures are the same.

BANDS bands of ROWS registers of each signature give candidates. Texts with the same weighted set are one node from the start, so a group of
copies is one row in all that follows. In a band's bucket nodes are paired with the least node of the bucket and with the
least of a small part of it (parts of about PART nodes); pairs are verified on their whole shingle
sets in two rounds: first each node with the least of its bucket heads, and, after linking, all other pairs that still
join different classes. Buckets that hold nodes of different classes after that are searched in rounds: their nodes are parted by
registers from outside the band into blocks of about BLOCK sketches (a byte of each register of each signature), and each node
is verified with its closest partner of another class that it hasn't met. Each round deals the blocks anew, so their pairs and rows grow
in proportion to the nodes of a bucket. Rounds end when one links fewer than one in FEW of its pairs, since
what they leave is searched whole: all blocks of a bucket, of about BLOCK_BYTES of sketches and sets, then meet each other, and every
promising pair of different classes is verified where its blocks meet, so that no link depends on rounds. No pairs are listed: a meeting
gives the links that join its classes, fewer than it has nodes. Its time is still the square of a bucket's size in the worst
case, and its rows the square of a bucket's bytes over BLOCK_BYTES. exact=False leaves this last search out, goes on
with rounds until one links nothing, and may miss links. Pairs for which both signatures agree far too little
are left out before the sets are joined. Likeness is probability Jaccard or plain Jaccard of the sets, whichever is greater.
Classes are the connected components; their id is the least doc_id.

Cases: null, empty and wordless texts are one class; null doc_ids come out with their class, whose id is the least id that
isn't null; rows with an equal doc_id are each classed; an empty table gives no rows; other columns aren't read by classes()
and are kept by first_of_each(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifold.llm.shared import drop_stored, free_exchanges, mix, ragged, returning, slices, span_hashes, store, text_of, unused, utf8, word_spans

SHINGLE, LIKENESS, BANDS, ROWS, PART, BLOCK = 5, 0.8, 32, 6, 8, 256
#: A round that links fewer than one in FEW of its pairs is the last before all blocks meet.
FEW = 8
#: Bytes of sketches and sets in a block of the last search.
BLOCK_BYTES = 1 << 20
#: Blocks that go to Python at once.
BLOCKS_BATCH = 8
#: Estimated likeness from which a pair is verified: its registers' standard error at LIKENESS is 0.03, so a true link has odds of one in a million to fall below.
ESTIMATE = 0.65
BITS = 1 << 23
REGISTERS = BANDS * ROWS
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight of each distinct shingle, by text and hash."""
    n_texts = len(offsets) - 1
    starts, ends, doc = word_spans(raw, offsets)
    words = span_hashes(raw, starts, ends)
    n_words = np.bincount(doc, minlength=n_texts)
    n_own = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    rows, pos = ragged(n_own)
    first = (np.cumsum(n_words) - n_words)[rows] + pos
    width = np.minimum(n_words, size)[rows]
    h = np.zeros(len(rows), np.uint64)
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    for k in range(size):
        factor = np.uint64((2 * k + 1) * 0xD6E8FEB86659FD93 % (1 << 64) | 1)
        h += np.where(k < width, padded[first + k] * factor, np.uint64(0))
    h = mix(h + width.astype(np.uint64))
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, np.int64)
    return rows[new], h[new], np.diff(np.append(new, len(h)))


def weight(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def signatures(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_texts: int, registers: int = REGISTERS) -> np.ndarray:
    """The shingle in each register of each text (0 where a text has none)."""
    arrival = np.full(n_texts * registers, np.inf)
    winner = np.zeros(n_texts * registers, np.uint64)
    at, seed, time = np.arange(len(rows)), mix(elements + _STEP), np.zeros(len(rows))
    while len(at):
        seed = mix(seed + _STEP)
        time = time - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weights[at]
        slot = rows[at] * registers + (mix(seed ^ _STEP) % np.uint64(registers)).astype(np.int64)
        better = np.flatnonzero(time < arrival[slot])
        np.minimum.at(arrival, slot[better], time[better])
        won = better[time[better] == arrival[slot[better]]]
        winner[slot[won]] = elements[at[won]]
        live = time < arrival.reshape(n_texts, registers).max(axis=1)[rows[at]]
        at, seed, time = at[live], seed[live], time[live]
    return winner.reshape(n_texts, registers)


def bands_of(registers: np.ndarray) -> np.ndarray:
    """A hash of each band of each signature."""
    bands = np.tile(mix(np.arange(BANDS, dtype=np.uint64)), (len(registers), 1))
    for k in range(ROWS):
        bands = mix(bands * np.uint64(3) + registers[:, k::ROWS] + np.uint64(k))
    return bands


def low_bytes(registers: np.ndarray) -> np.ndarray:
    return (registers & np.uint64(255)).astype(np.uint8)


def both_sketches(column: list[bytes]) -> np.ndarray:
    """Low bytes of the weighted and of the plain signature; a sketch that isn't followed by a plain one stands for both."""
    return np.frombuffer(b"".join(s if len(s) > REGISTERS else s + s for s in column), np.uint8).reshape(-1, 2, REGISTERS)


def text_key(text_column: str = "text") -> Column:
    """128 bits that name a text."""
    return F.unhex(F.md5(text_of(text_column).cast("binary")))


def sign(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, node (128 bits that name the weighted set), bands, the registers' low bytes, the distinct shingles with weights as bytes, and the text's key.

    Bands and low bytes are those of the weighted signature, followed by those of the plain one where it can differ."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"), text_key(text_column).alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                raw, offsets = utf8(part.column(1))
                n = part.num_rows
                doc, h, weights = shingles(raw, offsets)
                registers = signatures(doc, h, weight(weights), n)
                sketches, bands = [x.tobytes() for x in low_bytes(registers)], list(bands_of(registers))
                repeats = np.zeros(n, bool)
                repeats[doc[weights > 1]] = True
                again = np.flatnonzero(repeats)
                if len(again):
                    own = repeats[doc]
                    plain = signatures((np.cumsum(repeats) - 1)[doc[own]], h[own], np.ones(own.sum()), len(again))
                    for k, low, more in zip(again.tolist(), low_bytes(plain), bands_of(plain)):
                        sketches[k] += low.tobytes()
                        bands[k] = np.union1d(bands[k], more)
                name = np.zeros((n, 2), np.uint64)
                for k in (0, 1):
                    np.add.at(name[:, k], doc, mix(mix(h + np.uint64(k + 1)) + weights.astype(np.uint64)))
                sizes = np.bincount(doc, minlength=n)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                short, counts = h.astype("<u4"), np.minimum(weights, (1 << 32) - 1).astype("<u4")
                sets = [short[a:b].tobytes() + (counts[a:b].tobytes() if counts[a:b].max(initial=1) > 1 else b"") for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.tobytes() for x in name], pa.binary()), pa.array(sizes, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bands)]), pa.int32()), pa.array(np.concatenate(bands).view(np.int64))),
                     pa.array(sketches, pa.binary()), pa.array(sets, pa.binary()), part.column(2)],
                    ["doc_id", "node", "n_shingles", "bands", "sketch", "shingles", "text_key"])

    return rows.mapInArrow(run, "doc_id long, node binary, n_shingles int, bands array<long>, sketch binary, shingles binary, text_key binary")


def likeness(a: bytes, n_a: int, b: bytes, n_b: int) -> float:
    """Probability Jaccard or plain Jaccard of two weighted sets of so many shingles, whichever is greater. Weights of 1 aren't written."""
    ha, hb = np.frombuffer(a, "<u4", n_a), np.frombuffer(b, "<u4", n_b)
    wa, wb = (weight(np.frombuffer(s, "<u4", n, 4 * n)) if len(s) > 4 * n else np.ones(n) for s, n in ((a, n_a), (b, n_b)))
    common = np.intersect1d(ha, hb)
    if not len(common):
        return 0.0
    plain = len(common) / (len(ha) + len(hb) - len(common))
    if plain >= LIKENESS or len(a) == 4 * n_a and len(b) == 4 * n_b:  # with weights of 1 both are the same
        return plain
    # sum over common d of 1 / sum over e of max(a_e / a_d, b_e / b_d), with the ratios b_e / a_e in order
    union = np.union1d(ha, hb)
    va, vb = np.zeros(len(union)), np.zeros(len(union))
    va[np.searchsorted(union, ha)] = wa
    vb[np.searchsorted(union, hb)] = wb
    ratio = np.where(va > 0, vb / np.maximum(va, 1e-300), np.inf)
    order = np.argsort(ratio, kind="stable")
    below = np.concatenate(([0.0], np.cumsum(va[order])))
    above = np.concatenate((np.cumsum(vb[order][::-1])[::-1], [0.0]))
    own = np.searchsorted(union, common)
    cut = np.searchsorted(ratio[order], ratio[own], "right")
    return max(plain, float(np.sum(1.0 / (below[cut] / va[own] + above[cut] / vb[own]))))


def agreement(same: np.ndarray) -> np.ndarray:
    """Estimated likeness from the share of equal low bytes."""
    return (same - 1 / 256) / (1 - 1 / 256)


def promising(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose registers' low bytes agree as those of alike sets do, for either signature."""
    left = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (both_sketches(batch.column(k).to_pylist()) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(agreement((x == y).mean(axis=2).max(axis=1)) >= ESTIMATE))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def close_pairs(block: list[bytes], closest: bool) -> Iterator[tuple[bytes, bytes, float]]:
    """Promising pairs of different classes among entries of node, root, side and sketch; with both sides, pairs across them.

    With closest, a pair for each node that has one."""
    entries, sketches = np.frombuffer(b"".join(e[:33] for e in block), np.uint8).reshape(-1, 33), both_sketches([e[33:] for e in block])
    side = entries[:, 32] == ord("1")
    one, two = (entries[~side], entries[side]) if side.any() else (entries, entries)
    sketch_one, sketch_two = (sketches[~side], sketches[side]) if side.any() else (sketches, sketches)
    most = np.zeros((len(one), len(two)), np.uint8)
    for kind in range(2 if any(len(e) > 33 + REGISTERS for e in block) else 1):
        same = np.zeros_like(most)
        for k in range(REGISTERS):
            same += sketch_one[:, kind, k, None] == sketch_two[None, :, kind, k]
        most = np.maximum(most, same)
    agree = agreement(most / REGISTERS)
    root_one, root_two = (np.ascontiguousarray(x[:, 16:32]).view("V16").ravel() for x in (one, two))
    agree[root_one[:, None] == root_two[None, :]] = 0.0
    if closest:
        found = np.concatenate((np.stack((np.arange(len(one)), agree.argmax(axis=1)), axis=1), np.stack((agree.argmax(axis=0), np.arange(len(two))), axis=1)))
        found = found[agree[found[:, 0], found[:, 1]] >= ESTIMATE]
    else:
        found = np.argwhere(agree >= ESTIMATE)
    for i, j in found:
        a, b = one[i, :16].tobytes(), two[j, :16].tobytes()
        yield min(a, b), max(a, b), float(agree[i, j])


def joining_pairs(node: list[bytes], root: list[bytes], side: np.ndarray, sketch: list[bytes], sizes: np.ndarray, sets: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Alike pairs of entries that join their classes: every promising pair of classes that aren't joined yet is verified.

    With both sides, pairs across them."""
    _, group = np.unique(np.array(root, "V16"), return_inverse=True)
    both = both_sketches(sketch)
    kinds = [np.ascontiguousarray(both[:, k]) for k in range(2 if any(len(x) > REGISTERS for x in sketch) else 1)]
    weighted = np.array([len(x) for x in sets]) > 4 * sizes
    one, two = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(node)),) * 2
    flat, starts, mark = None, None, None
    for k, i in enumerate(one):
        rest = two if side.any() else two[k + 1:]
        rest = rest[group[rest] != group[i]]
        if not len(rest):
            continue
        same = np.max([np.count_nonzero(x[rest] == x[i], axis=1) for x in kinds], axis=0)
        rest = rest[agreement(same / REGISTERS) >= ESTIMATE]
        if not len(rest):
            continue
        if flat is None:  # places of the elements among all of the block
            values, flat = np.unique(np.concatenate([np.frombuffer(x, "<u4", n) for x, n in zip(sets, sizes)]), return_inverse=True)
            starts, mark = np.cumsum(sizes) - sizes, np.zeros(len(values), bool)
        own = flat[starts[i]:starts[i] + sizes[i]]
        mark[own] = True
        rows, pos = ragged(sizes[rest])
        common = np.bincount(rows, mark[flat[starts[rest][rows] + pos]], len(rest))
        mark[own] = False
        plain = common / (sizes[i] + sizes[rest] - common)
        for j, alike in zip(rest[np.argsort(-plain, kind="stable")].tolist(), -np.sort(-plain)):
            if group[i] == group[j] or alike < LIKENESS and not (weighted[i] or weighted[j]):
                continue
            if alike >= LIKENESS or likeness(sets[i], int(sizes[i]), sets[j], int(sizes[j])) >= LIKENESS:
                group[group == group[j]] = group[i]
                yield min(node[i], node[j]), max(node[i], node[j])


def found_in(blocks: DataFrame) -> DataFrame:
    """The closest pairs (a, b, agree) of each block's entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                found = list(close_pairs(block.as_py(), True))
                if found:
                    a, b, agree = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(agree)], ["a", "b", "agree"])

    return blocks.select("entries").mapInArrow(run, "a binary, b binary, agree double")


def rooted(crowded: DataFrame, roots: DataFrame) -> DataFrame:
    return crowded.select("bucket", "node", "bytes").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def mixed_buckets(crowded: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their buckets and roots, and the buckets whose nodes are of several classes: n, bytes, main (n, root and bytes of the greatest)."""
    placed = rooted(crowded, roots)
    sizes = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).groupBy("bucket").agg(
        F.max(F.struct("n", "root", "bytes")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    return placed, sizes.where("n > 2 AND n > main.n")


def partners(crowded: DataFrame, roots: DataFrame, sketches: DataFrame, tried: DataFrame, turn: int) -> DataFrame:
    """For each node of a mixed bucket, the pair (a, b) with its closest partner of another class that it wasn't tried with.

    A node is in one block of each of its buckets: that of the nodes that agree with it in some further registers, dealt to
    blocks of about BLOCK where they are more. So rows and pairs are at most nodes times bands."""
    placed = rooted(crowded, roots)
    mixed = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("least"), F.max("root").alias("greatest"))
    placed = placed.join(mixed.where("n > 2 AND least <> greatest").select("bucket", "n"), "bucket").drop("bytes").join(sketches, "node")
    more = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BLOCK))).cast("int")
    at = (F.lit(1) + F.pmod(F.xxhash64("bucket", F.lit(turn)), F.lit(REGISTERS) - F.least(more, F.lit(REGISTERS - 1)))).cast("int")
    placed = placed.withColumn("part", F.xxhash64("bucket", F.col("sketch").substr(at, more)))
    sizes = placed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = placed.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("blocks")))
    blocks = dealt.groupBy("part", "block").agg(F.collect_list(F.concat("node", "root", F.lit("0").cast("binary"), "sketch")).alias("entries"))  # about BLOCK
    fresh = found_in(blocks).groupBy("a", "b").agg(F.max("agree").alias("agree")).join(tried, ["a", "b"], "left_anti")
    ends = fresh.select(F.col("a").alias("node"), "a", "b", "agree").unionByName(fresh.select(F.col("b").alias("node"), "a", "b", "agree"))
    return ends.groupBy("node").agg(F.max(F.struct("agree", "a", "b")).alias("p")).select("p.a", "p.b").distinct()


def across(crowded: DataFrame, roots: DataFrame, signed: DataFrame) -> DataFrame:
    """Alike pairs (a, b) that join the classes of every bucket's nodes.

    The nodes of a bucket's greatest class are dealt to blocks of about BLOCK_BYTES, the others to further blocks; blocks of the greatest
    class meet the further blocks, and these meet all. So a bucket with few nodes outside its greatest class costs about its bytes."""
    placed, mixed = mixed_buckets(crowded, roots)
    whole = F.col("bytes") <= BLOCK_BYTES  # one block holds the bucket
    mixed = mixed.select(
        "bucket", F.col("main.root").alias("main"), F.when(whole, 0).otherwise(F.ceil(F.col("main.bytes") / BLOCK_BYTES)).alias("mains"),
        F.when(whole, 1).otherwise(F.ceil((F.col("bytes") - F.col("main.bytes")) / BLOCK_BYTES)).alias("others"))
    placed = placed.drop("bytes").join(mixed, "bucket").withColumn("is_main", F.expr("mains > 0 AND root = main"))
    placed = placed.withColumn("block", F.expr("IF(is_main, pmod(xxhash64(node), greatest(mains, 1)), mains + pmod(xxhash64(node), others))"))
    placed = placed.select("node", "root", "bucket", "block", F.explode(F.expr("sequence(IF(is_main, mains, 0), mains + others - 1)")).alias("mate"))
    own = sifted(signed.select("node", "sketch", "n_shingles", "shingles"), placed).dropDuplicates(["node"])
    entry = F.struct("node", "root", (F.col("block") > F.col("mate")).cast("int").alias("side"), "sketch", "n_shingles", "shingles")
    blocks = placed.join(own, "node").groupBy("bucket", F.least("block", "mate").alias("i"), F.greatest("block", "mate").alias("j")).agg(
        F.collect_list(entry).alias("entries"))  # about two blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                node, root, side, sketch, sizes, sets = (block.values.field(k) for k in range(6))
                found = list(joining_pairs(node.to_pylist(), root.to_pylist(), side.to_numpy(), sketch.to_pylist(), sizes.to_numpy().astype(np.int64), sets.to_pylist()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found)], ["a", "b"])

    return blocks.select("entries").mapInArrow(returning(run), "a binary, b binary").distinct()


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are alike. sets: a row per node with its shingles."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("n_shingles").alias("na"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("n_shingles").alias("nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [likeness(x.as_py(), m.as_py(), y.as_py(), n.as_py()) >= LIKENESS for x, m, y, n in zip(*(batch.column(k) for k in range(2, 6)))]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "na", "sb", "nb").mapInArrow(run, "a binary, b binary")


def ends(pairs: DataFrame, name: str) -> DataFrame:
    """Each node of the pairs (a, b) once: one exchange."""
    return pairs.select(F.explode(F.array("a", "b")).alias(name)).distinct()


def sieve(wanted: DataFrame, key: Column) -> Callable[[Column], Column]:
    """A test of a 64-bit hash that passes those of the wanted rows and some others: a bitmap of BITS bits, a fixed size.

    It saves shuffling what isn't wanted. With so many wanted rows that the bitmap fills up, it lets all through, and the join
    that follows is as right."""
    slot = F.pmod(key, F.lit(BITS))
    rows = wanted.select(slot.alias("s")).groupBy(F.expr("s div 32768").alias("k")).agg(F.bitmap_construct_agg(F.col("s") % 32768).alias("bits"))
    bits = np.zeros(BITS // 8, np.uint8)
    for r in rows.collect():  # at most BITS / 32768 rows
        bits[r["k"] * 4096:(r["k"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)

    @F.pandas_udf("boolean")
    def marked(s: pd.Series) -> pd.Series:
        at = s.to_numpy("int64")
        return pd.Series((bits[at >> 3] >> (at & 7) & 1).astype(bool))

    return lambda hashed: marked(F.pmod(hashed, F.lit(BITS)))


def sifted(signed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The signed rows of wanted nodes and some others."""
    return signed.where(sieve(wanted, F.xxhash64("node"))(F.xxhash64("node")))


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node it is connected with) for every node of the links, by large-star and small-star steps.

    A step joins links with the least neighbour of each node; its result is a table in the shared folder. Steps end when
    every link leads from a node with no other link to the least node of its component.
    """
    edges = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "near-links")
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")  # a row of each edge
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = store(small.select("e.*").where("u <> v").distinct(), "near-links")
        drop_stored(edges)
        edges = small
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def stars(edges: DataFrame) -> bool:
    """Whether each u has one link and is no other link's v."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(2).alias("n")), F.struct(F.col("v").alias("node"), F.lit(1).alias("n")))).alias("e"))
    found = ends.select("e.*").groupBy("node").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    return found.where("most = 2 AND n > 2").isEmpty()


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after further links. Without any, they stay."""
    if links.isEmpty():
        return roots
    return store(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)), "near-roots")


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", exact: bool = True) -> DataFrame:
    """doc_id, class_id, class_size, copies (rows with the same shingles) of every row."""
    return classed(docs, id_column, text_column, exact).select("doc_id", "class_id", "class_size", "copies")


def classed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", exact: bool = True) -> DataFrame:
    """classes() with each row's text_key and root, which names its class: the class_id doesn't where rows of two classes share an id."""
    signed = store(sign(docs, id_column, text_column), "near-signed")
    nodes = store(signed.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")), "near-nodes")
    # copies meet in map-side aggregates: one row per node and task is shuffled
    weighs = (F.octet_length("sketch") + F.octet_length("shingles") + 64).cast("long").alias("bytes")
    banded = store(signed.where("n_shingles > 0").select("node", "bands", "sketch", weighs).dropDuplicates(["node"]), "near-bands")
    entries = banded.select("node", "bytes", F.explode("bands").alias("bucket"))
    sketches = banded.select("node", "sketch")
    heads = entries.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    scratch = [banded]

    def kept(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        """A stored table that goes when the classes are known."""
        scratch.append(store(df, name, batch))
        return scratch[-1]

    crowded = kept(entries.join(heads, "bucket").withColumn("part", F.expr(f"pmod(xxhash64(node, bucket, 1), CAST(ceil(n / {PART}) AS BIGINT))")), "near-buckets")
    free_exchanges(docs.sparkSession)  # those of the bands are the largest
    by_part = crowded.groupBy("bucket", "part").agg(F.min(F.struct(F.xxhash64("node", "bucket").alias("o"), F.col("node").alias("second")))["second"].alias("second"))

    def known(pairs: DataFrame) -> DataFrame:
        """The shingles of the pairs' nodes, once each."""
        wanted = ends(pairs, "node")
        own = sifted(signed.select("node", "n_shingles", "shingles"), wanted).dropDuplicates(["node"])
        return own.join(wanted, "node")

    first = kept(crowded.where("node <> head").groupBy(F.col("node").alias("a")).agg(F.min("head").alias("b")), "near-pairs")
    close = kept(promising(first, sketches), "near-pairs")
    links = kept(verify(close, known(close)), "near-links")
    roots = kept(components(links), "near-roots")
    more = crowded.join(by_part, ["bucket", "part"]).select("node", F.explode(F.array("head", "second")).alias("other")).where("node <> other")
    more = more.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    more = more.join(ra, "a", "left").join(rb, "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = kept(promising(more.join(tried, ["a", "b"], "left_anti"), sketches), "near-pairs")
    late = kept(verify(second, known(second)), "near-links")
    roots = joined(roots, late)
    tried = close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(second)
    turn = 0
    while True:
        rest = kept(partners(crowded, roots, sketches, tried, turn), "near-pairs", BLOCKS_BATCH)
        late = kept(verify(rest, known(rest)), "near-links")
        tried, turn = tried.unionByName(rest), turn + 1
        if late.isEmpty() or exact and late.count() * FEW < rest.count():
            break
        roots = joined(roots, late)
    if exact:  # links of the last round, if any, are counted with those found here
        roots = joined(roots, kept(across(crowded, roots, signed), "near-links", BLOCKS_BATCH).unionByName(late))
    for table in scratch:
        if table is not roots:
            drop_stored(table)
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = named.join(ids, "root").select("node", "root", "class_id", "class_size", "copies")
    return signed.select("doc_id", "text_key", "node").join(named, "node").select("doc_id", "text_key", "root", "class_id", "class_size", "copies")


def first_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class: that with the least id (null comes last), and of several with that id that of the least text key; of equal rows one stays.

    Rows are told apart by id and text, so rows of other classes stay even if they share the id."""
    found = store(classed(docs).where("class_size > 1").select("doc_id", "text_key", "root"), "near-classes")
    rows = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"), F.first("root").alias("root"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    rows = store(rows.join(first, "root").select("doc_id", "text_key", "n", stays.alias("stays")), "near-rows")
    drop_stored(found)
    out = apart(docs, rows.where("NOT stays"))[0]
    again = rows.where("stays AND n > 1")
    if again.isEmpty():
        return out
    out, repeated, names = apart(out, again)
    return out.unionByName(repeated.dropDuplicates(names).drop(*names))


def apart(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """The documents not named by doc_id and text_key in rows, and those named, with both names in columns of the names given.

    Only documents that a bitmap of the rows lets through are shuffled."""
    id_name, key_name = names = unused(docs, "_near_id", "_near_key")
    maybe = sieve(rows, F.xxhash64("doc_id", "text_key"))(F.xxhash64(F.col("doc_id").cast("long"), text_key()))
    rows = rows.select(F.col("doc_id").alias(id_name), F.col("text_key").alias(key_name))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_name)) & (text_key() == F.col(key_name))
    near = docs.where(maybe)
    return docs.where(~maybe).unionByName(near.join(rows, same, "left_anti")), near.join(rows, same), names
