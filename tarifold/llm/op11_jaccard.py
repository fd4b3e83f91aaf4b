"""Similarity join of documents by n-gram Jaccard: size-banded tiles, bitmap signatures, exact intersections.

A document's set holds its distinct SHINGLE-word shingles (a shorter text is one shingle). Two documents link when their sets'
Jaccard likeness is PERCENT / 100 or more. All links between different sets are found, none by chance:

- Equal sets are one node from the start, so a group of copies is one row in all that follows.
- Sizes are cut into bands whose bounds grow by 100 / PERCENT, so linked sets are in the same or in neighbouring bands. Tile i
  is for pairs whose smaller set is in band i. Sets linked in it differ in at most d_i elements, since
  |A| + |B| - 2 |A and B| <= (|A| + |B|) (100 - PERCENT) / (100 + PERCENT).
- A tile's elements are dealt by hash to d_i + 1 + e_i places. Linked sets agree in all elements of more than e_i places, so
  they share a key of tile, place and the place's elements. Places without elements give keys only for sets with more than e_i
  such places, which are rare, and with that no link is lost. Only sets with a common key are compared.
- Each node is first compared with the least node of its keys. Nodes that keys connect, directly or over others, make a
  cluster; a pair outside a cluster can't be linked. Clusters that are then still of several components are searched in
  blocks of about BLOCK_BYTES of bitmaps and at most about BLOCK nodes: whole if they have at most CLUSTER nodes, so that a node's bitmap travels once and not once
  for each of its keys, and larger ones key by key.
- A comparison begins with bitmaps of hashed elements, about eight bits an element: what |A| - |bits of A not in B| and its
  counterpart allow bounds the intersection from above. Pairs that the bound leaves are decided by intersecting the sorted
  sets of 48-bit hashes. (A false common element has odds of about 1 in 10^7 in sets of 10,000.)

Blocks give each node's best partner of another component, round by round while that links at least one in FEW pairs, and in the end every
pair the bounds leave. So groups of near copies cost in proportion to their nodes; only pairs of unlinked sets whose likeness
is just below the threshold are all looked at. Components are those of op10's star steps.

Cases: null, empty and wordless texts have an empty set and are linked with nothing, not even each other; null doc_ids come out
with their component, named by its least id that isn't null; rows with an equal doc_id are each placed, and link by their
texts only; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifold.llm.op10_near import FEW, components, ends, shingles, sieve
from tarifold.llm.shared import drop_stored, free_exchanges, mix, ragged, returning, slices, store, text_of, utf8

SHINGLE, PERCENT, BLOCK, CLUSTER = 3, 90, 4096, 2048
#: Bytes of bitmaps in a block; nodes whose bitmaps are compared with others at once.
BLOCK_BYTES, ROWS = 1 << 20, 128
#: Bytes of sets that a task unpacks at once; rows with sets, and blocks, that go to Python at once.
SETS_BYTES, SETS_BATCH, BLOCKS_BATCH = 1 << 21, 256, 2
WIDTH = 6  # bytes of an element
LEAST_BITS, BITS_EACH = 64, 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@cache
def bands(most: int) -> np.ndarray:
    """Least size of each band, up to one beyond `most`."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, (out[-1] - 1) * 100 // PERCENT + 1))
    return np.array([*out, max(out[-1] + 1, (out[-1] - 1) * 100 // PERCENT + 1)])


def places(tile: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many places each tile has (0: linked sets are equal there), and how many of them may be empty without notice."""
    smaller = bounds[tile + 1] - 1
    apart = (smaller + smaller * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)
    spare = 1 + apart // 400
    return np.where(apart > 0, apart + 1 + spare, 0), spare


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes with so many common elements, or at most so many, can reach the likeness."""
    return (100 + PERCENT) * common >= PERCENT * (a + b)


def packed(h: np.ndarray) -> np.ndarray:
    """Bytes of the elements, WIDTH each."""
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :WIDTH]


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").ravel()


def sets_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, node (128 bits that name the set; null for an empty one), n_shingles and the sorted elements of each row."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                raw, offsets = utf8(part.column(1))
                n = part.num_rows
                doc, h, _ = shingles(_LOWER[raw], offsets, SHINGLE)
                sizes = np.bincount(doc, minlength=n)
                name = np.zeros((n, 2), np.uint64)
                for k in (0, 1):
                    np.add.at(name[:, k], doc, mix(h + np.uint64(k + 1)))
                h = h >> np.uint64(64 - 8 * WIDTH)  # order stays
                data, ends = packed(h).tobytes(), (np.cumsum(sizes) * WIDTH).tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.tobytes() if s else None for x, s in zip(name, sizes)], pa.binary()), pa.array(sizes, pa.int64()),
                     pa.array([data[a:b] for a, b in zip([0, *ends[:-1]], ends)], pa.binary())],
                    ["doc_id", "node", "n_shingles", "elements"])

    return rows.mapInArrow(run, "doc_id long, node binary, n_shingles long, elements binary")


def keys_of(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tile keys of sets, and how many each has."""
    sizes = np.array([len(s) // WIDTH for s in sets], np.int64)
    h = unpacked(b"".join(sets))
    starts = np.cumsum(sizes) - sizes
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + np.uint64(1)), out=sums[1:])
    bounds = bands(int(sizes.max(initial=1)))
    band = np.searchsorted(bounds, sizes, "right") - 1
    found_rows, found = [], []
    for lower in (0, 1):  # as the smaller set, and as the larger one of the tile below
        tile = band - lower
        n_places, spare = places(np.maximum(tile, 0), bounds)
        n_places = np.where(tile >= 0, n_places, 0)
        rows, place = ragged(n_places)
        if not len(rows):
            continue
        # where each place begins: elements are sorted, and place = floor(element * places) keeps their order
        own, _ = ragged(sizes)
        at = (((h >> np.uint64(8 * WIDTH - 32)) * n_places[own].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        first = np.cumsum(n_places) - n_places
        used = n_places[own] > 0
        counts = np.bincount(first[own[used]] + at[used], minlength=len(rows))
        ends = np.cumsum(counts) - np.repeat(np.cumsum(np.where(n_places > 0, sizes, 0)) - np.where(n_places > 0, sizes, 0), n_places) + starts[rows]
        total = sums[ends] - sums[ends - counts]
        empty = counts == 0
        many = np.bincount(rows[empty], minlength=len(sets)) > spare
        keep = ~empty | many[rows]
        key = mix(mix(total + counts.astype(np.uint64)) + mix(tile[rows].astype(np.uint64) * np.uint64(1 << 32) + place.astype(np.uint64)))
        found_rows.append(rows[keep])
        found.append(key[keep])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(sets), np.int64)
    rows, key = np.concatenate(found_rows), np.concatenate(found)
    order = np.argsort(rows, kind="stable")
    return key[order], np.bincount(rows, minlength=len(sets))


def entries(reps: DataFrame) -> DataFrame:
    """nid and key, a row for each tile key of each node."""
    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SETS_BYTES):
                key, n = keys_of(part.column(1).to_pylist())
                nid = np.repeat(part.column(0).to_numpy(), n)
                for k in range(0, len(nid), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(nid[k:k + (1 << 16)]), pa.array(key[k:k + (1 << 16)].view(np.int64))], ["nid", "key"])

    return reps.select("nid", "elements").mapInArrow(run, "nid long, key long")


def bitmap(elements: np.ndarray) -> np.ndarray:
    """Hashed elements as bits, a power of two of them by the set's size."""
    n = max(LEAST_BITS, 1 << (BITS_EACH * max(1, len(elements)) - 1).bit_length())
    bits = np.zeros(n, np.uint8)
    bits[(elements & np.uint64(n - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer words."""
    while len(bits) > words:
        bits = bits[:len(bits) // 2] | bits[len(bits) // 2:]
    return bits


def bitmaps(reps: DataFrame) -> DataFrame:
    """nid, n and the bitmap of each node."""
    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SETS_BYTES):
                sets = [unpacked(s) for s in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary())], ["nid", "n", "bits"])

    return reps.select("nid", "elements").mapInArrow(run, "nid long, n long, bits binary")


def bound(a: list[bytes], na: np.ndarray, b: list[bytes], nb: np.ndarray) -> np.ndarray:
    """The greatest number of common elements, of each set of a with each of b, that the bitmaps allow."""
    words = min(len(x) for x in (*a, *b)) // 8
    one, two = (np.stack([folded(np.frombuffer(x, np.uint64), words) for x in side]) for side in (a, b))
    common = np.stack([np.bitwise_count(row & two).sum(axis=1, dtype=np.int64) for row in one])
    free = [n - np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x, n in ((one, na), (two, nb))]
    return common + np.minimum(free[0][:, None], free[1][None, :])


def possible(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """The pairs (a, b) that the bitmaps' bound leaves."""
    left = signs.select(F.col("nid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("sa"))
    right = signs.select(F.col("nid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("sb"))

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(k).to_numpy() for k in (2, 3))
            most = [bound([x], na[k:k + 1], [y], nb[k:k + 1])[0, 0] for k, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()))]
            yield batch.select([0, 1]).filter(pa.array(linked(np.array(most, np.int64), na, nb)))

    # sizes too far apart need no bitmaps
    sized = pairs.join(left, "a").join(right, "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    return sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sorted sets have enough in common. Only the sets of these pairs are shuffled."""
    wanted = ends(pairs, "nid")
    own = reps.select("nid", "elements").where(sieve(wanted, F.xxhash64("nid"))(F.xxhash64("nid")))
    left, right = (own.select(F.col("nid").alias(c), F.col("elements").alias(f"s{c}")) for c in "ab")

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = unpacked(x.as_py()), unpacked(y.as_py())
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                good.append(bool(linked((b[at] == a).sum(), len(a), len(b))))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def block_pairs(nid: np.ndarray, root: np.ndarray, n: np.ndarray, side: np.ndarray, bits: list[bytes], closest: bool) -> Iterator[tuple[int, int, int]]:
    """Pairs of nodes of different components that the bound leaves, with their slack; a side meets the other, or all meet all.

    With closest, the best pair of each node that has one. Nodes are taken by size, so that only those of alike sizes meet and
    bitmaps are folded little."""
    order = np.argsort(n, kind="stable")
    one, two = (order[side[order] == 0], order[side[order] == 1]) if side.any() else (order, order)
    best, mate = np.full(len(nid), -1), np.zeros(len(nid), np.int64)
    for k in range(0, len(one), ROWS):
        rows = one[k:k + ROWS]
        a, b = np.searchsorted(100 * n[two], PERCENT * n[rows[0]], "left"), np.searchsorted(PERCENT * n[two], 100 * n[rows[-1]], "right")
        cols = two[a:b] if side.any() else two[max(a, k):b]  # those before have met these
        if not len(cols):
            continue
        most = bound([bits[i] for i in rows], n[rows], [bits[j] for j in cols], n[cols])
        na, nb = n[rows][:, None], n[cols][None, :]
        slack = np.where((root[rows][:, None] != root[cols][None, :]) & linked(most, na, nb), (100 + PERCENT) * most - PERCENT * (na + nb), -1)
        if closest:
            for own, other, values in ((rows, cols, slack), (cols, rows, slack.T)):
                top = values.argmax(axis=1)
                value = values[np.arange(len(own)), top]
                better = value > best[own]
                best[own[better]], mate[own[better]] = value[better], other[top[better]]
        else:
            for i, j in np.argwhere(slack >= 0).tolist():
                yield *sorted((int(nid[rows[i]]), int(nid[cols[j]]))), int(slack[i, j])
    for i in np.flatnonzero(best >= 0):
        yield *sorted((int(nid[i]), int(nid[mate[i]]))), int(best[i])


def grouped(crowded: DataFrame, clusters: DataFrame) -> DataFrame:
    """nid and the groups to search it in: its cluster, or its keys where the cluster has more than CLUSTER nodes."""
    sizes = clusters.groupBy("cluster").agg((F.count(F.lit(1)) <= CLUSTER).alias("small"))
    placed = clusters.join(sizes, "cluster")
    whole = placed.where("small").select("nid", F.lit(True).alias("small"), F.col("cluster").alias("key"))
    large = placed.where("NOT small").select("nid")
    return whole.unionByName(crowded.select("nid", "key").join(large, "nid", "left_semi").select("nid", F.lit(False).alias("small"), "key"))


def meetings(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """nid, root, key, block and mate: the blocks of each group's nodes, and the blocks that theirs meets.

    Groups with nodes of one component only are left out. The others' nodes are dealt to blocks, those of the group's largest
    component apart; its blocks meet the further blocks, and these meet all."""
    placed = groups.select(F.struct("small", "key").alias("key"), "nid", "bytes").join(roots, "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).groupBy("key").agg(
        F.max(F.struct("n", "root", "bytes")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = "greatest(ceil({0} / %d), ceil({1} / %d))" % (BLOCK, BLOCK_BYTES)
    whole = F.expr(blocks.format("n", "bytes")) <= 1
    mixed = sizes.where("n > main.n").select(
        "key", F.col("main.root").alias("main"), F.when(whole, 0).otherwise(F.expr(blocks.format("main.n", "main.bytes"))).alias("mains"),
        F.when(whole, 1).otherwise(F.expr(blocks.format("(n - main.n)", "(bytes - main.bytes)"))).alias("others"))
    placed = placed.drop("bytes").join(mixed, "key").withColumn("is_main", F.expr("mains > 0 AND root = main"))
    placed = placed.withColumn("block", F.expr("IF(is_main, pmod(xxhash64(nid), greatest(mains, 1)), mains + pmod(xxhash64(nid), others))"))
    return placed.select("nid", "root", "key", "block", F.explode(F.expr("sequence(IF(is_main, mains, 0), mains + others - 1)")).alias("mate"))


def searched(groups: DataFrame, roots: DataFrame, signs: DataFrame, tried: DataFrame, closest: bool) -> DataFrame:
    """Untried pairs (a, b) of different components that share a group and that the bound leaves: all, or each node's best."""
    placed = meetings(groups, roots)
    entry = F.struct("nid", "root", "n", (F.col("block") > F.col("mate")).cast("int").alias("side"), "bits")
    blocks = placed.join(signs, "nid").groupBy("key", F.least("block", "mate").alias("i"), F.greatest("block", "mate").alias("j")).agg(F.collect_list(entry).alias("entries"))  # about two blocks

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                nid, root, n, side, bits = (block.values.field(k) for k in range(5))
                found = list(block_pairs(*(x.to_numpy().astype(np.int64) for x in (nid, root, n, side)), bits.to_pylist(), closest))
                if found:
                    a, b, slack = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(slack, pa.int64())], ["a", "b", "slack"])

    pairs = blocks.select("entries").mapInArrow(run, "a long, b long, slack long").groupBy("a", "b").agg(F.max("slack").alias("slack")).join(tried, ["a", "b"], "left_anti")
    if closest:
        both = pairs.select(F.col("a").alias("nid"), "a", "b", "slack").unionByName(pairs.select(F.col("b").alias("nid"), "a", "b", "slack"))
        pairs = both.groupBy("nid").agg(F.max(F.struct("slack", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    return pairs.select("a", "b")


def roots_of(links: DataFrame) -> DataFrame:
    """nid and root of the links' nodes."""
    return components(links).select(F.col("node").alias("nid"), "root")


def join_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, component_size (rows) and copies (rows with the same set) of every row."""
    signed = store(sets_of(docs, id_column, text_column), "jaccard-sets", SETS_BATCH)
    members = store(signed.select("doc_id", "node", "n_shingles"), "jaccard-members")
    # sets that occur once stay where they are; the others, and some that a bitmap lets through, are shuffled to meet their copies
    named = signed.where("node IS NOT NULL")
    again = members.where("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    maybe = sieve(again, F.xxhash64("node"))(F.xxhash64("node"))
    merged = named.where(maybe).groupBy("node").agg(F.first("elements").alias("elements"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    reps = named.where(~maybe).select("node", "elements", F.col("doc_id").alias("least_id"), F.lit(1).cast("long").alias("copies")).unionByName(merged)
    reps = store(reps.withColumn("nid", F.monotonically_increasing_id()), "jaccard-nodes", SETS_BATCH)
    drop_stored(signed)
    free_exchanges(docs.sparkSession)
    scratch: list[DataFrame] = []

    def kept(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        scratch.append(store(df, name, batch))
        return scratch[-1]

    found = entries(reps)
    heads = kept(found.groupBy("key").agg(F.min("nid").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "head"), "jaccard-heads", SETS_BATCH)
    crowded = kept(found.where(sieve(heads, F.xxhash64("key"))(F.xxhash64("key"))).join(heads, "key"), "jaccard-keys", SETS_BATCH)
    free_exchanges(docs.sparkSession)
    wanted = crowded.select("nid").distinct()
    signs = kept(bitmaps(reps).join(wanted, "nid", "left_semi"), "jaccard-bitmaps", SETS_BATCH)  # bitmaps travel, not sets
    others = crowded.where("nid <> head")
    tried = kept(others.groupBy(F.col("nid").alias("b")).agg(F.min("head").alias("a")).select("a", "b"), "jaccard-pairs")
    connected = components(others.select(F.col("head").alias("a"), F.col("nid").alias("b")).distinct())
    weighs = signs.select("nid", (F.octet_length("bits") + 64).cast("long").alias("bytes"))
    groups = kept(grouped(crowded, connected.select(F.col("node").alias("nid"), F.col("root").alias("cluster"))).join(weighs, "nid"), "jaccard-groups")
    for table in (heads, crowded):  # groups have what is searched from now on
        scratch.remove(table)
        drop_stored(table)
    free_exchanges(docs.sparkSession)
    links = kept(verified(kept(possible(tried, signs), "jaccard-pairs", SETS_BATCH), reps), "jaccard-links", SETS_BATCH)
    roots = store(roots_of(links), "jaccard-roots")
    closest = True
    while True:
        pairs = kept(searched(groups, roots, signs, tried, closest), "jaccard-pairs", BLOCKS_BATCH)
        more = kept(verified(pairs, reps), "jaccard-links", SETS_BATCH)
        tried = tried.unionByName(pairs)
        linked_any = not more.isEmpty()
        if linked_any:
            links = links.unionByName(more)
            roots = store(roots_of(links), "jaccard-roots")
        if not closest:
            break
        closest = linked_any and more.count() * FEW >= pairs.count()
    named = reps.select("node", "nid", "least_id", "copies").join(roots, "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("copies").alias("component_size"))
    named = store(named.join(ids, "root").select("node", "component_id", "component_size", "copies"), "jaccard-components")
    for table in scratch:
        drop_stored(table)
    out = members.join(named, "node", "left")
    alone = F.col("node").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                      F.coalesce("component_size", F.lit(1)).alias("component_size"), F.coalesce("copies", F.lit(1)).alias("copies"))
