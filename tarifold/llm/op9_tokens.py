"""Token ids in binary files with a shared zstandard dictionary.

The encoder of a public tokenizer runs once per distinct unit (a word without its marks) of a worker. A zstandard dictionary is trained on the
serialized ids of a bounded sample of whole documents; every document is then compressed by itself with it, so that a short
document can be fetched alone. Files hold whole ranges of ids and ascend: file order, then order in the file, is the order
of doc_id.

File layout: frames of all documents; then ids (int64), a byte each that is 0 for a null id, token counts (int64) and frame
offsets (int64, one more than documents); then a JSON footer with the SHA-256 of the dictionary, the width of an id in
bytes and the number of documents; then the footer's length (uint32) and the eight bytes of MAGIC.

Cases: a null or empty text is the end id alone; a null doc_id sorts first; rows with an equal doc_id are all kept, in the
order of their frames; an empty table gives a folder with the dictionary only and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifold.llm.shared import block_of, id_bounds, partitions, ragged, returning, sample_texts, slices, span_hashes, text_of, utf8, word_spans

MAGIC = b"TOKIDS01"
END_ID = 1
#: Documents of the dictionary's sample, and bytes of the dictionary.
SAMPLE_DOCS, DICTIONARY_BYTES = 400, 65_536
#: Kinds of bytes: marks that beside letters, digits and white space are tokens of their own by the tokenizer's pattern; letters and digits; others.
_OTHER, _MARK, _PLAIN = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[np.frombuffer(b'.,!#$%&*?;:|"()', np.uint8)] = _MARK
_KIND[np.frombuffer((string.ascii_letters + string.digits).encode(), np.uint8)] = _PLAIN
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of texts by units. The tokenizer drops white space and parts marks from letters, so units can be encoded one by one.

    Units are the words between ASCII white space, parted at runs of marks whose neighbours are ASCII letters, digits or the word's ends;
    words of ASCII characters alone are lower-cased first, as the tokenizer's own normalizer does. Texts that hold one of
    the tokenizer's added tokens are parted at white space only. Units are found by hashes of 64 bits; the table of known
    units starts anew beyond most_units units or most_ids ids.
    """

    def __init__(self, path: str, most_units: int = 400_000, most_ids: int = 1 << 23):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most_units, self.most_ids = most_units, most_ids
        self.clear()

    def clear(self) -> None:
        self.known, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.begins, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, lengths = [np.zeros(0, np.int32)], np.zeros(len(units), np.int64)
        for at in range(0, len(units), 2000):  # the library keeps much beside the ids of a call
            got = [e.ids for e in self.tokenizer.encode_batch_fast(units[at:at + 2000], add_special_tokens=False)]
            lengths[at:at + len(got)] = list(map(len, got))
            flat.append(np.fromiter(chain.from_iterable(got), np.int32))
        return np.concatenate(flat), lengths

    def _units(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, lower-cased where that is safe; start, end and text number of each unit."""
        starts, ends, doc = word_spans(raw, offsets)
        if not len(starts) or any(t in raw.tobytes() for t in self.special):
            return raw, starts, ends, doc
        kind = _KIND[raw]
        beyond = np.flatnonzero(raw > 127)
        raw = _LOWER[raw] if not len(beyond) else self._lowered(raw, starts, ends, beyond)
        mark = np.concatenate(([False], kind == _MARK, [False]))
        edges = np.flatnonzero(mark[1:] != mark[:-1])
        begin, end = edges[::2], edges[1::2]  # runs of marks
        # a text's first or last mark may stand beside another text's
        word = np.searchsorted(starts, begin, "right") - 1
        own = end <= ends[word]
        begin, end, word = begin[own], end[own], word[own]
        fine = (begin == starts[word]) | (kind[begin - 1] == _PLAIN)
        fine &= (end == ends[word]) | (kind[np.minimum(end, len(raw) - 1)] == _PLAIN)
        cuts = np.concatenate((begin[fine], end[fine]))
        inner = np.concatenate((begin[fine] > starts[word[fine]], end[fine] < ends[word[fine]]))
        cuts = np.sort(cuts[inner])
        at = np.searchsorted(starts, cuts, "right") - 1
        return raw, np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts))), np.sort(np.concatenate((doc, doc[at])))

    @staticmethod
    def _lowered(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        """Words of ASCII characters alone in lower case, other words as they are."""
        low = _LOWER[raw]
        words = np.unique(np.searchsorted(starts, beyond, "right") - 1)
        rows, pos = ragged(ends[words] - starts[words])
        at = starts[words][rows] + pos
        low[at] = raw[at]
        return low

    def documents(self, raw: np.ndarray | bytes, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each document, the end id last."""
        raw = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
        raw, starts, ends, doc = self._units(raw, offsets)
        hashes, first, index = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, hashes)
        fresh = np.ones(len(hashes), bool)
        inside = place < len(self.known)
        fresh[inside] = self.known[place[inside]] != hashes[inside]
        if fresh.any():
            if len(self.known) + fresh.sum() > self.most_units or len(self.flat) > self.most_ids:
                self.clear()
                fresh[:] = True
            data, new = raw.tobytes(), first[fresh]
            flat, lengths = self._encode([data[a:b].decode("utf-8", "replace") for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            known = np.concatenate((self.known, hashes[fresh]))
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            self.begins = np.concatenate((self.begins, len(self.flat) + np.cumsum(lengths) - lengths))[order]
            self.lengths = np.concatenate((self.lengths, lengths))[order]
            self.flat = np.concatenate((self.flat, flat))
            place = np.searchsorted(self.known, hashes)
        units = place[index]
        lengths = self.lengths[units]
        n_ids = np.bincount(doc, lengths, len(offsets) - 1).astype(np.int64)
        rows, pos = ragged(lengths)
        ids = np.empty(int(n_ids.sum()) + len(n_ids), np.int32)
        ends_at = np.cumsum(n_ids + 1)
        own = np.ones(len(ids), bool)
        own[ends_at - 1] = False
        ids[own] = self.flat[self.begins[units][rows] + pos]
        ids[~own] = END_ID
        for a, b in zip((ends_at - n_ids - 1).tolist(), ends_at.tolist()):
            yield ids[a:b]


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode_texts(path: str, batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and ids of each text."""
    at = 0
    for part in slices(batch, column, 1 << 20):
        for ids in encoder(path).documents(*utf8(part.column(column))):
            yield at, ids
            at += 1


def train_dictionary(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> bytes:
    """Dictionary from whole texts of at most SAMPLE_DOCS documents, chosen by a hash of their id. Empty if they are too few to train on."""
    own = encoder(vocabulary)
    samples = [serialize(ids, own.width) for ids in own.documents(*utf8(sample_texts(docs, SAMPLE_DOCS, id_column, text_column)))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) > 7 else b""
    except zstandard.ZstdError:
        return b""


def serialize(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def _dictionary(dictionary: bytes, level: int = 0) -> dict:
    if not dictionary:
        return {}
    data = zstandard.ZstdCompressionDict(dictionary)
    if level:  # digested once, not for each document
        data.precompute_compress(level=level)
    return {"dict_data": data}


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> list[dict]:
    """Write the documents' ids below folder (a URI all executors reach); one entry per file, ascending, with its start.

    Compressed frames are shuffled, not texts. A file is written under a name of its own and renamed when complete, so
    a repeated task replaces it by the same bytes.
    """
    spark = docs.sparkSession
    store, root = open_folder(folder)
    store.create_dir(root, recursive=True)
    dictionary = train_dictionary(docs, vocabulary, id_column, text_column)
    digest = hashlib.sha256(dictionary).hexdigest()
    with store.open_output_stream(f"{root}/dictionary.zdict") as out:
        out.write(dictionary)
    bounds = id_bounds(docs, id_column, partitions(spark))
    rows = docs.select(block_of(id_column, bounds).alias("block"), F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, **_dictionary(dictionary, 3))
        for batch in batches:
            counts, frames = [], []
            for _, ids in encode_texts(vocabulary, batch, 2):
                counts.append(len(ids))
                frames.append(packer.compress(serialize(ids, encoder(vocabulary).width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())],
                                             ["block", "doc_id", "n_tokens", "frame"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_store, own_root = open_folder(folder)
        writer = None
        for batch in batches:
            for block, doc, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None or writer.block != block:
                    if writer is not None:
                        yield writer.close()
                    writer = FileWriter(own_store, own_root, block, digest, encoder(vocabulary).width)
                writer.add(doc, n, frame)
        if writer is not None:
            yield writer.close()

    frames = rows.mapInArrow(returning(compress), "block int, doc_id long, n_tokens long, frame binary")
    ordered = frames.repartition(max(1, len(bounds)), "block").sortWithinPartitions("block", F.col("doc_id").asc_nulls_first(), "frame")
    files = sorted(ordered.mapInArrow(returning(write), "block int, name string, n_docs long, n_tokens long").collect())  # one row per file
    out, start = [], 0
    for f in files:
        out.append({"name": f.name, "n_docs": f.n_docs, "n_tokens": f.n_tokens, "start": start})
        start += f.n_tokens
    with store.open_output_stream(f"{root}/manifest.json") as sink:
        sink.write(json.dumps({"dictionary_sha256": digest, "files": out}).encode())
    return out


class FileWriter:
    """One file: frames as they come, the index when it closes."""

    def __init__(self, store: fs.FileSystem, root: str, block: int, digest: str, width: int):
        self.store, self.block, self.name, self.root = store, block, f"block-{block:06d}.tok", root
        self.temporary = f"{root}/.{self.name}.{uuid.uuid4().hex}"
        self.out, self.digest, self.width = store.open_output_stream(self.temporary), digest, width
        self.docs, self.counts, self.offsets = [], [], [0]

    def add(self, doc: int | None, n: int, frame: bytes) -> None:
        self.out.write(frame)
        self.docs.append(doc)
        self.counts.append(n)
        self.offsets.append(self.offsets[-1] + len(frame))

    def close(self) -> pa.RecordBatch:
        footer = json.dumps({"dictionary_sha256": self.digest, "width": self.width, "n_docs": len(self.docs)}).encode()
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes() + bytes(d is not None for d in self.docs))
        self.out.write(np.array(self.counts, "<i8").tobytes() + np.array(self.offsets, "<i8").tobytes())
        self.out.write(footer + struct.pack("<I", len(footer)) + MAGIC)
        self.out.close()
        self.store.move(self.temporary, f"{self.root}/{self.name}")
        return pa.RecordBatch.from_pydict({"block": pa.array([self.block], pa.int32()), "name": [self.name],
                                           "n_docs": [len(self.docs)], "n_tokens": [sum(self.counts)]})


class FileReader:
    """Index of one file, and any of its documents."""

    def __init__(self, store: fs.FileSystem, path: str, dictionary: bytes):
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} is no token file")
        n_footer = struct.unpack("<I", tail[:4])[0]
        footer = json.loads(self.file.read_at(n_footer, size - 12 - n_footer))
        if footer["dictionary_sha256"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError(f"{path} was written with another dictionary")
        self.n, self.width = footer["n_docs"], footer["width"]
        index = self.file.read_at(25 * self.n + 8, size - 12 - n_footer - 25 * self.n - 8)
        self.docs = np.frombuffer(index, "<i8", self.n)
        self.known = np.frombuffer(index, np.uint8, self.n, 8 * self.n).astype(bool)
        self.counts = np.frombuffer(index[9 * self.n:], "<i8", self.n)
        self.offsets = np.frombuffer(index[17 * self.n:], "<i8", self.n + 1)
        self.unpacker = zstandard.ZstdDecompressor(**_dictionary(dictionary))

    def document(self, k: int) -> np.ndarray:
        frame = self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
        raw = self.unpacker.decompress(frame, max_output_size=int(self.counts[k]) * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4")


def read_tokens(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        with store.open_input_file(f"{root}/dictionary.zdict") as f:
            dictionary = f.read()
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = FileReader(store, f"{root}/{name}", dictionary)
                counts = own.counts.astype(np.int64)
                starts = start + np.cumsum(counts) - counts
                for a in range(0, own.n, 4096):  # one document's ids are held at a time
                    sums = []
                    for k in range(a, min(own.n, a + 4096)):
                        ids = own.document(k)
                        if len(ids) != counts[k]:
                            raise ValueError(f"{name}: document {k} has {len(ids)} ids, its index says {counts[k]}")
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    b = a + len(sums)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own.docs[a:b], pa.int64(), mask=~own.known[a:b]), pa.array(starts[a:b]), pa.array(counts[a:b]), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame([(f["name"], f["start"]) for f in files], "name string, start long")
    return listed.repartition(len(files)).mapInArrow(read, schema)
