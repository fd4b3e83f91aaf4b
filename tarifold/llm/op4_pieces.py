"""SentencePiece encoding and decoding of byte-fallback BPE models by batched numpy Viterbi.

White space is escaped and texts are parted before each run of escapes and around line ends, where no piece of the model
may reach across; each distinct unit is encoded once. Units of equal length advance together: for each end, the hashes of
all substrings that end there probe the sorted hashes of the pieces, and a backpointer goes to the one candidate that may
follow the best path's last piece.

A sum of piece scores is not how a BPE model segments: on the sample texts of the tests the highest sum differs from the
merges in part of the words. What Viterbi maximises here is therefore legality: BPE merges give a sequence exactly if they
give each pair of neighbours (a merge that crosses the boundary of two final pieces would also be made when the two stand
alone). With scores 0 for legal pairs and minus infinity for others just one path survives for each end, and it is
the merges' own result. Legality of a pair is found once by merging its characters.

Cases: null and empty texts have no ids; characters without a piece fall back to their bytes; an escape character in a text
decodes as a space, as in the library; texts of any length are encoded whole; rows may repeat; an empty table gives no rows;
other columns are kept but for those named like a new one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarifold.llm.shared import UnitIds, mix, ragged, slices, utf8

ESCAPE = "▁"
UNIT = re.compile(f"{ESCAPE}+[^{ESCAPE}\n]*|[^{ESCAPE}\n]+|\n+")
_B = np.uint64(0x9E3779B97F4A7C15)
_START, _UNKNOWN = (1 << 21) - 1, 40_000  # codes beside piece ids: start of a unit; a character without piece is _UNKNOWN + its code point
MOST_ROWS = 8_192
_CODECS: dict[str, PieceCodec] = {}


class PieceCodec:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.rank = {p: i for i, (p, s) in enumerate(zip(self.pieces, special)) if not s}
        self.score = {p: model.get_score(i) for p, i in self.rank.items()}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if any(ESCAPE in p.lstrip(ESCAPE) or "\n" in p for p in self.rank) or n > _UNKNOWN:
            raise ValueError("a piece of this model reaches across units")
        self.as_bytes = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(ESCAPE, " ").encode()
                         for i, p in enumerate(self.pieces)]
        self.longest = max(map(len, self.rank))
        self.powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(4096, _B, np.uint64))))
        self.inverse = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(4096, pow(int(_B), -1, 1 << 64), np.uint64))))
        keys = np.array([self._hash(p) for p in self.rank], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(self.rank.values()), np.int64)[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(keys >> np.uint64(42)).astype(np.int64)] = True
        inside = {p[k:k + 2] for p in self.rank for k in range(len(p) - 1)}
        self.inside = np.array(sorted(ord(p[0]) << 21 | ord(p[1]) for p in inside), np.int64)
        self.pair_codes, self.pair_legal = np.zeros(0, np.int64), np.zeros(0, bool)
        self.units = UnitIds(self.encode_units, 600_000)

    def _hash(self, piece: str) -> int:
        c = np.array([ord(x) + 1 for x in piece], np.uint64)
        return int(mix(np.array([(c * self.powers[:len(c)]).sum() + np.uint64(len(c))], np.uint64))[0])

    def merge(self, text: str) -> list[str]:
        """Pieces by merging: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score.get(parts[k] + parts[k + 1], -np.inf), -k) for k in range(len(parts) - 1)))
            if best[0] == -np.inf:
                break
            k = -best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _text(self, code: int) -> str:
        return "" if code == _START else self.pieces[code] if code < _UNKNOWN else chr(code - _UNKNOWN)

    def legal(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the characters of both pieces gives just these two."""
        codes = left << 21 | right
        at = np.minimum(np.searchsorted(self.pair_codes, codes), max(0, len(self.pair_codes) - 1))
        known = self.pair_codes[at] == codes if len(self.pair_codes) else np.zeros(len(codes), bool)
        if not known.all():
            fresh = np.unique(codes[~known])
            pairs = [(self._text(c >> 21), self._text(c & _START)) for c in fresh.tolist()]
            value = np.array([self.merge(a + b) == ([a, b] if a else [b]) for a, b in pairs], bool)
            if len(self.pair_codes) > 2_000_000:
                self.pair_codes, self.pair_legal = np.zeros(0, np.int64), np.zeros(0, bool)
                fresh, value = self._all(codes)
            codes_now = np.concatenate((self.pair_codes, fresh))
            order = np.argsort(codes_now, kind="stable")
            self.pair_codes, self.pair_legal = codes_now[order], np.concatenate((self.pair_legal, value))[order]
            at = np.searchsorted(self.pair_codes, codes)
        return self.pair_legal[at]

    def _all(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fresh = np.unique(codes)
        pairs = [(self._text(c >> 21), self._text(c & _START)) for c in fresh.tolist()]
        return fresh, np.array([self.merge(a + b) == ([a, b] if a else [b]) for a, b in pairs], bool)

    def viterbi(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all rows of an array of code points, and how many each row has; all rows are of one length."""
        n, length = chars.shape
        last = np.full((n, length + 1), -1, np.int64)
        back = np.zeros((n, length + 1), np.int64)
        last[:, 0] = _START
        every = np.arange(n)
        for end in range(1, length + 1):
            most = min(end, self.longest)
            window = chars[:, end - most:end].astype(np.uint64) + np.uint64(1)
            # hashes of the last 1 to `most` characters: running sums from the end, each shifted to its own start
            weighted = window * self.powers[:most]
            tails = np.cumsum(weighted[:, ::-1], axis=1) * self.inverse[most - np.arange(1, most + 1)]
            keys = mix(tails + np.arange(1, most + 1, dtype=np.uint64))
            row, size = np.nonzero(self.filter[(keys >> np.uint64(42)).astype(np.int64)])
            key = keys[row, size]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            row, size, piece = row[hit], size[hit] + 1, self.ids[at[hit]]
            alone = np.ones(n, bool)
            alone[row[size == 1]] = False
            row = np.concatenate((row, every[alone]))
            size = np.concatenate((size, np.ones(alone.sum(), np.int64)))
            piece = np.concatenate((piece, _UNKNOWN + chars[alone, end - 1].astype(np.int64)))
            before = last[row, end - size]
            open_ = before >= 0
            row, size, piece, before = row[open_], size[open_], piece[open_], before[open_]
            good = self.legal(before, piece)
            score = np.zeros(n, np.int64)
            np.maximum.at(score, row[good], size[good])
            won = good & (score[row] == size)
            last[row[won], end], back[row[won], end] = piece[won], size[won]
        # all rows walk back together; a row at its start repeats code -1
        steps, end = [], np.full(n, length)
        while end.any():
            steps.append(np.where(end > 0, last[every, end], -1))
            end = end - np.where(end > 0, back[every, end], 0)
        codes = np.array(steps[::-1]).reshape(len(steps), n).T
        return codes[codes >= 0], (codes >= 0).sum(axis=1)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units, all in one array, and how many each has."""
        parts: list[str] = []
        owner: list[int] = []
        for k, u in enumerate(units):
            own = [u] if len(u) <= 64 else self.cut(u)
            parts += own
            owner += [k] * len(own)
        by_length: dict[int, list[int]] = {}
        for k, p in enumerate(parts):
            by_length.setdefault(len(p), []).append(k)
        order, codes, counts = [], [], []
        for length, own in by_length.items():
            rows = max(1, min(MOST_ROWS, (1 << 22) // (length + 1)))
            for at in range(0, len(own), rows):
                some = own[at:at + rows]
                chars = np.frombuffer("".join([parts[k] for k in some]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), length)
                found, n = self.viterbi(chars)
                order += some
                codes.append(found)
                counts.append(n)
        flat, n = (np.concatenate(codes), np.concatenate(counts)) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        # a character without piece becomes its bytes
        points = flat[flat >= _UNKNOWN] - _UNKNOWN
        spelled = {c: self.byte_ids[list(chr(c).encode("utf-8", "replace"))] for c in np.unique(points).tolist()}
        width = np.ones(len(flat), np.int64)
        width[flat >= _UNKNOWN] = [len(spelled[c]) for c in points.tolist()]
        ids = np.repeat(flat, width).astype(np.int32)
        if len(points):
            ids[np.repeat(flat >= _UNKNOWN, width)] = np.concatenate([spelled[c] for c in points.tolist()])
        ends = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(n)))]
        # back to the order of the units
        place = np.empty(len(parts), np.int64)
        place[order] = np.arange(len(parts))
        size = np.diff(ends)[place]
        rows_, pos = ragged(size)
        return ids[ends[:-1][place][rows_] + pos], np.bincount(np.array(owner, np.int64), size, len(units)).astype(np.int64)

    def cut(self, unit: str) -> list[str]:
        """Parts of a long unit, cut where no piece has the two characters side by side."""
        c = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        cuts = (np.flatnonzero(~np.isin(c[:-1] << 21 | c[1:], self.inside)) + 1).tolist()
        return [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)])]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        units: list[str] = []
        counts = []
        for t in texts:
            if "  " in t or t[:1] == " " or ESCAPE in t:  # runs of escapes stay together
                own = UNIT.findall(ESCAPE + t.replace(" ", ESCAPE))
            else:
                own = (ESCAPE + t.replace(" ", " " + ESCAPE).replace("\n", " \n")).split(" ") if t else []
            units += own
            counts.append(len(own))
        flat, lengths = self.units.ids(units)
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))]
        return flat, ends

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.as_bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


def codec(path: str) -> PieceCodec:
    """One codec per worker process and model file."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


NEW = {"piece_ids": T.ArrayType(T.IntegerType()), "n_pieces": T.LongType(), "piece_crc32": T.LongType(), "round_trip": T.BooleanType()}


def encode(docs: DataFrame, model: str, text_column: str = "text") -> DataFrame:
    """The rows with piece_ids, n_pieces, piece_crc32 (of the ids as little-endian 32-bit integers) and round_trip: whether decoding gives the text back."""
    rows = docs.drop(*NEW)
    kept = rows.columns
    schema = T.StructType([*rows.schema.fields, *[T.StructField(k, t) for k, t in NEW.items()]])
    column = kept.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            filled = batch.set_column(column, text_column, batch.column(column).fill_null(""))
            at = 0
            for part in slices(filled, column, 1 << 21):
                raw, offsets = utf8(part.column(column))
                blob = raw.tobytes()
                texts = [blob[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                flat, ends = own.encode(texts)
                spans = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
                same = [own.decode(flat[a:b].tolist()) == t.replace(ESCAPE, " ") for (a, b), t in zip(spans, texts)]
                crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in spans]
                new = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, part.num_rows).columns, *new], schema.names)
                at += part.num_rows

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids_column: str = "piece_ids", text_column: str = "decoded") -> DataFrame:
    """The rows with the text of their ids (null for null) in a new column."""
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != text_column], T.StructField(text_column, T.StringType())])
    kept = [n for n in schema.names if n != text_column]
    column = kept.index(ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return rows.drop(text_column).mapInArrow(run, schema)
