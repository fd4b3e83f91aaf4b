"""Splittable scan of huge JSON documents that hold maps keyed by id, such as offers.

`read_documents` makes one document one row of one task. Here a document of any size is read by many tasks: Spark's
text source cuts it behind closing braces, and three light looks at the pieces settle where in the document each split
begins: (1) quotes are counted, which tells splits that begin inside a string; (2) every split reports the levels it
closes and the keys it leaves open; (3) the driver chains these reports, one small record per split, as it holds the
list of splits anyway. After that each task knows its path exactly and hands out the entries of the wanted maps as text.
An entry that crosses splits is put together by a shuffle of its fragments alone. Splits of other parts of a document,
such as reserved terms, are passed over. No task holds more than a batch of pieces and one entry.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarifold.sources.documents import first_term_prices

SPLIT_BYTES = 128 << 20
PRODUCTS, ON_DEMAND = ("products",), ("terms", "OnDemand")
PRODUCT_DDL = "productFamily string, attributes map<string,string>"
TERM_DDL = ("map<string, struct<priceDimensions map<string, struct<unit string, description string, beginRange string, "
            "endRange string, pricePerUnit map<string,string>>>>>")

# A string with the bracket of its value, a bracket, or the quote of a string that isn't closed in this text.
_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*+)"(?:\s*:\s*([{\[])?)?|([{}\[\]])|"', re.S)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*+"(\s*:\s*[{\[])?', re.S)
_CUT_KEY = "\0"  # the key was cut by a split; no JSON string holds this character raw


class _Walk:
    """Levels opened and closed in the text of one split, fed in order."""

    def __init__(self, in_string: bool) -> None:
        self.in_string, self.held, self.base = in_string, "", 0

    def feed(self, chunk: str) -> Iterator[tuple[bool, str | None, int]]:
        """(opens, key, offset in the split) of each bracket; closing brackets give the offset behind them."""
        text, at = self.held + chunk, 0
        self.held = ""
        if self.in_string:
            end = _STRING_END.match(text)
            if end is None:
                self.base += len(text)
                return
            self.in_string, at = False, end.end()
            if end.group(1):
                yield True, _CUT_KEY, self.base + at - 1
        for token in _TOKEN.finditer(text, at):
            key, opened, bracket = token.groups()
            if key is not None:
                if opened:
                    yield True, json.loads(f'"{key}"') if "\\" in key else key, self.base + token.end() - 1
            elif bracket is None:
                self.held = text[token.start():]
                break
            elif bracket in "{[":
                yield True, None, self.base + token.start()
            else:
                yield False, None, self.base + token.end()
        self.base += len(text) - len(self.held)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, str]]:
    """(file, start of the split, text), the pieces of a split in order."""
    for batch in batches:
        for (file, start), part in batch.groupby(["file", "start"], sort=False):
            yield file, int(start), "}".join(part["value"]) + "}"


def _levels(strings: dict[tuple[str, int], bool]):
    """Per split: offsets at which it closes levels that it did not open, and keys and offsets it leaves open."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walks: dict[tuple[str, int], tuple[_Walk, list, list]] = {}  # the few splits that share a task
        for file, start, text in _chunks(batches):
            walk, closed, opened = walks.setdefault((file, start), (_Walk(strings[file, start]), [], []))
            for opens, key, at in walk.feed(text):
                if opens:
                    opened.append((key, at))
                elif opened:
                    opened.pop()
                else:
                    closed.append(at)
        yield pd.DataFrame([(f, s, c, [k for k, _ in o], [a for _, a in o]) for (f, s), (_, c, o) in walks.items()],
                           columns=["file", "start", "closed", "keys", "opened"])
    return run


class _State:
    """What a split meets: its path, and the entry that comes in from before or goes on behind it."""

    def __init__(self, in_string: bool, stack: list, path: tuple[str, ...], row, came: tuple | None) -> None:
        depth = len(path) + 1  # root, then the path; the container at this index is an entry
        closed, opened = len(row.closed), list(zip(row.keys, row.opened))
        stays = stack[:max(len(stack) - closed, 0)]
        self.in_string, self.stack, self.after = in_string, stack, stays + [k for k, _ in opened]
        seen = tuple(stays[1:depth])
        self.skip = len(stays) > 0 and seen != path[:len(seen)]
        self.head = came  # (key, pos) of the entry that is open at the start
        needed = len(stack) - depth
        self.head_end = row.closed[needed - 1] if came and closed >= needed else None
        self.tail_start, self.leaves = None, None
        if len(self.after) > depth and tuple(self.after[1:depth]) == path:
            if len(stays) > depth:
                self.leaves = came
            else:
                key, self.tail_start = opened[depth - len(stays)]
                # Entries of a split are numbered from its start; the open one is the last and holds a byte at least.
                self.leaves = (key, row.start + self.tail_start)
        if (self.leaves and self.leaves[0] == _CUT_KEY) or _CUT_KEY in self.after[1:depth]:
            raise ValueError(f"{row.file}: a key with a brace crosses splits; read with another split size")


def _whole_entries(states: dict[tuple[str, int], _State], path: tuple[str, ...]):
    """Entries that begin and end within a split."""
    depth = len(path) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, rows = None, []
        for file, start, text in _chunks(batches):
            state = states[file, start]
            if state.skip:
                continue
            if split != (file, start):
                split, walk, stack, parts, entry = (file, start), _Walk(state.in_string), list(state.stack), [], None
                begun = 0
            base = walk.base
            known = walk.held + text
            mark = base
            for opens, key, at in walk.feed(text):
                if opens:
                    if entry is None and len(stack) == depth and tuple(stack[1:]) == path:
                        if key == _CUT_KEY:
                            raise ValueError(f"{file}: a key with a brace crosses splits; read with another split size")
                        entry, begun, mark, parts = key, at, at, []
                    stack.append(key)
                elif stack:
                    stack.pop()
                    if entry is not None and len(stack) == depth:
                        parts.append(known[mark - base:at - base])
                        rows.append((file, start + begun, entry, "".join(parts)))
                        entry = None
            if entry is not None:
                parts.append(known[mark - base:walk.base - base])
            if rows:
                yield pd.DataFrame(rows, columns=["file", "pos", "key", "value"])
                rows = []
    return run


def _fragments(states: dict[tuple[str, int], _State]):
    """The parts of entries that cross splits, cut out by the offsets that are known: no look for brackets."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, base = None, 0
        for file, start, text in _chunks(batches):
            state = states[file, start]
            if split != (file, start):
                split, base = (file, start), 0
            rows, end = [], base + len(text)
            if state.head and (state.head_end is None or base < state.head_end):
                stop = end if state.head_end is None else state.head_end
                rows.append((file, *state.head, start, base, text[:stop - base]))
            if state.tail_start is not None and state.tail_start < end:
                rows.append((file, *state.leaves, start, base, text[max(state.tail_start - base, 0):]))
            base = end
            if rows:
                yield pd.DataFrame(rows, columns=["file", "key", "pos", "start", "at", "value"])
    return run


def _pieces(spark: SparkSession, paths: str | list[str], split_bytes: int) -> DataFrame:
    """(file, start of the split, piece), cut alike by every job over it whatever the cluster's size is by then.

    Cuts follow the settings of the session a relation is made in, so that is one of its own with the caller's settings.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    return own.read.text(paths, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


class SplitDocuments:
    """Documents whose splits know their place. Finding it reads the documents twice; entries are read when asked for.

    A document must be one JSON object per file. Files must stay as they are between the looks: a split that wasn't seen
    before fails the job. An empty file has no entries.
    """

    def __init__(self, spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT_BYTES) -> None:
        self.pieces = _pieces(spark, paths, split_bytes)
        bare = F.regexp_replace("value", r"\\.", "")
        quotes = (self.pieces.groupBy("file", "start")
                  .agg(F.sum(F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))).alias("n"))
                  .orderBy("file", "start").collect())
        self.strings: dict[tuple[str, int], bool] = {}
        file, odd = None, False
        for q in quotes:
            file, odd = q.file, odd and q.file == file
            self.strings[q.file, q.start] = odd
            odd ^= bool(q.n % 2)
        levels = self.pieces.mapInPandas(
            _levels(self.strings), "file string, start bigint, closed array<bigint>, keys array<string>, opened array<bigint>")
        self.levels = sorted(levels.collect(), key=lambda r: (r.file, r.start))

    def entries(self, *path: str) -> DataFrame:
        """(file, pos, key, value) of each entry of the map at `path`: value is JSON text, pos its order in the file.

        Entries that are neither an object nor an array are left out. A map that is missing has none.
        """
        states: dict[tuple[str, int], _State] = {}
        file, stack, came = None, [], None
        for row in self.levels:
            if row.file != file:
                file, stack, came = row.file, [], None
            state = _State(self.strings[row.file, row.start], stack, path, row, came)
            states[row.file, row.start] = state
            stack, came = state.after, state.leaves
        whole = self.pieces.mapInPandas(_whole_entries(states, path), "file string, pos bigint, key string, value string")
        cut = self.pieces.mapInPandas(
            _fragments(states), "file string, key string, pos bigint, start bigint, at bigint, value string")
        joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("start", "at", "value"))),
                                             lambda part: part["value"]))
        return whole.unionByName(cut.groupBy("file", "pos", "key").agg(joined.alias("value")))


def offer_entry_prices(products: DataFrame, terms: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Prices as of `offer_prices`, from entries (file, pos, key, value) of products and of on-demand terms.

    Entries are parsed with the read fields only, and families that aren't wanted go before the join. `pos` keeps the
    order of products but isn't dense. An entry that doesn't parse fails the job.
    """
    strict = {"mode": "FAILFAST"}
    p = products.select("file", "pos", F.col("key").alias("sku_id"), F.from_json("value", PRODUCT_DDL, strict).alias("p"))
    p = p.select("file", "pos", "sku_id", F.col("p.productFamily").alias("family"), F.col("p.attributes").alias("attributes"))
    if families:
        p = p.filter(F.col("family").isin(*families))
    t = terms.select("file", F.col("key").alias("sku_id"), F.from_json("value", TERM_DDL, strict).alias("t"))
    return first_term_prices(p, t)


def read_offer_prices(spark: SparkSession, paths: str | list[str], families: list[str] | None = None,
                      split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """On-demand prices of offers of any size, as `offer_prices(read_documents(...))` gives them."""
    documents = SplitDocuments(spark, paths, split_bytes)
    return offer_entry_prices(documents.entries(*PRODUCTS), documents.entries(*ON_DEMAND), families)
