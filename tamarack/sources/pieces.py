"""Records of one large file, read by as many tasks as the file has splits.

A JSON array, or CSV with line breaks inside quotes, can't be cut at any byte: whether a bracket, a comma or a line
break counts depends on all that comes before. So the file is read twice. The first pass tells, for every split, what it
does from either state in which it may begin (within quotes or not): the state it ends in, how far brackets open or close,
how many records begin. The driver chains these few numbers for each split, and then every split
knows the state it really begins in and the number of its first record. The second pass cuts the records out. What a
split has of a record that began before it, or goes on after it, is put together by record number; only such pieces are shuffled.

Splits are those of Spark's text reader with a separator that ends every record: `}` for JSON, a line break for CSV. So any
file system that Spark reads will do, and no piece between two separators may have more than 2 GB, nor any record.
Compressed files are one split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are looked at together.
CHUNK = 4 << 20
_BOM = b"\xef\xbb\xbf"
_TOLD = "path string, block long, size long, length long, first binary, ends array<boolean>, depth array<long>, lowest array<long>, at array<array<long>>, counts array<array<long>>"
_CUT = "path string, item long, whole boolean, block long, value binary"


@dataclass(frozen=True)
class Begin:
    """How a split begins: within quotes, at which depth of brackets, in which record, and whether the array has ended before."""

    quoted: bool
    depth: int
    item: int
    ended: bool
    closes: bool  # whether a separator follows the file's last piece


def _read(spark: SparkSession, path: str, separator: str) -> DataFrame:
    text = spark.read.text(path, lineSep=separator)
    return text.select("_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size", F.col("value").cast("binary").alias("value"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, pa.Array]]:
    """(path, block, size, values) of stretches of rows from one split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        p, b = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(p) != 0) | (np.diff(b) != 0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3).slice(i, j - i)


def _chunks(values: pa.Array) -> Iterator[list[bytes]]:
    held, n = [], 0
    for v in values.to_pylist():
        held.append(v)
        n += len(v)
        if n >= CHUNK:
            yield held
            held, n = [], 0
    if held:
        yield held


_MARKS = np.zeros(256, bool)
_MARKS[list(b'"{}[],')] = True
_QUOTE, _COMMA = 34, 44


class JsonArray:
    """The items of a JSON array."""

    separator = "}"

    @staticmethod
    def marks(data: bytes, quoted: bool, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of brackets and commas that stand outside strings, what stands there, the depth after each), and by the last the state."""
        if b"\\" in data:
            data = re.sub(rb"\\.", b"  ", data, flags=re.S)
        raw = np.frombuffer(data, np.uint8)
        at = np.flatnonzero(_MARKS[raw])
        what = raw[at]
        quotes = what == _QUOTE
        inside = (np.cumsum(quotes) + quoted) % 2 == 1
        live = ~inside & ~quotes
        at, what = at[live], what[live]
        opens = (what == 123) | (what == 91)
        closes = (what == 125) | (what == 93)
        return at, what, depth + np.cumsum(opens.astype(np.int64) - closes), bool((quotes.sum() + quoted) % 2)

    class Told:
        """What a split does from one of the two states."""

        def __init__(self, quoted: bool):
            self.quoted, self.depth, self.lowest = quoted, 0, 1 << 40
            self.commas: dict[int, int] = {}

        def feed(self, pieces: list[bytes]) -> None:
            _, what, depth, self.quoted = JsonArray.marks(b"}".join([*pieces, b""]), self.quoted, self.depth)
            if len(depth):
                closed = depth[(what == 125) | (what == 93)]
                if len(closed):
                    self.lowest = min(self.lowest, int(closed.min()))
                for d, n in zip(*np.unique(depth[(what == _COMMA) & (depth <= 1)], return_counts=True), strict=True):
                    self.commas[int(d)] = self.commas.get(int(d), 0) + int(n)
                self.depth = int(depth[-1])

    @staticmethod
    def begins(splits: list, closes: bool) -> dict[int, Begin]:
        """The state in which each split of a file begins; splits: rows of the first pass, by block."""
        out, quoted, depth, item, ended = {}, False, 0, 0, False
        for s in splits:
            out[s["block"]] = Begin(quoted, depth, item, ended, closes)
            k = int(quoted)
            item += dict(zip(s["at"][k], s["counts"][k], strict=True)).get(1 - depth, 0)
            ended = ended or depth + s["lowest"][k] <= 0
            depth, quoted = depth + s["depth"][k], s["ends"][k]
        return out

    class Cutter:
        """Cuts a split's pieces into items: (item, whole, value); what follows the array is item -1."""

        def __init__(self, begin: Begin):
            self.state, self.begin = (begin.quoted, begin.depth), begin
            self.item, self.ended = (-1 if begin.ended else begin.item), begin.ended
            self.own = False  # whether the item at hand began in this split
            self.held: list[bytes] = []

        def feed(self, pieces: list[bytes], last: bool) -> Iterator[tuple[int, bool, bytes]]:
            data = b"}".join(pieces) if last and not self.begin.closes else b"}".join([*pieces, b""])
            at, what, depth, quoted = JsonArray.marks(data, *self.state)
            self.state = quoted, int(depth[-1]) if len(depth) else self.state[1]
            cuts = (((what == _COMMA) | (what == 91)) & (depth == 1)) | ((what == 93) & (depth == 0))
            start = 0
            for place, mark in zip(at[cuts].tolist(), what[cuts].tolist(), strict=True):
                if self.ended:
                    break
                if mark == 91:  # what stands before the array is blank
                    self.held, start, self.own = [], place + 1, True
                    continue
                self.held.append(data[start:place])
                yield self.item, self.own, b"".join(self.held)
                self.held, start, self.own = [], place + 1, True
                self.item += 1
                if mark == 93:
                    self.ended, self.item, self.own = True, -1, False
            self.held.append(data[start:])

        def rest(self) -> Iterator[tuple[int, bool, bytes]]:
            yield self.item, False, b"".join(self.held)


_CLOSED = re.compile(rb'(?:[^"]++|"")*+"', re.S)
_NOTHING = (b"", b"\r")


def _still_quoted(line: bytes, quoted: bool) -> bool:
    """Whether a CSV line ends within quotes; a quote opens at the begin of a field only."""
    at = 0
    while True:
        if quoted:
            m = _CLOSED.match(line, at)
            if not m:
                return True
            at = m.end()
        elif line[at : at + 1] == b'"':
            at, quoted = at + 1, True
            continue
        quoted = False
        at = line.find(b",", at) + 1
        if not at:
            return False


def _quoted_lines(pieces: list[bytes]) -> list[int]:
    return np.flatnonzero(pc.match_substring(pa.array(pieces, pa.binary()), b'"').to_numpy(zero_copy_only=False)).tolist()


class CsvLines:
    """The records of a CSV file; a record begins with a line that isn't empty and that no quotes hold open. The first is the header."""

    separator = "\n"

    class Told:
        def __init__(self, quoted: bool):
            self.quoted, self.depth, self.lowest = quoted, 0, 0
            self.commas = {0: 0}

        def feed(self, pieces: list[bytes]) -> None:
            before = np.concatenate(([0], np.cumsum([line not in _NOTHING for line in pieces])))
            at = 0
            for i in [*_quoted_lines(pieces), len(pieces) - 1]:
                self.commas[0] += 0 if self.quoted else int(before[i + 1] - before[at])
                self.quoted = _still_quoted(pieces[i], self.quoted) if at <= i else self.quoted
                at = i + 1

    @staticmethod
    def begins(splits: list, closes: bool) -> dict[int, Begin]:
        out, quoted, item = {}, False, 0
        for s in splits:
            out[s["block"]] = Begin(quoted, 0, item, False, closes)
            item += s["counts"][int(quoted)][0]
            quoted = s["ends"][int(quoted)]
        return out

    class Cutter:
        def __init__(self, begin: Begin):
            self.quoted, self.item, self.own, self.held = begin.quoted, begin.item - 1, False, []

        def feed(self, pieces: list[bytes], last: bool) -> Iterator[tuple[int, bool, bytes]]:
            marked = set(_quoted_lines(pieces))
            for i, line in enumerate(pieces):
                if not self.quoted:
                    if line in _NOTHING:
                        continue
                    self.item, self.own = self.item + 1, True
                self.held.append(line)
                if i in marked:
                    self.quoted = _still_quoted(line, self.quoted)
                if not self.quoted:
                    yield self.item, self.own, b"\n".join(self.held)
                    self.held = []

        def rest(self) -> Iterator[tuple[int, bool, bytes]]:
            if self.held:  # the break after it is the record's, too
                yield self.item, False, b"\n".join([*self.held, b""])


def _first_pass(dialect):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, both, length, first, size = None, (), 0, b"", 0

        def told() -> pa.RecordBatch:
            rows = [[key[0]], [key[1]], [size], [length], [first], [[x.quoted for x in both]], [[x.depth for x in both]], [[x.lowest for x in both]]]
            rows += [[[list(x.commas) for x in both]], [[list(x.commas.values()) for x in both]]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.bool_()), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.list_(pa.int64()))] * 2]
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], [c.split()[0] for c in _TOLD.split(", ")])

        for path, block, total, values in _runs(batches):
            if (path, block) != key:
                if key:
                    yield told()
                key, both, length, first, size = (path, block), (dialect.Told(False), dialect.Told(True)), 0, b"", total
            for pieces in _chunks(values):
                first = first or b"".join(pieces[:64]).removeprefix(_BOM).lstrip()[:1]
                length += sum(map(len, pieces)) + len(pieces)
                for x in both:
                    x.feed(pieces)
        if key:
            yield told()

    return run


def _second_pass(dialect, begins: dict[tuple[str, int], Begin], ends: set[tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(key, rows) -> pa.RecordBatch:
            item, whole, value = zip(*rows, strict=True)
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * n), pa.array(item, pa.int64()), pa.array(whole), pa.array([key[1]] * n, pa.int64()), pa.array(value, pa.binary())], [c.split()[0] for c in _CUT.split(", ")])

        def pieces_of() -> Iterator[tuple[tuple, list[bytes]]]:
            for path, block, _, values in _runs(batches):
                for pieces in _chunks(values):
                    yield (path, block), pieces

        def marked() -> Iterator[tuple[tuple, list[bytes], bool]]:
            """Each chunk, and whether it is its split's last."""
            before = None
            for key, pieces in pieces_of():
                if before:
                    yield *before, before[0] != key
                before = key, pieces
            if before:
                yield *before, True

        key, cutter = None, None
        for at, pieces, last in marked():
            if at != key:
                key, cutter = at, dialect.Cutter(begins[at])
                if at[1] == 0:
                    pieces = [pieces[0].removeprefix(_BOM), *pieces[1:]]
            rows = list(cutter.feed(pieces, last and at in ends))
            if last:
                rows += cutter.rest()
            if rows:
                yield told(at, rows)

    return run


def records(spark: SparkSession, path: str, dialect) -> tuple[DataFrame, list[str]]:
    """(path, item, value of every record of the files at a path, files that are no array of the dialect's).

    item: the record's number in its file, from 0; -1 for what follows an array. The driver holds some numbers for each split.
    """
    source = _read(spark, path, dialect.separator)
    told: dict[str, list] = {}
    for row in source.mapInArrow(_first_pass(dialect), _TOLD).collect():
        told.setdefault(row["path"], []).append(row)
    begins, ends, others = {}, set(), []
    for file, splits in told.items():
        splits.sort(key=lambda r: r["block"])
        if dialect is JsonArray and next((bytes(s["first"]) for s in splits if s["first"]), b"") != b"[":
            others.append(file)
            continue
        # A file whose last piece no separator follows has one byte less than all pieces with one each; a byte order mark isn't read.
        closes = splits[0]["size"] - sum(s["length"] for s in splits) in (0, len(_BOM))
        begins |= {(file, block): b for block, b in dialect.begins(splits, closes).items()}
        ends.add((file, splits[-1]["block"]))
    held = source.where(F.col("file_path").isin(*{f for f, _ in begins})) if others else source
    cut = held.mapInArrow(_second_pass(dialect, begins, ends), _CUT)
    ordered = F.array_sort(F.collect_list(F.struct("block", "value")))
    joined = F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["value"]))
    split_up = cut.where("NOT whole").groupBy("path", "item").agg(joined.alias("value"))
    columns = ["path", "item", F.col("value").cast("string").alias("value")]
    return cut.where("whole").select(*columns).unionByName(split_up.select(*columns)), others
