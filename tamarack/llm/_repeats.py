"""Stretches of `length` symbols that also start in a document with a smaller doc_id.

Symbols are the words or the bytes of a text, as 64-bit hashes. Every window of `length` symbols
has one anchor: its leftmost k-gram of least hash. The windows of a text that share an anchor form
a run, and runs are what is shuffled, packed many to a row:

1. extract: a run is (anchor hash, class, document, start, windows); the class is a hash of all the
   symbols that the run's windows cover. Runs of one anchor and class are equal, window for window.
2. match: by anchor. A run whose class is also in a smaller document is matched as a whole. If
   different classes meet at an anchor, their windows may still be equal in part, on either side of
   it: the first run of each class is passed on.
3. extend: the texts of what was passed on are read again, and each window is given a hash.
4. settle: by window. A window that is also in a smaller document is matched.
5. apply: a document's matches meet its text.

Nothing is paired: a class or a window that thousands of documents share is reduced, before it is
shuffled, to its smallest document in each flush of a task, the others being matched there and
then; an anchor with more than MANY classes in a flush is only announced, and its runs go straight
to step 3. Very long texts are cut into overlapping pieces of PIECE symbols; a run that a cut
divides makes a class of its own, which step 3 and 4 resolve.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm._shared import cut, text_bytes

#: Symbols that are hashed at once, and bytes of text that are taken together for it.
PIECE = 1 << 20
#: Runs or windows that a task holds before it packs and sends them.
FLUSH = 1_000_000
#: Classes at an anchor, in one flush, above which they are compared window by window at once.
MANY = 64
#: Bytes of text whose runs make a bucket, and whose texts are taken together when matches are applied.
BUCKET_BYTES = 6 << 20
PART_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(32)
    return x


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse, i < n, modulo 2 ** 64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, _U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Hashed:
    """Hashes of any stretch of a sequence of symbols, from prefix sums of symbol * base ** place."""

    def __init__(self, symbols: np.ndarray):
        n = 1 << max(10, int(len(symbols) + 1).bit_length())
        self.up, self.down = _powers(n)
        self.sums = np.zeros(len(symbols) + 1, _U)
        np.cumsum(symbols * self.up[: len(symbols)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def rolling(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


@cache
def _byte_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _byte_table()[data]


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_symbols(data: np.ndarray) -> np.ndarray:
    """A hash for each word of one text's bytes."""
    blank = _BLANK[data]
    edge = np.diff(blank.astype(np.int8), prepend=1, append=1)
    starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    out = np.empty(len(starts), _U)
    at = 0
    while at < len(starts):  # a slice of the text at a time
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        base = int(starts[at])
        h = Hashed(byte_symbols(data[base : ends[upto - 1]]))
        out[at:upto] = mix(h.of(starts[at:upto] - base, ends[at:upto] - base) + (ends[at:upto] - starts[at:upto]).astype(_U))
        at = upto
    return out


class Runs(NamedTuple):
    """Parallel arrays; doc is a place in the flush's list of documents."""

    t0: np.ndarray
    cls: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    n: np.ndarray
    off: np.ndarray


def runs_of(symbols: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(t0, cls, piece, start, n, off) of the runs in pieces bounds[i]:bounds[i + 1] of symbols; start within the piece."""
    total = len(symbols)
    none = np.empty(0, np.int64)
    if total < length:
        return none.astype(_U), none.astype(_U), none, none, none, none
    h = Hashed(symbols)
    grams = h.rolling(k)
    bits = int(total).bit_length()
    key = (grams >> _U(bits)) << _U(bits) | np.arange(len(grams), dtype=_U)
    width, span = length - k + 1, 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    at = (key & _U((1 << bits) - 1)).astype(np.int64)
    sizes = np.diff(bounds)
    piece = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    good = np.arange(len(at)) + length <= bounds[piece + 1]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~good[:-1] | (piece[1:] != piece[:-1])
    starts = np.nonzero(new & good)[0]
    # A run ends where the next one, or a window that leaves the piece, begins.
    stops = np.nonzero(new | ~good)[0]
    ends = np.append(stops, len(at))[np.searchsorted(stops, starts, "right")]
    n, p = ends - starts, at[starts]
    cls = mix(h.of(starts, ends - 1 + length) + ((p - starts).astype(_U) << _U(32)) + n.astype(_U))
    return grams[p], cls, piece[starts], starts - bounds[piece[starts]], n, p - starts


# --- packing ---------------------------------------------------------------------------------


def _pack(arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(a) for a in arrays], np.uint32).tobytes()
    return head + b"".join(a.tobytes() for a in arrays)


def _unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    lengths = np.frombuffer(blob, np.uint32, len(kinds))
    out, at = [], 4 * len(kinds)
    for n, kind in zip(lengths.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _pack_places(doc: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Places sorted by document, then start: documents, how many each, and steps from start to start."""
    first = np.nonzero(np.diff(doc, prepend=-1))[0]
    step = np.diff(start, prepend=0)
    step[first] = start[first]
    small = np.minimum(np.maximum(step, 0), 65535)
    return [doc[first].astype(np.int64), np.diff(np.append(first, len(doc))).astype(np.uint32), small.astype(np.uint16), step[small == 65535].astype(np.int64)]


_PLACES = [np.int64, np.uint32, np.uint16, np.int64]


def _unpack_places(docs: np.ndarray, counts: np.ndarray, small: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = small.astype(np.int64)
    step[small == 65535] = large
    sums = np.cumsum(step)
    first = np.cumsum(counts.astype(np.int64)) - counts
    return np.repeat(docs, counts), sums - np.repeat(sums[first] - step[first], counts)


class _Docs:
    """The documents of a flush: doc_id and the hash that tells texts of one doc_id apart."""

    def __init__(self):
        self.ids, self.uids = [], []

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.ids, np.int64), np.array(self.uids, np.int32)


def _table_of(ids: np.ndarray, uids: np.ndarray, docs: np.ndarray) -> list[np.ndarray]:
    return [ids[docs], uids[docs]]


_KEYS = [np.int64, np.int32]


def _spread(parts: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places) for each part; order sorts places within a part."""
    order = order[np.argsort(parts[order], kind="stable")]
    held = parts[order]
    edges = np.concatenate(([0], np.nonzero(np.diff(held))[0] + 1, [len(held)]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b > a:
            yield int(held[a]), order[a:b]


def _part(ids: np.ndarray, uids: np.ndarray, n_parts: int) -> np.ndarray:
    """Spark's pmod(doc_id ^ uid, n_parts)."""
    return (ids ^ uids.astype(np.int64)) % n_parts


MATCHED, OPEN = 0, 1


def _places(kind: int, doc: np.ndarray, start: np.ndarray, n: np.ndarray, off: np.ndarray, ids: np.ndarray, uids: np.ndarray, n_parts: int):
    """Rows (part, kind, blob) of places; kind MATCHED: n windows from start are matched; OPEN: to be compared window by window."""
    if not len(doc):
        return
    part = _part(ids, uids, n_parts)[doc]
    for p, at in _spread(part, np.lexsort((start, doc))):
        d, counts, small, large = _pack_places(doc[at], start[at])
        yield p, kind, _pack([*_table_of(ids, uids, d), counts, small, large, n[at].astype(np.uint16), off[at].astype(np.uint16)])


_PLACE_KINDS = [*_KEYS, np.uint32, np.uint16, np.int64, np.uint16, np.uint16]


def _read_places(blob: bytes) -> tuple[np.ndarray, ...]:
    """(doc_id, uid, start, n, off)."""
    ids, uids, counts, small, large, n, off = _unpack(blob, _PLACE_KINDS)
    at, start = _unpack_places(np.arange(len(ids)), counts, small, large)
    return ids[at], uids[at], start, n.astype(np.int64), off.astype(np.int64)


def _rows(rows, schema_names: list[str]) -> Iterator[pa.RecordBatch]:
    """Record batches of (int, int, bytes) rows, some MB each."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > 4 << 20:
            yield _batch(held, schema_names)
            held, size = [], 0
    if held:
        yield _batch(held, schema_names)


def _batch(held, names: list[str]) -> pa.RecordBatch:
    a, b, c = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], names)


# --- 1. extract ------------------------------------------------------------------------------

#: Rows between the steps: `to` is a bucket or a part; PASS rows carry places on to their part.
RUNS, HOT, WINDOWS, PASS = 0, 1, 2, 3
_SCHEMA = "to long, kind int, blob binary"
_NAMES = ["to", "kind", "blob"]


def _pieces(batches: Iterator[pa.RecordBatch], symbols_of: Callable, length: int) -> Iterator[tuple]:
    """(symbols, bounds, ids, uids, bases): the texts' symbols in chunks, long ones in overlapping pieces."""
    held, bounds, ids, uids, bases = [], [0], [], [], []

    def done():
        return np.concatenate(held), np.array(bounds), np.array(ids, np.int64), np.array(uids, np.int32), np.array(bases, np.int64)

    for batch in batches:
        doc_ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for doc, uid, text in zip(doc_ids, hashes, batch.column(2), strict=True):
            if doc is None or not text.is_valid:
                continue
            data = np.frombuffer(text.as_buffer(), np.uint8)
            if len(data) < length:
                continue
            symbols = symbols_of(data)
            for base in range(0, max(1, len(symbols) - length + 1), PIECE):
                piece = symbols[base : base + PIECE + length - 1]
                held.append(piece)
                bounds.append(bounds[-1] + len(piece))
                ids.append(doc)
                uids.append(uid)
                bases.append(base)
                if bounds[-1] >= PIECE:
                    yield done()
                    held, bounds, ids, uids, bases = [], [0], [], [], []
    if held:
        yield done()


def _extract(symbols_of: Callable, length: int, k: int, n_buckets: int, n_parts: int):
    def flush(held):
        ids, uids = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        shift = np.cumsum([0, *[len(x[0]) for x in held]])
        runs = Runs(*[np.concatenate([x[2][j] + shift[i] if j == 2 else x[2][j] for i, x in enumerate(held)]) for j in range(6)])
        order = np.lexsort((runs.start, ids[runs.doc], runs.cls, runs.t0))
        runs = Runs(*[a[order] for a in runs])
        owner = ids[runs.doc]
        new_t0 = np.diff(runs.t0, prepend=runs.t0[0] ^ _U(1)) != 0
        new = new_t0 | (np.diff(runs.cls, prepend=runs.cls[0]) != 0)
        at = np.cumsum(new) - 1
        matched = owner > owner[np.nonzero(new)[0]][at]
        group = np.cumsum(new_t0) - 1
        many = (np.bincount(group[new]) > MANY)[group]
        for row in _places(MATCHED, *[a[matched & ~many] for a in (runs.doc, runs.start, runs.n, runs.off)], ids, uids, n_parts):
            yield -1 - row[0], PASS, bytes([row[1]]) + row[2]
        for row in _places(OPEN, *[a[many] for a in (runs.doc, runs.start, runs.n, runs.off)], ids, uids, n_parts):
            yield -1 - row[0], PASS, bytes([row[1]]) + row[2]
        hot = np.unique(runs.t0[many])
        for b, places in _spread((hot % _U(n_buckets)).astype(np.int64), np.arange(len(hot))):
            yield b, HOT, (hot[places] >> _U(32)).astype(np.uint32).tobytes()
        rest = np.nonzero(~matched & ~many)[0]
        runs = Runs(*[a[rest] for a in runs])
        for b, places in _spread((runs.t0 % _U(n_buckets)).astype(np.int64), np.lexsort((runs.start, runs.doc))):
            r = Runs(*[a[places] for a in runs])
            d, counts, small, large = _pack_places(r.doc, r.start)
            yield b, RUNS, _pack([*_table_of(ids, uids, d), counts, small, large, r.n.astype(np.uint16), r.off.astype(np.uint16), (r.t0 >> _U(32)).astype(np.uint32), r.cls])

    def run(batches):
        held, size = [], 0

        def rows():
            nonlocal held, size
            for symbols, bounds, ids, uids, bases in _pieces(batches, symbols_of, length):
                t0, cls, piece, start, n, off = runs_of(symbols, bounds, length, k)
                if len(t0):
                    held.append((ids, uids, (t0, cls, piece.astype(np.int32), (start + bases[piece]).astype(np.int64), n.astype(np.uint16), off.astype(np.uint16))))
                    size += len(t0)
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
            if held:
                yield from flush(held)

        yield from _rows(rows(), _NAMES)

    return run


# --- 2. match --------------------------------------------------------------------------------

_RUN_KINDS = [*_PLACE_KINDS, np.uint32, np.uint64]


def _grouped(key: tuple, table: pa.Table, handle: Callable) -> pa.Table:
    to = key[0].as_py()
    if to < 0:  # places on their way to a part
        blobs = [b.as_py() for b in table.column("blob")]
        rows = [(-1 - to, b[0], b[1:]) for b in blobs]
    else:
        rows = list(handle(table))
    if not rows:
        return pa.table({"to": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
    return pa.Table.from_batches(list(_rows(rows, _NAMES)))


def _match(n_parts: int):
    def handle(table: pa.Table):
        kinds = np.asarray(table.column("kind"))
        blobs = table.column("blob")
        hot = [np.frombuffer(blobs[i].as_buffer(), np.uint32) for i in np.nonzero(kinds == HOT)[0].tolist()]
        hot = np.unique(np.concatenate(hot)) if hot else np.empty(0, np.uint32)
        got = []
        for i in np.nonzero(kinds == RUNS)[0].tolist():
            ids, uids, counts, small, large, n, off, t0, cls = _unpack(blobs[i].as_buffer(), _RUN_KINDS)
            at, start = _unpack_places(np.arange(len(ids)), counts, small, large)
            got.append((ids[at], uids[at], start, n, off, t0, cls))
        if not got:
            return
        ids, uids, start, n, off, t0, cls = (np.concatenate([g[j] for g in got]) for j in range(7))
        del got
        # Only anchors of two documents, or more, or hot ones matter.
        order = np.argsort(t0, kind="stable")
        held = t0[order]
        first = np.nonzero(np.diff(held, prepend=~held[0] if len(held) else 0))[0]
        low, high = np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first)
        useful = np.repeat((low < high) | np.isin(held[first], hot), np.diff(np.append(first, len(held))))
        order = order[useful]
        if not len(order):
            return
        ids, uids, start, n, off, t0, cls = (a[order] for a in (ids, uids, start, n, off, t0, cls))
        order = np.lexsort((ids, cls, t0))
        ids, uids, start, n, off, t0, cls = (a[order] for a in (ids, uids, start, n, off, t0, cls))
        new_t0 = np.diff(t0.astype(np.int64), prepend=-1) != 0
        new = new_t0.copy()
        new[1:] |= cls[1:] != cls[:-1]
        owner = ids[np.nonzero(new)[0]][np.cumsum(new) - 1]
        group = np.cumsum(new_t0) - 1
        several = (np.bincount(group[new]) > 1)[group] | np.isin(t0, hot)
        matched = ids > owner
        for kind, chosen in ((MATCHED, matched), (OPEN, ~matched & several)):
            chosen = np.nonzero(chosen)[0]
            doc = np.arange(len(chosen))
            keys = np.stack((ids[chosen], uids[chosen].astype(np.int64)))
            unique, doc = np.unique(keys, axis=1, return_inverse=True)
            yield from _places(kind, doc.reshape(-1), start[chosen], n[chosen], off[chosen], unique[0], unique[1].astype(np.int32), n_parts)

    return lambda key, table: _grouped(key, table, handle)


# --- 3. extend -------------------------------------------------------------------------------


def _by_document(blobs) -> dict[tuple[int, int], list]:
    """Places of a part by (doc_id, uid)."""
    found: dict[tuple[int, int], list] = {}
    for blob in blobs:
        ids, uids, start, n, off = _read_places(blob.as_buffer())
        edges = np.concatenate(([0], np.nonzero((ids[1:] != ids[:-1]) | (uids[1:] != uids[:-1]))[0] + 1, [len(ids)]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            found.setdefault((int(ids[a]), int(uids[a])), []).append((start[a:b], n[a:b], off[a:b]))
    return found


def _extend(symbols_of: Callable, length: int, k: int, n_buckets: int, n_parts: int):
    def flush(held):
        ids = np.array([x[0] for x in held], np.int64)
        uids = np.array([x[1] for x in held], np.int32)
        start = np.concatenate([x[2] for x in held])
        key = np.concatenate([x[3] for x in held])
        second = np.concatenate([x[4] for x in held])
        doc = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
        order = np.lexsort((start, ids[doc], second, key))
        start, key, second, doc = (a[order] for a in (start, key, second, doc))
        owner = ids[doc]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (second[1:] != second[:-1])
        matched = owner > owner[np.nonzero(new)[0]][np.cumsum(new) - 1]
        one = np.ones(len(key), np.uint16)
        for row in _places(MATCHED, doc[matched], start[matched], one[matched], one[matched], ids, uids, n_parts):
            yield -1 - row[0], PASS, bytes([row[1]]) + row[2]
        rest = np.nonzero(~matched)[0]
        start, key, second, doc = (a[rest] for a in (start, key, second, doc))
        for b, places in _spread((key % _U(n_buckets)).astype(np.int64), np.lexsort((start, doc))):
            d, counts, small, large = _pack_places(doc[places], start[places])
            yield b, WINDOWS, _pack([*_table_of(ids, uids, d), counts, small, large, key[places], second[places]])

    def run(key, texts: pa.Table, places: pa.Table) -> pa.Table:
        wanted = _by_document(places.column("blob")) if places.num_rows else {}
        rows, held, size = [], [], 0
        if wanted:
            for doc, uid, text in zip(texts.column("doc_id"), texts.column("uid"), texts.column("text"), strict=True):
                at = wanted.pop((doc.as_py(), uid.as_py()), None)
                if at is None or not text.is_valid:
                    continue
                symbols = symbols_of(np.frombuffer(text.as_buffer(), np.uint8))
                start, n, off = (np.concatenate([x[j] for x in at]) for j in range(3))
                windows = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                anchors = np.repeat(start + off, n)
                windows, first = np.unique(windows, return_index=True)
                anchors = anchors[first]
                for base in range(0, len(symbols), PIECE):
                    a, b = np.searchsorted(windows, (base, base + PIECE))
                    if b > a:
                        h = Hashed(symbols[base : base + PIECE + 2 * length])
                        own, mark = windows[a:b] - base, anchors[a:b] - base
                        held.append((doc.as_py(), uid.as_py(), windows[a:b], h.of(own, own + length), (h.of(mark, mark + k) >> _U(32)).astype(np.uint32)))
                        size += b - a
                if size >= FLUSH:
                    rows += flush(held)
                    held, size = [], 0
            if held:
                rows += flush(held)
        if not rows:
            return pa.table({"to": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        return pa.Table.from_batches(list(_rows(rows, _NAMES)))

    return run


# --- 4. settle -------------------------------------------------------------------------------

_WINDOW_KINDS = [*_KEYS, np.uint32, np.uint16, np.int64, np.uint64, np.uint32]


def _settle(n_parts: int):
    def handle(table: pa.Table):
        got = []
        for blob in table.column("blob"):
            ids, uids, counts, small, large, key, second = _unpack(blob.as_buffer(), _WINDOW_KINDS)
            at, start = _unpack_places(np.arange(len(ids)), counts, small, large)
            got.append((ids[at], uids[at], start, key, second))
        ids, uids, start, key, second = (np.concatenate([g[j] for g in got]) for j in range(5))
        del got
        order = np.lexsort((ids, second, key))
        new = np.ones(len(order), bool)
        k, s = key[order], second[order]
        new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        owner = ids[order][np.nonzero(new)[0]][np.cumsum(new) - 1]
        chosen = order[ids[order] > owner]
        if len(chosen):
            unique, doc = np.unique(np.stack((ids[chosen], uids[chosen].astype(np.int64))), axis=1, return_inverse=True)
            one = np.ones(len(chosen), np.uint16)
            yield from _places(MATCHED, doc.reshape(-1), start[chosen], one, one, unique[0], unique[1].astype(np.int32), n_parts)

    return lambda key, table: _grouped(key, table, handle)


# --- 5. apply --------------------------------------------------------------------------------


def spans(at: list, length: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches that matched windows cover."""
    start, n = np.concatenate([x[0] for x in at]), np.concatenate([x[1] for x in at])
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + n - 1 + length)[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.nonzero(new)[0]
    return start[first], np.minimum(end[np.append(first[1:], len(start)) - 1], total)


def check_lengths(length: int, k: int) -> None:
    """A run has up to length - k + 1 windows, which rows hold in 16 bits."""
    if not 0 < k <= length or length - k + 1 > 0xFFFF:
        raise ValueError(f"an anchor of {k} symbols doesn't go with a length of {length}")


def repeats(docs: DataFrame, symbols_of: Callable, finish: Callable, schema: str, *, length: int, k: int) -> DataFrame:
    """finish(data, starts, ends) of every document, with the stretches that smaller documents have.

    docs: doc_id, text. finish gets the text's bytes and arrays of symbol places; it returns the
    values that follow doc_id in schema.
    """
    check_lengths(length, k)
    total = text_bytes(docs)
    n_buckets, n_parts = max(1, -(-total // BUCKET_BYTES)), max(1, -(-total // PART_BYTES))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("uid"), F.col("text").cast("binary").alias("text"))
    part = F.pmod(F.coalesce("doc_id", F.lit(0)).bitwiseXOR(F.col("uid").cast("long")), F.lit(n_parts)).alias("to")
    dealt = texts.select(part, "doc_id", "uid", "text")

    runs = texts.mapInArrow(_extract(symbols_of, length, k, n_buckets, n_parts), _SCHEMA)
    matches = cut(runs.groupBy("to").applyInArrow(_match(n_parts), _SCHEMA), "matches")
    still_open = matches.where(F.col("kind") == OPEN)
    windows = dealt.groupBy("to").cogroup(still_open.groupBy("to")).applyInArrow(_extend(symbols_of, length, k, n_buckets, n_parts), _SCHEMA)
    settled = cut(windows.groupBy("to").applyInArrow(_settle(n_parts), _SCHEMA), "settled")
    found = matches.where(F.col("kind") == MATCHED).unionByName(settled.where(F.col("kind") == MATCHED))
    names = [x.split()[0] for x in schema.split(",")]
    empty = np.empty(0, np.int64)

    def apply(key, held: pa.Table, places: pa.Table) -> pa.Table:
        by = _by_document(places.column("blob")) if places.num_rows else {}
        columns: list[list] = [[] for _ in names]
        for doc, uid, text in zip(held.column("doc_id"), held.column("uid"), held.column("text"), strict=True):
            at = by.get((doc.as_py(), uid.as_py()))
            data = text.as_buffer() if text.is_valid else pa.py_buffer(b"")
            starts, ends = spans(at, length, len(data)) if at else (empty, empty)
            for column, value in zip(columns, (doc.as_py(), *finish(data, starts, ends)), strict=True):
                column.append(value)
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        return pa.table({n: pa.array(c, kinds[x.split()[1]]) for n, c, x in zip(names, columns, schema.split(","), strict=True)})

    return dealt.groupBy("to").cogroup(found.groupBy("to")).applyInArrow(apply, schema)
