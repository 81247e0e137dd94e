"""Suffix-array dedup of bytes: range-partitioned, sorted suffixes over a sparse suffix array.

Only sampled suffixes are sorted, those that start at an anchor: of each stretch of `length` bytes, the leftmost of its
tokens (of `token` bytes) of least hash. So equal stretches have the same anchor at the same place, and every repeat
shows at suffixes that share their leading token. A run is the stretches of a text that have one anchor, and is shipped as its
bytes: the suffix from the anchor as far as they reach, and what stands before it.

1. Texts that equal one of a smaller document go as a whole, by their SHA-256, before any suffix is taken.
2. tokens: which anchors' tokens occur in two documents or more; only their runs go on. A sample of suffixes comes along.
3. Quantiles of the sample split the order of suffixes into ranges by their leading tokens; runs are dealt to the range they
   fall into. A token that fills several ranges, as boilerplate may, has its boundaries within: its stretches are dealt one by
   one, by all their bytes, so that what is equal is compared wherever a boundary cuts through.
4. A bucket is sorted by multikey quicksort, level by level: all groups of suffixes that are equal so far are divided by
   their next eight bytes, and only groups of two or more are looked at again. What is left equal at the end is equal, byte for
   byte. First whole runs are sorted (suffix, then what stands before it); where a token has runs that differ, their
   single stretches are sorted likewise. A stretch that a document with a smaller doc_id has too is matched.
5. A document's matches meet its text.

A task sorts and reduces what it ships in the same way, so a run that thousands of documents share leaves it once. Nothing
is paired. Every stretch of at least `length` bytes that also starts in a document with a smaller doc_id goes. Matches never
cross documents.

Defined results: a null text is empty; texts shorter than the length keep all; repeated rows of one
doc_id don't match each other; rows with a null doc_id are kept whole and match nothing; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import _repeats as packs
from tamarack.llm._shared import cut, join_checked, text_bytes

LENGTH = 50
#: Bytes of a token: 50 - 20 + 1 = 31 tokens to choose from in each stretch.
TOKEN = 20
#: Bytes of text whose tokens or suffixes make a bucket, and whose texts are taken together.
BUCKET_BYTES = 6 << 20
PART_BYTES = 4 << 20
#: Ranges that splitters make; more buckets than these divide a range by the hash of the token.
MOST_RANGES = 4096
#: Sampled suffixes for each splitter.
SAMPLED = 32
#: Runs or stretches that a task holds before it reduces and sends them, and of which bytes are gathered at once.
FLUSH, GATHERED = 250_000, 20_000

_U = np.uint64
RUNS, STRETCHES, ANNOUNCED, PASS = 0, 1, 2, 3
MATCHED, OPEN, COPY, SAMPLE = packs.MATCHED, packs.OPEN, 2, 3
_SCHEMA = "to long, kind int, blob binary"
_NAMES = ["to", "kind", "blob"]
_TOKEN_KINDS = [*packs._PLACE_KINDS, np.uint32]
_RUN_KINDS = [*packs._PLACE_KINDS, np.uint8]


# --- sorting ---------------------------------------------------------------------------------


def eight(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The eight bytes of data from each start, as numbers in the order of the bytes; zeros from the ends on. data ends with eight bytes more."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)[np.minimum(starts, len(data) - 8)]
    value = np.ascontiguousarray(words).view(">u8").reshape(-1).astype(_U)
    gone = np.clip(8 - (ends - starts), 0, 8).astype(_U)
    return np.where(gone >= 8, _U(0), value >> (np.minimum(gone, 7) * _U(8)) << (np.minimum(gone, 7) * _U(8)))


def multikey_sort(digits: list[Callable[[np.ndarray], np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads) of n rows: sorted by their digits, and in that order, whether a row differs from the one before it.

    Multikey quicksort by levels: each divides the groups that were equal so far by the next digit; rows that are alone stay where they are.
    """
    order, heads = np.arange(n), np.zeros(n, bool)
    heads[:1] = True
    active = np.arange(n) if n > 1 else np.arange(0)
    for digit in digits:
        if not len(active):
            break
        rows = order[active]
        d = digit(rows)
        groups = np.cumsum(heads[active])
        by = np.argsort(d, kind="stable") if groups[-1] == groups[0] else np.lexsort((d, groups))
        order[active] = rows[by]
        d, new = d[by], heads[active]
        new[1:] |= d[1:] != d[:-1]
        heads[active] = new
        alone = new & np.append(new[1:], True)
        active = active[~alone]
    return order, heads


class Runs:
    """Runs of stretches, with the bytes they cover: ids and uids of documents, and for each run its document, start, n, off and bytes."""

    def __init__(self, length: int, ids, uids, doc, start, n, off, data):
        self.length, self.ids, self.uids, self.doc, self.start, self.n, self.off = length, ids, uids, doc, start, n, off
        self.sizes = n + length - 1
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.data = np.concatenate((data, np.zeros(8, np.uint8)))

    def owners(self) -> np.ndarray:
        return self.ids[self.doc]

    def take(self, rows: np.ndarray) -> Runs:
        return Runs(self.length, self.ids, self.uids, self.doc[rows], self.start[rows], self.n[rows], self.off[rows], _gathered(self.data, self.begins[rows], self.sizes[rows]))

    def tokens(self, token: int) -> np.ndarray:
        """The leading tokens of the suffixes."""
        at = (self.begins + self.off)[:, None] + np.arange(token)
        return np.ascontiguousarray(self.data[at]).view(f"S{token}").reshape(-1)

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """Order and heads, by the suffixes from the anchors, then by what stands before these."""
        at, left = self.begins + self.off, self.begins
        longest = int((self.ends - at).max(initial=0))
        digits = [lambda rows, k=k: eight(self.data, at[rows] + k, self.ends[rows]) for k in range(0, longest, 8)]
        digits.append(lambda rows: self.off[rows].astype(_U) << _U(32) | self.n[rows].astype(_U))
        digits += [lambda rows, k=k: eight(self.data, left[rows] + k, at[rows]) for k in range(0, int(self.off.max(initial=0)), 8)]
        return multikey_sort(digits, len(self.doc))

    def single(self) -> Runs:
        """Each stretch as a run of its own."""
        rows = np.repeat(np.arange(len(self.n)), self.n)
        step = np.arange(len(rows)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        data = _gathered(self.data, self.begins[rows] + step, np.full(len(rows), self.length))
        one, zero = np.ones(len(rows), np.int64), np.zeros(len(rows), np.int64)
        return Runs(self.length, self.ids, self.uids, self.doc[rows], self.start[rows] + step, one, zero, data)


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """data[starts[i] : starts[i] + sizes[i]], one after the other, with places for some thousand of them at a time."""
    out = np.empty(int(sizes.sum()), np.uint8)
    done = 0
    for at in range(0, len(starts), GATHERED):
        first, size = starts[at : at + GATHERED], sizes[at : at + GATHERED]
        total = int(size.sum())
        places = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)
        out[done : done + total] = data[places]
        done += total
    return out


def _hashes(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A hash of each data[starts[i] : starts[i] + size]."""
    h = np.full(len(starts), size, _U)
    for k in range(0, size, 8):
        h = packs.mix(h ^ eight(data, starts + k, starts + size))
    return h


def _first_owners(owners: np.ndarray, order: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """For each row in sorted order, the smallest owner of its group."""
    if not len(order):
        return owners
    first = np.nonzero(heads)[0]
    return np.minimum.reduceat(owners[order], first)[np.cumsum(heads) - 1]


def _reduced(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are matched by an equal one of a smaller document, and in sorted order those that are not."""
    order, heads = runs.sorted()
    matched = runs.owners()[order] > _first_owners(runs.owners(), order, heads)
    return order[matched], order[~matched]


# --- steps -----------------------------------------------------------------------------------


def _tokens(length: int, token: int, n_buckets: int, n_parts: int, stride: int):
    """Step 2, before the shuffle: rows of anchors by token hash, places of those that are shared already, and sampled suffixes."""

    def flush(held):
        ids, uids = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        shift = np.cumsum([0, *[len(x[0]) for x in held]])
        doc = np.concatenate([x[2] + shift[i] for i, x in enumerate(held)])
        t0, start, n, off = (np.concatenate([x[j] for x in held]) for j in range(3, 7))
        order = np.argsort(t0, kind="stable")
        first = np.nonzero(np.diff(t0[order], prepend=~t0[order[0]]))[0]
        owner = ids[doc[order]]
        shared = np.minimum.reduceat(owner, first) < np.maximum.reduceat(owner, first)
        sizes = np.diff(np.append(first, len(order)))
        there, rest = order[np.repeat(shared, sizes)], order[~np.repeat(shared, sizes)]
        for to, kind, blob in packs._places(OPEN, doc[there], start[there], n[there], off[there], ids, uids, n_parts):
            yield -1 - to, PASS, bytes([kind]) + blob
        known = t0[order[first[shared]]]
        for b, at in packs._spread((known % _U(n_buckets)).astype(np.int64), np.arange(len(known))):
            yield b, ANNOUNCED, (known[at] >> _U(32)).astype(np.uint32).tobytes()
        for b, at in packs._spread((t0[rest] % _U(n_buckets)).astype(np.int64), np.lexsort((start[rest], doc[rest]))):
            at = rest[at]
            d, counts, small, large = packs._pack_places(doc[at], start[at])
            yield b, RUNS, packs._pack([ids[d], uids[d], counts, small, large, n[at].astype(np.uint16), off[at].astype(np.uint16), (t0[at] >> _U(32)).astype(np.uint32)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held, size, seen = [], 0, 0
            for data, bounds, ids, uids, bases in _texts(batches, length):
                t0, _, piece, start, n, off = packs.runs_of(packs.byte_symbols(data), bounds, length, token)
                if len(t0):
                    held.append((ids, uids, piece, t0, start + bases[piece], n, off))
                    size += len(t0)
                    picked = np.arange((-seen) % stride, len(t0), stride)
                    seen += len(t0)
                    if len(picked):
                        at = bounds[piece[picked]] + start[picked] + off[picked]
                        padded = np.concatenate((data, np.zeros(length, np.uint8)))
                        yield -1, PASS, bytes([SAMPLE]) + np.ascontiguousarray(padded[at[:, None] + np.arange(token)]).tobytes()
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
            if held:
                yield from flush(held)

        yield from packs._rows(rows(), _NAMES)

    return run


def _texts(batches, length: int):
    """(bytes, bounds, ids, uids, bases) of texts in chunks, long ones in overlapping pieces."""
    yield from packs._pieces(batches, lambda data: data, length)


def _shared():
    """Step 2, after the shuffle: the places of tokens that two documents have."""

    def handle(table: pa.Table, n_parts: int):
        kinds, blobs = np.asarray(table.column("kind")), table.column("blob")
        known = [np.frombuffer(blobs[i].as_buffer(), np.uint32) for i in np.nonzero(kinds == ANNOUNCED)[0].tolist()]
        known = np.unique(np.concatenate(known)) if known else np.empty(0, np.uint32)
        got = []
        for i in np.nonzero(kinds == RUNS)[0].tolist():
            ids, uids, counts, small, large, n, off, t0 = packs._unpack(blobs[i].as_buffer(), _TOKEN_KINDS)
            at, start = packs._unpack_places(np.arange(len(ids)), counts, small, large)
            got.append((ids[at], uids[at], start, n, off, t0))
        if not got:
            return
        ids, uids, start, n, off, t0 = (np.concatenate([g[j] for g in got]) for j in range(6))
        del got
        order = np.argsort(t0, kind="stable")
        first = np.nonzero(np.diff(t0[order], prepend=~t0[order[:1]]))[0]
        low, high = np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first)
        useful = (low < high) | np.isin(t0[order[first]], known)
        chosen = order[np.repeat(useful, np.diff(np.append(first, len(order))))]
        if len(chosen):
            unique, doc = np.unique(np.stack((ids[chosen], uids[chosen].astype(np.int64))), axis=1, return_inverse=True)
            yield from packs._places(OPEN, doc.reshape(-1), start[chosen], n[chosen], off[chosen], unique[0], unique[1].astype(np.int32), n_parts)

    return handle


def splitters(sample: list[bytes], token: int, n_ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens that begin a range, tokens that fill more than one) from quantiles of sampled leading tokens."""
    each = sorted(blob[i : i + token] for blob in sample for i in range(0, len(blob), token))
    if not each or n_ranges < 2:
        return np.empty(0, f"S{token}"), np.empty(0, f"S{token}")
    cuts = np.array([each[len(each) * k // n_ranges] for k in range(1, n_ranges)], f"S{token}")
    starts, counts = np.unique(cuts, return_counts=True)
    return starts, starts[counts > 1]


def _by_key(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes % _U(n)).astype(np.int64)


def _deal(length: int, token: int, n_parts: int, starts: np.ndarray, wide: np.ndarray, subs: int):
    """Step 3: the runs at shared tokens, reduced, to their ranges; stretches of wide tokens one by one."""
    n_ranges = len(starts) + 1

    def emit(kind: int, runs: Runs, to: np.ndarray):
        for b, at in packs._spread(to, np.lexsort((runs.start, runs.doc))):
            r = runs.take(at)
            d, counts, small, large = packs._pack_places(r.doc, r.start)
            yield b, kind, packs._pack([runs.ids[d], runs.uids[d], counts, small, large, r.n.astype(np.uint16), r.off.astype(np.uint16), r.data[:-8]])

    def matches(runs: Runs, rows: np.ndarray):
        for to, kind, blob in packs._places(MATCHED, runs.doc[rows], runs.start[rows], runs.n[rows], runs.off[rows], runs.ids, runs.uids, n_parts):
            yield -1 - to, PASS, bytes([kind]) + blob

    def flush(held):
        sizes = [len(x[2]) for x in held]
        ids, uids = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int32)
        start, n, off = (np.concatenate([x[j] for x in held]).astype(np.int64) for j in (2, 3, 4))
        runs = Runs(length, ids, uids, np.repeat(np.arange(len(held)), sizes), start, n, off, np.concatenate([x[5] for x in held]))
        matched, rest = _reduced(runs)
        yield from matches(runs, matched)
        runs = runs.take(rest)
        tokens = runs.tokens(token)
        is_wide = np.isin(tokens, wide)
        to = np.searchsorted(starts, tokens, "right") * subs + _by_key(_hashes(runs.data, runs.begins + runs.off, token), subs)
        narrow = np.nonzero(~is_wide)[0]
        yield from emit(RUNS, runs.take(narrow), to[narrow])
        if is_wide.any():
            each = runs.take(np.nonzero(is_wide)[0]).single()
            matched, rest = _reduced(each)
            yield from matches(each, matched)
            each = each.take(rest)
            yield from emit(STRETCHES, each, n_ranges * subs + _by_key(_hashes(each.data, each.begins, length), n_ranges * subs))

    def run(key, texts: pa.Table, places: pa.Table) -> pa.Table:
        wanted = packs._by_document(places.column("blob")) if places.num_rows else {}
        rows, held, size = [], [], 0
        if wanted:
            for doc, uid, text in zip(texts.column("doc_id"), texts.column("uid"), texts.column("text"), strict=True):
                at = wanted.pop((doc.as_py(), uid.as_py()), None)
                if at is None or not text.is_valid:
                    continue
                start, n, off = (np.concatenate([x[j] for x in at]) for j in range(3))
                order = np.argsort(start, kind="stable")
                start, n, off = start[order], n[order], off[order]
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for a in range(0, len(start), FLUSH):
                    s, m = start[a : a + FLUSH], n[a : a + FLUSH]
                    held.append((doc.as_py(), uid.as_py(), s, m, off[a : a + FLUSH], _gathered(data, s, m + length - 1)))
                    size += len(s)
                    if size >= FLUSH:
                        rows += flush(held)
                        held, size = [], 0
            if held:
                rows += flush(held)
        return _table(rows)

    return run


def _table(rows: list) -> pa.Table:
    if not rows:
        return pa.table({"to": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
    return pa.Table.from_batches(list(packs._rows(rows, _NAMES)))


def _read(table: pa.Table, length: int) -> dict[int, Runs]:
    kinds, blobs = np.asarray(table.column("kind")), table.column("blob")
    found = {}
    for kind in (RUNS, STRETCHES):
        got, n_docs = [], 0
        for i in np.nonzero(kinds == kind)[0].tolist():
            ids, uids, counts, small, large, n, off, data = packs._unpack(blobs[i].as_buffer(), _RUN_KINDS)
            doc, start = packs._unpack_places(np.arange(len(ids)), counts, small, large)
            got.append((ids, uids, doc + n_docs, start, n.astype(np.int64), off.astype(np.int64), data))
            n_docs += len(ids)
        if got:
            found[kind] = Runs(length, *(np.concatenate([g[j] for g in got]) for j in range(7)))
    return found


def _sorted(length: int, token: int):
    """Step 4: a bucket's runs and stretches, sorted; the places of those that a smaller document has."""

    def handle(table: pa.Table, n_parts: int):
        def places(runs: Runs, rows: np.ndarray):
            yield from packs._places(MATCHED, runs.doc[rows], runs.start[rows], runs.n[rows], runs.off[rows], runs.ids, runs.uids, n_parts)

        found = _read(table, length)
        if STRETCHES in found:
            yield from places(found[STRETCHES], _reduced(found[STRETCHES])[0])
        if RUNS not in found:
            return
        matched, rest = _reduced(found[RUNS])
        yield from places(found[RUNS], matched)
        runs = found.pop(RUNS).take(rest)  # in the order of their suffixes
        tokens = runs.tokens(token)
        first = np.nonzero(np.append(True, tokens[1:] != tokens[:-1]))[0]
        low, high = np.minimum.reduceat(runs.owners(), first), np.maximum.reduceat(runs.owners(), first)
        sizes = np.diff(np.append(first, len(tokens)))
        several = np.nonzero(np.repeat(low < high, sizes))[0]  # runs that differ as a whole may agree in part
        windows = np.cumsum(runs.n[several])
        group = np.repeat(np.arange(len(first)), sizes)[several]
        at = 0
        while at < len(several):  # whole tokens, some hundred thousand stretches at a time
            upto = int(np.searchsorted(windows, (windows[at - 1] if at else 0) + FLUSH, "right"))
            upto = max(at + 1, upto)
            upto = int(np.searchsorted(group, group[upto - 1], "right"))
            each = runs.take(several[at:upto]).single()
            yield from places(each, _reduced(each)[0])
            at = upto

    return handle


def _grouped(handle: Callable, n_parts: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        to = key[0].as_py()
        if to < 0:  # on its way to a part
            blobs = [b.as_py() for b in table.column("blob")]
            return _table([(-1 - to, b[0], b[1:]) for b in blobs])
        return _table(list(handle(table, n_parts)))

    return run


def _copies(n_parts: int):
    """Documents whose text a smaller one has, packed for their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                ids, uids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                for part, at in packs._spread(packs._part(ids, uids, n_parts), np.arange(len(ids))):
                    yield part, COPY, packs._pack([ids[at], uids[at]])

        yield from packs._rows(rows(), _NAMES)

    return run


def repeats(docs: DataFrame, finish: Callable, schema: str, *, length: int = LENGTH, token: int = TOKEN) -> DataFrame:
    """finish(data, starts, ends) of every document: its bytes and the places of the stretches that smaller documents have."""
    packs.check_lengths(length, token)
    total = text_bytes(docs)
    n_buckets, n_parts = max(1, -(-total // BUCKET_BYTES)), max(1, -(-total // PART_BYTES))
    n_ranges = min(n_buckets, MOST_RANGES)
    subs = -(-n_buckets // n_ranges)
    stride = max(1, 2 * total // (length - token + 2) // (SAMPLED * n_ranges))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("uid"), F.col("text").cast("binary").alias("text"))
    part = F.pmod(F.coalesce("doc_id", F.lit(0)).bitwiseXOR(F.col("uid").cast("long")), F.lit(n_parts)).alias("to")
    dealt = texts.select(part, "doc_id", "uid", "text")

    long_ones = texts.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    keyed = cut(long_ones.select("doc_id", "uid", F.sha2("text", 256).alias("digest")), "digests")
    firsts = cut(keyed.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "firsts")
    copies = join_checked(keyed, firsts, "digest", "inner").where("doc_id > first").select("doc_id", "uid").distinct()
    copies = cut(copies.select(F.col("doc_id").alias("_d"), F.col("uid").alias("_u")), "copies")
    alone = join_checked(long_ones, copies, (F.col("doc_id") == F.col("_d")) & (F.col("uid") == F.col("_u")), "left_anti")

    tokens = alone.select("doc_id", "uid", "text").mapInArrow(_tokens(length, token, n_buckets, n_parts, stride), _SCHEMA)
    shared = cut(tokens.groupBy("to").applyInArrow(_grouped(_shared(), n_parts), _SCHEMA), "shared")
    sample = [bytes(r["blob"]) for r in shared.where(F.col("kind") == SAMPLE).select("blob").collect()]  # SAMPLED tokens for each range
    starts, wide = splitters(sample, token, n_ranges)
    runs = dealt.groupBy("to").cogroup(shared.where(F.col("kind") == OPEN).groupBy("to")).applyInArrow(_deal(length, token, n_parts, starts, wide, subs), _SCHEMA)
    matches = cut(runs.groupBy("to").applyInArrow(_grouped(_sorted(length, token), n_parts), _SCHEMA), "matches")
    found = matches.unionByName(copies.mapInArrow(_copies(n_parts), _SCHEMA))
    names = [x.split()[0] for x in schema.split(",")]

    def apply(key, held: pa.Table, places: pa.Table) -> pa.Table:
        kinds = np.asarray(places.column("kind")) if places.num_rows else np.empty(0, np.int32)
        blobs = places.column("blob")
        by = packs._by_document([blobs[i] for i in np.nonzero(kinds == MATCHED)[0].tolist()])
        whole = set()
        for i in np.nonzero(kinds == COPY)[0].tolist():
            whole.update(zip(*[a.tolist() for a in packs._unpack(blobs[i].as_buffer(), packs._KEYS)], strict=True))
        columns: list[list] = [[] for _ in names]
        for doc, uid, text in zip(held.column("doc_id"), held.column("uid"), held.column("text"), strict=True):
            own = (doc.as_py(), uid.as_py())
            data = text.as_buffer() if text.is_valid else pa.py_buffer(b"")
            starts = ends = np.empty(0, np.int64)
            if own in whole:
                starts, ends = np.array([0]), np.array([len(data)])
            elif own in by:
                starts, ends = packs.spans(by[own], length, len(data))
            for column, value in zip(columns, (doc.as_py(), *finish(data, starts, ends)), strict=True):
                column.append(value)
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        return pa.table({n: pa.array(c, types[x.split()[1]]) for n, c, x in zip(names, columns, schema.split(","), strict=True)})

    return dealt.groupBy("to").cogroup(found.groupBy("to")).applyInArrow(apply, schema)


def _kept(data, starts: np.ndarray, ends: np.ndarray) -> bytes:
    raw = data.to_pybytes()
    if not len(starts):
        return raw
    edges = [0, *np.stack((starts, ends), 1).reshape(-1).tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def digests(docs: DataFrame, length: int = LENGTH, token: int = TOKEN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def finish(data, starts, ends):
        return data.size, int((ends - starts).sum()), len(starts), hashlib.sha256(_kept(data, starts, ends)).hexdigest()

    return repeats(docs, finish, "doc_id long,n_bytes long,n_removed long,n_spans long,kept_sha256 string", length=length, token=token)


def deduplicated(docs: DataFrame, length: int = LENGTH, token: int = TOKEN) -> DataFrame:
    """doc_id and the bytes that are kept."""

    def finish(data, starts, ends):
        return (_kept(data, starts, ends),)

    return repeats(docs, finish, "doc_id long,kept binary", length=length, token=token)
