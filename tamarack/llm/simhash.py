"""SimHash near-duplicate groups by bit-sliced comparison.

A text's fingerprint has a bit for each of the 64 bits of its word-shingle hashes, set if set in
over half of them. Fingerprints link at `radius` or fewer differing bits, and a document's
component is the smallest doc_id reachable over links.

Only distinct fingerprints are compared, each under its smallest doc_id. Two that differ in at
most `radius` bits agree on all but `radius` of radius + 2 bands, so they meet in a block keyed by
some two bands. In a block the fingerprints are stored as bit planes: plane b holds bit b of every
fingerprint, packed 64 to a machine word. A fingerprint is compared with a whole block at once by
adding the planes' mismatches into carry-save counters, bitwise; the comparison is abandoned once
every lane has exceeded the radius. A block keeps of its links only a star for each of its own
connected groups, which loses no connection. A block with more than `block` fingerprints is dealt into
parts that meet pairwise, so no task holds more than two parts of it.

Defined results: a text without words (empty or null) has fingerprint zero and links like any
other; fewer words than a shingle give the whole sequence as the one shingle; repeated rows each give a
row; a row with a null doc_id gets its group's component but never names one (null if nothing else
does); an empty table gives an empty result; other columns are ignored.

representatives() is for near duplicates by likeness, not by a few bits: texts whose sets of five-word
shingles have a Jaccard likeness of 0.8 lie some ten bits apart, too many for blocks by bands of
bits. Its blocks are keyed by bands of MinHashes, BANDS keys of ROWS least hashes each, so that a pair of
likeness 0.8 shares none with probability (1 - 0.8 ** ROWS) ** BANDS, below 1e-7. In a block the fingerprints are compared
bit-sliced at NEAR_RADIUS, and what isn't farther apart is verified on the shingles' own hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm._components import components
from tamarack.llm._shared import cut, join_checked, partitions

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints that are compared with each other in one go.
BLOCK = 2048

NEAR_SHINGLE, THRESHOLD = 5, 0.8
#: Texts of likeness 0.8 differ in 9.7 of 64 bits on average, with a deviation of 3; very short ones in up to 12.
NEAR_RADIUS = 26
BANDS, ROWS = 32, 4
#: Texts whose shingles are held together are up to twice as many.
NEAR_BLOCK = 512
_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_ODD = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text."""
    data = text.encode() if isinstance(text, str) else bytes(text or b"")
    words = data.lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    ones, n, count = np.zeros(64, np.int64), 0, len(words) - shingle + 1
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    for at in range(0, count, 65536):  # so that a very long text needs no more memory
        upto = min(count, at + 65536)
        pairs = zip(starts[at:upto].tolist(), ends[at + shingle - 1 : upto + shingle - 1].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64, upto - at)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += upto - at
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_buffer() if x.is_valid else None, shingle, seed) for x in batch.column(1)]
            fps = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return frame.mapInArrow(run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """64 bit planes of uint64 fingerprints: [bit, word], lane k of word w being fingerprint 64 * w + k."""
    words = -(-len(fps) // 64)
    held = np.zeros(words * 64, np.uint64)
    held[: len(fps)] = fps
    bits = np.unpackbits(held.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(sliced: np.ndarray, query: np.ndarray, n: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query index, lane) at radius or fewer differing bits; sliced: planes of n fingerprints.

    The counters add one bit plane of mismatches after another; a lane that passes 2 ** k - 1 > radius
    sets the overflow plane for good. Queries whose lanes have all overflowed are dropped.
    """
    depth = max(1, int(radius).bit_length())
    live = np.arange(len(query))
    words = sliced.shape[1]
    counters = np.zeros((depth, len(query), words), np.uint64)
    over = np.zeros((len(query), words), np.uint64)
    tail = n % 64
    if tail:
        over[:, -1] = ~np.uint64((1 << tail) - 1)
    full = ~np.uint64(0)
    for bit in range(64):
        mine = (query[live] >> np.uint64(bit)) & np.uint64(1)
        carry = sliced[bit][None, :] ^ (np.uint64(0) - mine)[:, None]
        for k in range(depth):
            both = counters[k] & carry
            counters[k] ^= carry
            carry = both
        over |= carry
        if bit % 8 == 7:
            keep = (over != full).any(axis=1)
            if not keep.all():
                live, over, counters = live[keep], over[keep], counters[:, keep]
                if not len(live):
                    return np.empty(0, np.int64), np.empty(0, np.int64)
    # The counters hold each lane's distance, if it hasn't overflowed; keep those up to radius.
    good = np.zeros_like(over)
    for d in range(radius + 1):
        match = ~over
        for k in range(depth):
            match &= counters[k] if d >> k & 1 else ~counters[k]
        good |= match
    hit = np.unpackbits(good.view(np.uint8).reshape(len(live), -1), axis=1, bitorder="little")
    q, lane = np.nonzero(hit)
    return live[q], lane


def _stars(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links a-b among ids (sorted): each id of a connected group with the group's smallest."""
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    moved = np.nonzero(root != np.arange(len(ids)))[0]
    return ids[root[moved]], ids[moved]


def block_links(ids: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Star links that connect what fingerprints at radius or fewer differing bits connect."""
    order = np.argsort(ids)
    ids, fps = ids[order], fps[order].astype(np.int64).view(np.uint64)
    n = len(ids)
    if n == 2:
        near = int(fps[0] ^ fps[1]).bit_count() <= radius
        return (ids[:1], ids[1:]) if near else (ids[:0], ids[:0])
    sliced, found = planes(fps), []
    for at in range(0, n, 256):
        q, lane = within(sliced, fps[at : at + 256], n, radius)
        later = lane > q + at
        found.append((q[later] + at, lane[later]))
    a, b = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    return _stars(ids, a, b) if len(a) else (ids[:0], ids[:0])


def _bands(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 2 bands of the 64 bits."""
    n = radius + 2
    edges = [64 * k // n for k in range(n + 1)]
    return [(edges[k], edges[k + 1] - edges[k]) for k in range(n)]


def _dealt(keyed: DataFrame, name: str) -> DataFrame:
    """Rows of blocks (key, parts): a block of several parts is met part by part, each going to every pair that it is in."""
    part = F.pmod(F.xxhash64(F.lit(SEED), name), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(part, o).alias("p"), F.greatest(part, o).alias("q")))
    return keyed.withColumn("m", F.explode(others)).withColumn("key", F.xxhash64("key", "m.p", "m.q")).drop("m", "parts")


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: links that connect the fps (rep, fp) that links connect."""
    spark = distinct.sparkSession
    bands = _bands(radius)
    keys = []
    for i in range(len(bands)):
        for j in range(i + 1, len(bands)):
            (s, w), (t, v) = bands[i], bands[j]
            mask = ((1 << w) - 1 << s) | ((1 << v) - 1 << t)
            keys.append(F.xxhash64(F.lit(len(keys)), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    keyed = distinct.select("rep", "fp", F.explode(F.array(*keys)).alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = cut(counts.withColumn("parts", F.ceil(F.col("n") / block).cast("int")), "blocks")
    met = _dealt(join_checked(keyed, counts, "key", "inner"), "rep").select("rep", "fp", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by key: a block is compared when its key ends.
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush(keys, reps, fps):
            out_a, out_b = [], []
            edges = np.concatenate(([0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]))
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if y - x > 1:
                    a, b = block_links(reps[x:y], fps[x:y], radius)
                    if len(a):
                        out_a.append(a)
                        out_b.append(b)
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

        for batch in batches:
            held.append(tuple(np.asarray(batch.column(k)) for k in range(3)))
            keys, reps, fps = (np.concatenate([h[k] for h in held]) for k in range(3))
            done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if done:
                yield from flush(keys[:done], reps[:done], fps[:done])
            held = [(keys[done:], reps[done:], fps[done:])]
        if held:
            yield from flush(*(np.concatenate([h[k] for h in held]) for k in range(3)))

    sorted_ = met.repartition(partitions(spark), "key").sortWithinPartitions("key").select("key", "rep", "fp")
    return sorted_.mapInArrow(run, "a long, b long").distinct()


def groups(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text)."""
    known = cut(fingerprints(docs, shingle), "fingerprints")
    distinct = cut(known.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"), "distinct")
    joined = components(links(distinct, radius, block))
    named = cut(distinct.join(joined, distinct["rep"] == joined["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "named")
    return known.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: bytes | None, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = bytes(text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pairs = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(words) - shingle + 1))


def set_fingerprint(held: np.ndarray) -> int:
    """The fingerprint of a set of shingles, as a signed 64-bit value."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(held), 65536):
        ones += np.unpackbits(held[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(held), bitorder="little").view(np.int64)[0])


def band_keys(held: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of shingles; an empty set has keys of its own."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(held), 2048):  # so that a very long text needs no more memory
        np.minimum(least, ((held[at : at + 2048, None] ^ _XOR) * _ODD).min(axis=0), out=least)
    least = least.reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = (keys ^ least[:, k]) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys


def alike(sets: list[np.ndarray], threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices whose sets have a Jaccard likeness of at least threshold."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    used = np.cumsum(count > 1) - 1  # a shingle that one text has is in no intersection
    kept = count[column] > 1
    row, column = row[kept], used[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n, n), np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        x, y = np.searchsorted(column, (at, at + 2048))
        held = np.zeros((n, 2048), np.float32)
        held[row[x:y], column[x:y] - at] = 1
        shared += held @ held.T
    union = sizes[:, None] + sizes[None, :] - shared
    return np.nonzero(np.triu(shared >= threshold * union - 1e-9, 1))


def near(sets: list[np.ndarray], fps: np.ndarray, threshold: float = THRESHOLD, radius: int = NEAR_RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block: fingerprints within radius, compared bit-sliced, then verified by their sets."""
    n, fps = len(sets), fps.astype(np.int64).view(np.uint64)
    none = np.empty(0, np.int64)
    if n == 2:
        if int(fps[0] ^ fps[1]).bit_count() > radius:
            return none, none
        return alike(sets, threshold)
    sliced, close = planes(fps), np.zeros(n, bool)
    for at in range(0, n, 256):
        q, lane = within(sliced, fps[at : at + 256], n, radius)
        other = lane != q + at
        close[lane[other]] = True
    rows = np.nonzero(close)[0]
    if not len(rows):
        return none, none
    a, b = alike([sets[i] for i in rows.tolist()], threshold)
    return rows[a], rows[b]


def _tables(docs: DataFrame, make, shingle: int, keys: tuple[str, ...]) -> DataFrame:
    """keys, digest, fp and held = make(set) of docs (keys, _text), by their sets of shingles."""
    names = [*keys, "digest", "fp", "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_buffer() if x.is_valid else None, shingle) for x in batch.column(len(keys))]
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            fps = pa.array([set_fingerprint(s) for s in sets], pa.int64())
            lists = [make(s) for s in sets]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            values = np.concatenate(lists).view(np.int64) if lists else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keys))], digests, fps, pa.ListArray.from_arrays(ends, values)], names)

    schema = ", ".join(f"{k} long" for k in keys)
    return docs.select(*keys, F.col("_text").cast("binary").alias("_text")).mapInArrow(run, f"{schema}, digest binary, fp long, held array<long>")


def _near_links(met: DataFrame, threshold: float, radius: int) -> DataFrame:
    """(a, b) of met (key, node, fp, held), of which each key's rows are compared; of its links a key keeps stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by key: a key's texts are compared when it ends.
        last, nodes, fps, sets = None, [], [], []

        def flush():
            ids, at = np.unique(np.array(nodes, np.int64), return_inverse=True)
            a, b = near(sets, np.array(fps, np.int64), threshold, radius)
            a, b = _stars(ids, at[a], at[b]) if len(a) else (ids[:0], ids[:0])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held = batch.column(3)
            ends, values = held.offsets.to_numpy(), held.values.to_numpy().view(np.uint64)
            for k, (key, node, fp) in enumerate(zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True)):
                if key != last:
                    if len(sets) > 1:
                        yield flush()
                    last, nodes, fps, sets = key, [], [], []
                nodes.append(node)
                fps.append(fp)
                sets.append(values[ends[k] : ends[k + 1]].copy())
        if len(sets) > 1:
            yield flush()

    return met.mapInArrow(run, "a long, b long").distinct()


def representatives(docs: DataFrame, *, shingle: int = NEAR_SHINGLE, threshold: float = THRESHOLD, radius: int = NEAR_RADIUS, block: int = NEAR_BLOCK) -> DataFrame:
    """One row of docs (doc_id, text, any more columns) for each group of near duplicates, as it is.

    Texts link if their sets of word shingles have a Jaccard likeness of at least threshold; a group is what links
    connect. Of a group the row with the smallest doc_id stays, one without a doc_id only if all are; ties, as rows of one
    doc_id with different texts, go to the smaller hash of the row, and of rows that are the same in every column one stays.
    Texts without words (null, empty, blank) are near duplicates of each other. Texts with equal sets are compared as one.
    """
    spark = docs.sparkSession
    columns = docs.columns
    told = [F.col(f"`{c}`").cast("string") for c in columns if c != "doc_id"]
    marked = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_uid": F.xxhash64(F.col("doc_id").isNull(), *told)})
    rows = marked.select("_id", "_uid", F.col("doc_id").isNull().cast("long").alias("_null"), F.col("text").alias("_text"))
    known = _tables(rows, band_keys, shingle, ("_id", "_uid", "_null"))
    distinct = known.groupBy("digest").agg(F.min(F.struct("_null", "_id", "_uid")).alias("first"), F.first("fp").alias("fp"), F.first("held").alias("keys"))
    distinct = cut(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")  # written, so that the numbers stay
    keyed = distinct.select("digest", "node", F.explode("keys").alias("key"))
    n = F.count(F.lit(1)).alias("n")
    counts = keyed.groupBy("key").agg(n, *[F.bit_xor(F.xxhash64(F.lit(k), "digest")).alias(f"mark{k}") for k in (0, 1)]).where("n > 1")
    counts = counts.groupBy("n", "mark0", "mark1").agg(F.min("key").alias("key"))  # keys with the same texts are met once
    counts = cut(counts.select("key", F.ceil(F.col("n") / block).cast("int").alias("parts")), "blocks")
    dealt = cut(join_checked(keyed, counts, "key", "inner"), "dealt")

    # Only texts that share a key are read again for their shingles, one text for each distinct set.
    needed = dealt.select("node").distinct().join(distinct.select("node", "first._id", "first._uid"), "node")
    needed = cut(needed.select("node", F.col("_id").alias("_i"), F.col("_uid").alias("_u")), "needed")
    texts = join_checked(rows, needed, (F.col("_id") == F.col("_i")) & (F.col("_uid") == F.col("_u")), "inner")
    sets = _tables(texts.select("node", "_text"), lambda s: s, shingle, ("node",))
    sets = cut(sets.dropDuplicates(["node"]).select("node", "fp", "held"), "sets")
    met = _dealt(dealt, "digest").select("key", "node").join(sets, "node").select("key", "node", "fp", "held")
    met = met.repartition(partitions(spark), "key").sortWithinPartitions("key")
    joined = components(_near_links(met, threshold, radius)).withColumnRenamed("node", "of")
    kept = distinct.join(joined, F.col("node") == F.col("of"), "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("first").alias("f"))
    kept = cut(kept.select(F.col("f._id").alias("_i"), F.col("f._uid").alias("_u")), "kept")
    held = join_checked(marked, kept, (F.col("_id") == F.col("_i")) & (F.col("_uid") == F.col("_u")), "left_semi")
    return held.dropDuplicates(["_id", "_uid"]).select(*[f"`{c}`" for c in columns])
