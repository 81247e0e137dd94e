"""Document fingerprints of closed syncmers, matched by position.

A k-mer of a text's UTF-8 bytes is a closed syncmer if the least of the s-mers within it, by hash, is its
first or its last. Whether it is depends on the k-mer alone, so texts that share a stretch share
its syncmers, whatever stands around it: they are anchors. A fingerprint keeps, of the anchors whose hashes fall into each of
128 bins, the one of the least hash: a byte of the hash (01 to ff; 00: none fell there) and, in the second half of the fingerprint, a byte
for its place, in 256ths of the text. Two fingerprints are matched by position: of the bins with equal bytes those
count that lie in the same order in both texts, their longest chain; likeness is its share of the bins that either fills. So it
estimates the Jaccard index of the anchors for texts that run alike, and is less where passages are in another order.

Few anchors tell little, so a text of fewer than SHORT code points has a second half: the same of its short anchors, all k-mers of SHORT_K bytes
of the text with SHORT_K - 1 zero bytes put before it, which are as many as it has bytes (closed syncmers, as their only s-mers are the first and the last). Two texts that
both have it are matched by it, any others by the first half, which every text has. An edit that keeps two thirds
of a text's code points so never changes from one kind of anchors to the other without the old one.

Defined results: an empty or null text has the fingerprint of zeros, like another such by 1 and any other
text by 0; a text without a closed syncmer counts, in the first half, as one k-mer as a whole; an empty table gives an empty result; other columns are ignored. For neighbours() see there.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm._repeats import Hashed, byte_symbols, mix
from tamarack.llm._shared import partitions, text_bytes

K, S = 12, 4
#: Code points below which a text has short anchors, too, and the lengths of their k-mers and s-mers.
SHORT, SHORT_K, SHORT_S = 300, 5, 4
BINS = 128
#: Bytes that are fingerprinted together.
CHUNK = 1 << 20
#: Bytes of text in a range of doc_ids, and the most ranges (larger ranges then spill as they are sorted).
RANGE_BYTES = 16 << 20
MOST_RANGES = 20_000


def syncmers(data: np.ndarray, bounds: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the closed syncmers of texts bounds[i]:bounds[i + 1] of data; place within the text."""
    none = np.empty(0, np.int64)
    if len(data) < k:
        return none, none, none.astype(np.uint64)
    h = Hashed(byte_symbols(data))
    small = h.rolling(s)
    low, width, span = small, k - s + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    edge = (low == small[: len(low)]) | (low == small[k - s : k - s + len(low)])
    at = np.nonzero(edge)[0]
    text = np.searchsorted(bounds, at, "right") - 1
    good = at + k <= bounds[text + 1]
    at, text = at[good], text[good]
    return text, at - bounds[text], h.of(at, at + k)


def _is_short(text: bytes) -> bool:
    return 0 < len(text) < 4 * SHORT and len(text.decode("utf-8", "replace")) < SHORT


def sketches(texts: list[bytes]) -> np.ndarray:
    """A row of 512 bytes for each text: 128 of hashes and 128 of places of its anchors, then the same of the short ones, zeros if it has none."""
    out = np.zeros((len(texts), 4 * BINS), np.uint8)
    filled = [i for i, t in enumerate(texts) if t]
    short = [i for i in filled if _is_short(texts[i])]
    out[filled, : 2 * BINS] = _half([texts[i] for i in filled], K, S)
    out[short, 2 * BINS :] = _half([bytes(SHORT_K - 1) + texts[i] for i in short], SHORT_K, SHORT_S)
    return out


def _half(texts: list[bytes], k: int, s: int) -> np.ndarray:
    out = np.zeros((len(texts), 2 * BINS), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = 0
    while first < len(texts):
        last = first + 1
        total = sizes[first]
        while last < len(texts) and total + sizes[last] <= CHUNK:
            total += sizes[last]
            last += 1
        own = sizes[first:last]
        text, place, hashes = _chunk(texts[first:last], own, k, s)
        least = np.full(len(own) * BINS, ~np.uint64(0), np.uint64)
        packed = hashes >> np.uint64(16) << np.uint64(8) | (place * 256 // own[text]).astype(np.uint64)
        np.minimum.at(least, text * BINS + (hashes & np.uint64(BINS - 1)).astype(np.int64), packed)
        held = least != ~np.uint64(0)
        told = np.where(held, mix(least >> np.uint64(8)) % np.uint64(255) + np.uint64(1), np.uint64(0))
        out[first:last, :BINS] = told.astype(np.uint8).reshape(-1, BINS)
        out[first:last, BINS:] = np.where(held, least & np.uint64(255), np.uint64(0)).astype(np.uint8).reshape(-1, BINS)
        first = last
    return out


def printed(sketch: np.ndarray) -> str:
    """A fingerprint as hex digits: 512, or 1024 of a text that has short anchors."""
    return (sketch if sketch[2 * BINS :].any() else sketch[: 2 * BINS]).tobytes().hex()


def _chunk(group: list[bytes], sizes: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the anchors of texts."""
    if len(group) == 1 and sizes[0] > CHUNK:  # a very long text, in overlapping pieces
        data, held = np.frombuffer(group[0], np.uint8), []
        for at in range(0, len(data) - k + 1, CHUNK):
            piece = data[at : at + CHUNK + k - 1]
            _, place, hashes = syncmers(piece, np.array([0, len(piece)]), k, s)
            held.append((place + at, hashes))
        places, hashes = (np.concatenate([h[i] for h in held]) for i in range(2))
        return np.zeros(len(hashes), np.int64), places, hashes
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    text, places, hashes = syncmers(np.frombuffer(b"".join(group), np.uint8), bounds, k, s)
    lacking = np.ones(len(group), bool)
    lacking[text] = False
    if lacking.any():  # very short texts, mostly
        alone = np.nonzero(lacking)[0]
        whole = [int.from_bytes(hashlib.blake2b(group[i], digest_size=8).digest(), "little") for i in alone.tolist()]
        text, places = np.concatenate((text, alone)), np.concatenate((places, np.zeros(len(alone), np.int64)))
        hashes = np.concatenate((hashes, np.array(whole, np.uint64)))
    return text, places, hashes


def _chain(places: list[int]) -> int:
    """Length of the longest subsequence that doesn't fall."""
    ends: list[int] = []
    for x in places:
        at = bisect_right(ends, x)
        ends[at : at + 1] = [x]
    return len(ends)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two sketches, row by row: by their short anchors where both have such, else by the others."""
    short = (a[:, 2 * BINS :].any(axis=1) & b[:, 2 * BINS :].any(axis=1))[:, None]
    return _matched(*(np.where(short, x[:, 2 * BINS :], x[:, : 2 * BINS]) for x in (a, b)))


def _matched(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the bins in the longest chain of equal ones among those that are filled, row by row; 1 where none is filled on either side."""
    hashes_a, hashes_b = a[:, :BINS], b[:, :BINS]
    n = ((hashes_a != 0) | (hashes_b != 0)).sum(axis=1)
    equal = (hashes_a == hashes_b) & (hashes_a != 0)
    count = equal.sum(axis=1)
    keys = np.where(equal, a[:, BINS:].astype(np.int32) << 8 | b[:, BINS:], 1 << 16)
    keys.sort(axis=1)
    theirs = np.where(keys < 1 << 16, keys & 255, 256)
    for row in np.nonzero((np.diff(theirs, axis=1) < 0).any(axis=1))[0].tolist():
        count[row] = _chain(theirs[row, : count[row]].tolist())
    return np.where(n > 0, count / np.maximum(n, 1), 1.0)


def edited(text: str, other: str) -> str:
    """text with its last third replaced by the start of other."""
    n = len(text)
    return text[: n - n // 3] + other[: n // 3]


def _step(value, cuts: list[int]) -> F.Column:
    """How many of the sorted cuts are at most value: first among every so manieth of them, then within one stretch."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    stretches = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    listed = lambda values: F.expr(f"array({', '.join(f'{c}L' for c in values)})")
    within = F.expr("array(" + ", ".join(f"array({', '.join(f'{c}L' for c in s)})" for s in stretches) + ")")
    upto = F.size(F.filter(listed([s[0] for s in stretches]), lambda c: c <= value))
    return F.when(upto == 0, 0).otherwise((upto - 1) * width + F.size(F.filter(F.get(within, upto - 1), lambda c: c <= value)))


def neighbours(docs: DataFrame) -> DataFrame:
    """Each document beside the next by descending doc_id (after the last the first), and beside its edited text.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null doc_ids come
    last, rows of one doc_id in the order of their texts' hash. Documents are dealt by ranges of doc_id; a range also
    gets the first document of the range that comes after it.
    """
    spark = docs.sparkSession
    n_ranges = int(min(MOST_RANGES, max(1, text_bytes(docs) // RANGE_BYTES, 1)))
    shares = [i / n_ranges for i in range(1, n_ranges)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 10 * n_ranges).alias("c")).first()["c"] if shares else []
    cuts = sorted({int(c) for c in cuts or []})
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))

    # Of the ranges, the documents without an id come before all, that is after them in descending order, by their ties.
    nulls = -1 - F.floor((F.col("tie") / F.lit(float(1 << 63)) + 1) / 2 * n_ranges).cast("int")
    place = F.when(F.col("doc_id").isNull(), nulls).otherwise(_step(F.col("doc_id"), cuts))
    own = frame.select(place.cast("int").alias("range"), F.lit(0).alias("ahead"), "doc_id", "text", "tie")
    heads = own.groupBy("range").agg(F.min(F.struct((-F.col("doc_id")).alias("a"), "tie")).alias("head")).orderBy("range").collect()  # a row for each range
    if heads:
        follows = [(*heads[i]["head"], heads[(i + 1) % len(heads)]["range"]) for i in range(len(heads))]
        table = spark.createDataFrame(follows, "_a long, _tie long, range int")
        same = (-F.col("doc_id")).eqNullSafe(F.col("_a")) & (F.col("tie") == F.col("_tie"))
        ahead = frame.join(F.broadcast(table), same).select("range", F.lit(1).alias("ahead"), "doc_id", "text", "tie")
        own = own.unionByName(ahead)
    order = ["range", "ahead", F.col("doc_id").desc_nulls_last(), "tie"]
    dealt = own.repartition(max(partitions(spark), 1), "range").sortWithinPartitions(*order)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def settle(ids: list, texts: list[str], following: list[int], owns: int) -> pa.RecordBatch:
        new = [edited(texts[i], texts[j]) for i, j in enumerate(following)]
        raw = [t.encode() for t in texts], [t.encode() for t in new]
        mine, theirs = sketches(raw[0]), sketches(raw[1])
        values = [
            pa.array(ids[:owns], pa.int64()),
            pa.array([len(t) for t in texts[:owns]], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in raw[1]]),
            pa.array([printed(m) for m in mine[:owns]]),
            pa.array([printed(m) for m in theirs]),
            pa.array(likeness(mine[:owns], theirs)),
            pa.array(likeness(mine[:owns], mine[following])),
        ]
        return pa.RecordBatch.from_arrays(values, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        at, done, size = None, True, 0
        for batch in batches:
            for place, ahead, doc, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if place != at:
                    ids, texts, at, done, size = [], [], place, False, 0
                if done:
                    continue
                ids.append(doc)
                texts.append(text)
                size += len(text)
                done = bool(ahead)
                if (done or size >= CHUNK) and len(texts) > 1:
                    n = len(texts) - 1
                    yield settle(ids, texts, list(range(1, n + 1)), n)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("range", "ahead", "doc_id", "text").mapInArrow(run, schema)
