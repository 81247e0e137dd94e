"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is contained in a document if at least `threshold` of its distinct five-word
shingles occur there. A document may lack at most n - ceil(threshold * n) of an item's n
shingles, so of any one more than that it holds at least one: an item's sketch is that many of
its smallest shingle hashes (a bottom-k MinHash whose k follows the item's size), and looking up
a document's shingles in all sketches misses nothing, however long the document is. Items are
partitioned by size; a document too short for a size class is not looked up in it. Candidates
are verified on the shingles' words themselves.

Words are runs of letters and digits, lower-cased. An item of fewer than five words has its
whole sequence as its one shingle, which is sought among documents' sequences of that length.

Defined results: null and wordless texts or items match nothing; repeated rows of documents give
one row for each doc_id and item, as do repeated items; a null doc_id or item_id is reported as
null; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm._shared import BROADCAST_ROWS, cut, join_checked, let

WORDS = 5
THRESHOLD = 0.8
#: Bits of the sieve for each sketch hash, where there are too many to broadcast, and in all.
SIEVE_BITS, MOST_BITS = 16, 1 << 28
TOKEN = r"[\p{L}\p{N}]+"


def _tokens(text) -> F.Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(0))


def _windows(tokens, n: int, make) -> F.Column:
    """make(words) of each n consecutive tokens; an empty array where there are fewer or none."""


    def over(held) -> F.Column:
        at = F.sequence(F.lit(0), F.size(held) - n)
        return F.when(F.size(held) >= n, F.transform(at, lambda i: make([F.get(held, i + k) for k in range(n)])))

    return let(tokens, over)


def _hashes(tokens, n: int) -> F.Column:
    return _windows(tokens, n, lambda words: F.xxhash64(F.lit(n), *words))


def _shingles(tokens, n: int) -> F.Column:
    return _windows(tokens, n, lambda words: F.concat_ws(" ", *words))


def _by_size(tokens, size, sizes: list[int], make) -> F.Column:
    """make(tokens, n) for the n that a row's size column has."""
    found = F.when(size == sizes[0], make(tokens, sizes[0]))
    for n in sizes[1:]:
        found = found.when(size == n, make(tokens, n))
    return found


def sketches(items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, size (words in a shingle), shingles, n_item, need, size_class and sketch of each item that has words."""
    tokens = F.col("_tokens")
    sizes = list(range(1, words + 1))
    return (
        items.select("item_id", _tokens("text").alias("_tokens"))
        .where(F.size("_tokens") > 0)
        .withColumn("size", F.least(F.lit(words), F.size(tokens)))
        .withColumn("shingles", F.array_distinct(_by_size(tokens, F.col("size"), sizes, _shingles)))
        .withColumn("hashes", F.array_sort(F.array_distinct(_by_size(tokens, F.col("size"), sizes, _hashes))))
        .withColumn("n_item", F.size("shingles"))
        .withColumn("need", F.ceil(F.lit(threshold) * F.col("n_item") - F.lit(1e-9)).cast("int"))
        .withColumn("size_class", F.floor(F.log2(F.col("n_item"))).cast("int"))
        .withColumn("sketch", F.slice("hashes", F.lit(1), F.col("n_item") - F.col("need") + 1))
        .drop("_tokens", "hashes")
    )


def _sieved(spread: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """Rows of spread whose hash may be one of the n in keys: a bit for each hash, SIEVE_BITS of them for each key, in bitmaps of 4 KB that are broadcast."""
    size = min(MOST_BITS, 1 << max(15, (SIEVE_BITS * n).bit_length()))
    at = F.pmod("hash", F.lit(size))
    bucket, place = F.floor(at / F.lit(1 << 15)).alias("_bucket"), (at % F.lit(1 << 15)).alias("_place")
    marks = keys.select(bucket, place).groupBy("_bucket").agg(F.bitmap_construct_agg("_place").alias("_bits"))  # MOST_BITS / 8 bytes at most
    byte = F.conv(F.hex(F.substr("_bits", F.floor(F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = spread.select("*", bucket, place).join(F.broadcast(marks), "_bucket")
    return held.where(F.getbit(byte, F.col("_place") % 8) == 1).drop("_bucket", "_place", "_bits")


def contained(docs: DataFrame, items: DataFrame, *, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) with containment of at least threshold."""
    known = cut(sketches(items, words, threshold), "sketches")
    classes = known.groupBy("size", "size_class").agg(F.min("need").alias("least")).orderBy("size", "size_class").collect()
    keys = known.select("item_id", "size", "size_class", F.explode("sketch").alias("hash"))
    keys = cut(keys.groupBy("hash", "item_id", "size_class").agg(F.min("size").alias("size")), "keys")
    sizes = sorted({r["size"] for r in classes}) or [words]  # at most `words` values
    least = {n: min([r["least"] for r in classes if r["size"] == n], default=0) for n in sizes}
    tokens = F.col("_tokens")
    arrays = [F.when(F.size(tokens) - n + 1 >= least[n], _hashes(tokens, n)) for n in sizes]
    looked = arrays[0] if len(arrays) == 1 else F.concat(*[F.coalesce(a, F.array().cast("array<bigint>")) for a in arrays])
    spread = (
        docs.select("doc_id", _tokens("text").alias("_tokens"))
        .select("doc_id", F.size(tokens).alias("held"), looked.alias("_hashes"))
        .select("doc_id", "held", F.explode("_hashes").alias("hash"))
    )
    # A class whose items all need more shingles than the document has is passed over.
    floor = F.lit(0)
    for row in classes:
        floor = F.when((F.col("size") == row["size"]) & (F.col("size_class") == row["size_class"]), F.lit(row["least"])).otherwise(floor)
    n_keys = keys.count()
    if n_keys > BROADCAST_ROWS:  # the join will shuffle: only what may match goes into it
        spread = _sieved(spread, keys, n_keys)
    hits = join_checked(spread, keys, "hash", "inner", BROADCAST_ROWS).where(F.col("held") - F.col("size") + 1 >= floor)
    pairs = cut(hits.groupBy("doc_id", "item_id").agg(F.max("size").alias("size")), "pairs")
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    joined = join_checked(texts, pairs, F.col("_doc").eqNullSafe(F.col("doc_id")), "inner").drop("_doc", "size")
    whole = known.drop("sketch", "size_class").withColumnRenamed("item_id", "_item")
    chars = F.aggregate("shingles", F.lit(0), lambda n, x: n + F.length(x) * 2 + 16)
    joined = join_checked(joined, whole, F.col("item_id").eqNullSafe(F.col("_item")), "inner", size=chars)
    found = F.coalesce(_by_size(tokens, F.col("size"), sizes, _shingles), F.array().cast("array<string>"))
    shared = F.size(F.array_intersect(F.col("shingles"), found)).alias("n_shared")
    return (
        joined.withColumn("_tokens", _tokens("_text"))
        .select("doc_id", "item_id", "n_item", "need", shared)
        .where(F.col("n_shared") >= F.col("need"))
        .groupBy("doc_id", "item_id")
        .agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
    )
