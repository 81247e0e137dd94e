"""Filter interaction audit: what each filter removes in every order in which the filters may stand.

Five filters fail or keep a document; its failures are five bits. In a given order a document
is removed at the first step whose filter it fails. FIRST, built once, holds that step for each of the
32 sets of failures and 120 orders. Each Arrow batch looks its documents' rows of FIRST up and
counts, with np.bincount, removals by part, order, step and label; each task gives the sums of its batches,
one array for each of its parts, and Spark sums these arrays. All other figures follow from them.

Filters (fixed): A under 200 words; B fewer than half of the words distinct; C more than 2% of the code points A-Z;
D any of #$%&*|; E the text of a smaller doc_id's document, in the whole table. For E documents are grouped by SHA-256 and
length, copies pre-aggregated before the shuffle: as the other four filters read the text alone, copies fail them alike, and
a group's row holds counts by part and label.

Defined results: a null text is empty, a null source the part ''; a document has a label if any of the rows of its doc_id
in labels has. A null doc_id has no label, and is smaller than none, nor is any smaller than it: it neither fails E nor makes others fail; rows that share a doc_id
are no copies of each other. Repeated rows count each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm._shared import WORD, let

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: FIRST[failures, order]: the step, from 1, whose filter is the first that fails; 0 if none does.
FIRST = np.array([[next((s for s, f in enumerate(o, 1) if failures >> FILTERS.index(f) & 1), 0) for o in ORDERS] for failures in range(1 << STEPS)], np.int64)
#: Labels: neither, good, toxic, both.
LABELS = 4
#: Rows of a batch that are looked up together.
BATCH = 2048
#: Parts whose sums a task holds at a time.
MOST_PARTS = 512
_REMOVED = len(ORDERS) * (STEPS + 1) * LABELS


def failures(text) -> F.Column:
    """Bits of the filters A to D that a text, not null, fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    counts = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("own")))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))

    def bits(c) -> F.Column:
        fails = (c["n"] < 200, 100 * c["own"].cast("long") < 50 * c["n"].cast("long"), 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), text.rlike("[#$%&*|]"))
        found = F.lit(0)
        for k, f in enumerate(fails):
            found = found + F.when(f, F.lit(1 << k)).otherwise(0)
        return found

    return let(counts, bits).cast("int")


def _key(doc_id, content) -> F.Column:
    """A doc_id as text; null ids, which no label has, go by what their documents hold, so that they don't meet in one task."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("-:"), content))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failures (of all five filters), label and n: so many documents of the part are alike in these. Several rows may tell of the same.

    docs: doc_id, text, source. labels: doc_id, quality, toxic.
    """
    text = F.coalesce("text", F.lit(""))
    content = F.concat(F.sha2(text, 256), F.lit(":"), F.octet_length(text))
    facts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), failures(text).alias("failures"), content.alias("content"))
    label = F.max(F.when(F.col("quality") == 1, 1).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, 2).otherwise(0))
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("key")).agg(label.alias("label")).where("label > 0")
    held = facts.withColumn("key", _key(F.col("doc_id"), F.col("content"))).join(told, "key", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    # By document first: the join has put a doc_id's rows together already. Then copies, by part and label.
    rows = held.groupBy("key", "doc_id", "content", "part", "label").agg(F.first("failures").alias("failures"), F.count("*").alias("n"))
    unnumbered = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    alike = rows.groupBy("content", "part", "label").agg(F.first("failures").alias("failures"), F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"), unnumbered.alias("unnumbered"))
    least = F.min("first").over(Window.partitionBy("content"))
    firsts = F.col("unnumbered") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    split = F.array(
        F.struct("failures", F.col("firsts").alias("n")),
        F.struct((F.col("failures") + (1 << FILTERS.index("E"))).alias("failures"), (F.col("n") - F.col("firsts")).alias("n")),
    )
    each = alike.withColumn("least", least).withColumn("firsts", firsts).select("part", "label", F.explode(F.filter(split, lambda x: x["n"] > 0)).alias("x"))
    return each.select("part", "x.failures", "label", "x.n")


def _counted(part: np.ndarray, failed: np.ndarray, label: np.ndarray, n: np.ndarray, parts: int) -> np.ndarray:
    """[part, _REMOVED + 32]: documents by order, first failing step and label; then by the set of failures."""
    out = np.zeros((parts, _REMOVED + len(FIRST)), np.int64)
    place = ((part[:, None] * len(ORDERS) + np.arange(len(ORDERS))) * (STEPS + 1) + FIRST[failed]) * LABELS + label[:, None]
    out[:, :_REMOVED] = np.rint(np.bincount(place.reshape(-1), np.repeat(n, len(ORDERS)), parts * _REMOVED)).reshape(parts, _REMOVED)
    out[:, _REMOVED:] = np.rint(np.bincount(part * len(FIRST) + failed, n, parts * len(FIRST))).reshape(parts, -1)
    return out


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, failures, label, n to an array of sums for each part, or a few where a task has very many parts."""
    sums: dict[str, np.ndarray] = {}

    def told() -> pa.RecordBatch:
        values = np.concatenate([*sums.values()]) if sums else np.empty(0, np.int64)
        edges = np.arange(len(sums) + 1) * (_REMOVED + len(FIRST))
        out = pa.RecordBatch.from_arrays([pa.array([*sums], pa.string()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values))], ["part", "sums"])
        sums.clear()
        return out

    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            parts = batch.column("part").dictionary_encode()
            part, failed, label, n = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (parts.indices, batch.column("failures"), batch.column("label"), batch.column("n")))
            for name, row in zip(parts.dictionary.to_pylist(), _counted(part, failed, label, n, len(parts.dictionary)), strict=True):
                sums[name] = sums[name] + row if name in sums else row
            if len(sums) >= MOST_PARTS:
                yield told()
    yield told()


_TOLD = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part and its sums to a row for each order and step."""
    order = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])  # [order, step]: the filter there
    sets = np.arange(len(FIRST))
    for batch in batches:
        for i in range(batch.num_rows):
            sums = batch.column("sums")[i].values.to_numpy()
            by_label = sums[:_REMOVED].reshape(len(ORDERS), STEPS + 1, LABELS)
            fails = np.array([sums[_REMOVED:][(sets >> f & 1) == 1].sum() for f in range(STEPS)])
            removed = by_label[:, 1:].sum(axis=2)
            shapley = np.array([removed[order == f].sum() for f in range(STEPS)])
            values = (
                sums[_REMOVED:].sum() - removed.cumsum(axis=1), removed, fails[order] - removed, sums[_REMOVED + (1 << order)],
                by_label[:, 1:, [1, 3]].sum(axis=2), by_label[:, 1:, [2, 3]].sum(axis=2), shapley[order],
            )
            names = [np.repeat([batch.column("part")[i].as_py()], len(ORDERS) * STEPS), np.repeat(ORDERS, STEPS), np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in names] + [pa.array(v.reshape(-1)) for v in values], ["part", "filter_order", "step", *_TOLD])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters (filter_order) and step: documents that are

    kept after the step, removed there, redundant (failing its filter, but removed earlier), unique_fails (failing no other filter),
    good_lost and toxic_lost (removed there, with that label); shapley: removed by its filter, over all orders.
    """
    partial = judged(docs, labels).mapInArrow(_partial, "part string, sums array<bigint>")
    summed = partial.select("part", F.posexplode("sums").alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias("n"))
    whole = summed.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("sums"))
    return whole.mapInArrow(_reported, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _TOLD))
