"""Mixing sources to target weights by capped water-filling.

Every source is given weight * level words, but never more than max_epochs times what it
holds; the level is raised, and the excess so shared again by weight, until no source is above
its cap. A source's documents are then taken a whole number of times, and a seeded sample of
them once more for the fraction that is left; the last document of that sample is taken in part. The sample
goes by a hash of the seed and the doc_id, or of the text's hash where there is none.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own that
comes last; repeated rows count as often as they occur, and each is taken by itself; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm._shared import cut, join_checked, partitions, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 20240117
#: Documents of a source that are put in order together when its sample is drawn.
BUCKET_DOCS = 5000


def _ranked(sources: DataFrame) -> DataFrame:
    """Add sid: 0, 1, 2 ... by source in code point order, null last, without one task for all.

    Rows are dealt by ranges and numbered within each; a range's first number comes from the
    ranges' counts, of which there are as many as partitions.
    """
    spark = sources.sparkSession
    dealt = cut(
        sources.repartitionByRange(min(partitions(spark), 64), F.col("source").asc_nulls_last()).withColumn("pid", F.spark_partition_id()),
        "sources",
    )
    first, before = {}, 0
    for row in dealt.groupBy("pid").count().orderBy("pid").collect():
        first[row["pid"]] = before
        before += row["count"]
    if not first:
        return dealt.drop("pid").withColumn("sid", F.lit(0).cast("long"))
    starts = F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col("pid"))
    within = Window.partitionBy("pid").orderBy(F.col("source").asc_nulls_last())
    return dealt.withColumn("sid", (starts + F.row_number().over(within) - 1).cast("long")).drop("pid")


def water_level(sources: DataFrame, total: float) -> float | None:
    """Words for each unit of weight such that the clamped targets add up to total; None if all are clamped.

    sources has weight and cap. Each round clamps what is above its cap and shares out the rest;
    only three numbers come to the driver.
    """
    level, clamped = 0.0, -1
    while True:
        over = F.col("cap") <= F.col("weight") * F.lit(level)
        row = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("open"),
            F.coalesce(F.sum(F.when(over, 1)), F.lit(0)).alias("n"),
        ).first()
        if row["open"] == 0:
            return None
        if row["n"] == clamped:
            return level
        level, clamped = (total - row["held"]) / row["open"], row["n"]


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: int = SEED,
    bucket_docs: int = BUCKET_DOCS,
) -> DataFrame:
    """Plan the mix of docs (doc_id, text, source): one row per input row.

    Columns: doc_id, source, size, weight, source_size, target, whole (times taken as a whole),
    part (words of one more, partial or whole, repetition) and taken (whole * size + part).
    """
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))  # spreads what has no doc_id over the seeded order
    sized = cut(docs.select("doc_id", "source", word_count("text").alias("size"), tie.alias("tie")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = _ranked(sources)
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("sid") % len(weights) + 1).cast("int")))
    ranked = cut(ranked.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size")), "ranked")
    total = ranked.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level = water_level(ranked, float(share) * total)
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    held = F.greatest(F.col("source_size"), F.lit(1))
    planned = cut(
        ranked.withColumn("target", target.cast("double"))
        .withColumn("whole", F.floor(F.col("target") / held).cast("long"))
        .withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
        .withColumn("buckets", F.ceil(F.col("n") / F.lit(bucket_docs)).cast("long"))
        .withColumnRenamed("source", "of"),
        "planned",
    )
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("tie").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    dealt = join_checked(sized, planned, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "weight", "source_size", "target", "whole", "rest", "sid", order.alias("order"), "buckets"
    )
    dealt = cut(dealt.withColumn("bucket", F.floor(F.col("order") / F.lit(float(1 << 60)) * F.col("buckets"))).drop("buckets"), "dealt")
    # A bucket holds consecutive places of the seeded order, so sums of earlier buckets give where it starts.
    sums = dealt.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sums.select("sid", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start")), "starts")
    within = Window.partitionBy("sid", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before)).cast("long")
    return (
        join_checked(dealt, starts, ["sid", "bucket"])
        .withColumn("part", part)
        .select(
            "doc_id", "source", "size", "weight", "source_size", "target", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken")
        )
    )


def repeated(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mixed texts: a row for each repetition of a document, with words = how many of its words it gives.

    plan is what mix returned for docs, with one row per doc_id, which may be null; a document that isn't taken has no row.
    A column of docs that is called words gives way to the count.
    """
    times = F.concat(F.array_repeat(F.col("size"), F.col("whole").cast("int")), F.when(F.col("part") > 0, F.array(F.col("part"))).otherwise(F.array()))
    taken = plan.select(F.col("doc_id").alias("_doc"), F.filter(times, lambda x: x > 0).alias("_repeats"))
    kept = [f"`{c}`" for c in docs.columns if c != "words"]
    return docs.join(taken, F.col("doc_id").eqNullSafe(F.col("_doc"))).select(*kept, F.explode("_repeats").alias("words"))
