"""What is wrong with a ranked table and its breakdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("candidate_id", "rank", "score", "reasoning")


def _typed(ranked: DataFrame, *keep: str) -> DataFrame:
    kind = lambda c, t: F.col(c).cast("string").try_cast(t)
    score = kind("score", "double")
    reason = F.coalesce(F.trim(F.col("reasoning").cast("string")), F.lit(""))
    return ranked.select(*keep, "candidate_id", kind("rank", "int").alias("rank"), F.when(~F.isnan(score), score).alias("score"), F.length(reason).alias("reason"))


def with_previous(df: DataFrame, value: str, order: str, tie: str, by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """df with `before`: the value of the row before it by order and then tie, of rows that are alike in the by columns.

    Rows are windowed by ranges of order, cut at quantiles, so that no task sorts the whole table; each range's first row gets the
    last value of the range before it. Only the cuts come to the driver.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10_000).alias("c")).first()["c"] if n > 1 else None
    cuts = sorted({float(c) for c in cuts or []})
    listed = F.expr(f"array({', '.join(f'{c!r}D' for c in cuts)})") if cuts else F.expr("cast(array() AS array<double>)")
    placed = df.withColumn("_range", F.size(F.filter(listed, lambda c: c <= F.col(order))))
    within = Window.partitionBy(*by, "_range").orderBy(F.col(order).asc_nulls_first(), tie)
    own = placed.withColumn("_lag", F.lag(F.struct(value)).over(within))
    place = F.struct(order, tie)
    last = placed.groupBy(*by, "_range").agg(F.max_by(F.struct(value), place).alias("_last"))  # a row for each range and value of by
    carried = last.select(*by, "_range", F.lag("_last").over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_range")).alias("_carried"))
    on = own["_range"] == carried["_range"]
    for c in by:
        on = on & own[c].eqNullSafe(carried[c])
    joined = own.join(carried, on, "left").select(*[own[c] for c in df.columns], F.coalesce(own["_lag"], carried["_carried"])[value].alias("before"))
    return joined


def checks(ranked: DataFrame, *, least_reasoning: int = 40, by: str | None = None) -> DataFrame:
    """Counts of what a ranked table may have wrong, in one row, or one for each value of a column.

    rises: rows whose score is above that of the row before by rank, whatever ranks are missing between them; rows without a rank come first.
    """
    keep = [by] if by else []
    joined = with_previous(_typed(ranked, *keep), "score", "rank", "candidate_id", tuple(keep))
    n = F.count(F.lit(1))
    head = F.when(F.col("rank") <= 10, F.col("score"))
    found = joined.groupBy(*keep).agg(
        n.alias("n"),
        (n - F.countDistinct("candidate_id")).alias("duplicates"),
        F.coalesce((F.min("rank") == 1) & (F.max("rank") == n) & (F.countDistinct("rank") == n), F.lit(False)).alias("continuous"),
        F.count_if(F.col("score").isNull() | (F.col("score") < 0) | (F.col("score") > 1)).alias("bad_scores"),
        F.count_if(F.col("score") > F.col("before")).alias("rises"),
        F.countDistinct("score").alias("scores"),
        F.count_if(F.col("reason") == 0).alias("no_reasoning"),
        F.count_if(F.col("reason") < least_reasoning).alias("short_reasoning"),
        F.round(F.avg("reason"), 2).alias("mean_reasoning"),
        F.round(F.max(head) - F.min(head), 6).alias("top10_range"),
    )
    return found


def risk_checks(breakdown: DataFrame, head: int = 10) -> DataFrame:
    """One row of counts over a breakdown: bad scores, disqualified rows, and severe or empty profiles in the head."""
    num = lambda c: F.col(c).cast("string").try_cast("double")
    bad = lambda c: F.count_if(num(c).isNull() | F.isnan(num(c)) | (num(c) < 0) | (num(c) > 1)) if c in breakdown.columns else F.lit(0)
    first = F.coalesce(F.col("rank").cast("string").try_cast("int"), F.lit(0)) <= head
    flags = F.coalesce(F.col("risk_flags").cast("string"), F.lit(""))
    return breakdown.agg(
        bad("risk_adjusted_score").alias("bad_risk_scores"),
        bad("calibrated_final_score").alias("bad_calibrated_scores"),
        F.count_if(F.lower(F.col("disqualified").cast("string")) == "true").alias("disqualified"),
        F.count_if(flags.rlike(r"[\r\n]")).alias("broken_flags"),
        F.count_if(first & (F.lower("risk_level") == "severe")).alias("severe_head"),
        F.count_if(first & F.contains(flags, F.lit("empty_profile_text"))).alias("empty_head"),
    )


def validate(ranked: DataFrame, top_k: int, *, breakdown: DataFrame | None = None, calibrated: bool = False) -> list[str]:
    """What makes a ranked table invalid, its breakdown included if given; an empty list if nothing does."""
    missing = [c for c in COLUMNS if c not in ranked.columns]
    if missing:
        return [f"missing columns: {', '.join(missing)}"]
    row = checks(ranked).first()
    found = {
        f"{row['n']} rows instead of {top_k}": row["n"] != top_k,
        "duplicate ids": row["duplicates"] > 0,
        "ranks aren't 1 to n": row["n"] > 0 and not row["continuous"],
        "scores out of range": row["bad_scores"] > 0,
        "scores rise with rank": row["rises"] > 0,
        "reasoning is missing": row["no_reasoning"] > 0,
    }
    if breakdown is not None:
        risk = risk_checks(breakdown).first()
        found |= {
            "risk-adjusted scores out of range": risk["bad_risk_scores"] > 0,
            "calibrated scores out of range": calibrated and risk["bad_calibrated_scores"] > 0,
            "a disqualified row is ranked": risk["disqualified"] > 0,
            "risk flags can't be parsed": risk["broken_flags"] > 0,
            "a severe risk is in the first ten": risk["severe_head"] > 0,
        }
    return [what for what, wrong in found.items() if wrong]


def safety(ranked: DataFrame, breakdown: DataFrame, *, rows: int, least_reasoning: int = 40, most_severe: int = 0, flat: float = 0.02, files: tuple[str, ...] = ()) -> dict:
    """Whether a ranking is fit to hand out: blocking errors, warnings, and the figures they come from.

    files: names of outputs that are expected and missing.
    """
    blocking = [f"{c} is missing" for c in COLUMNS if c not in ranked.columns]
    if blocking:
        return {"passed": False, "blocking_errors": blocking, "warnings": [], "figures": {}}
    row, risk = checks(ranked, least_reasoning=least_reasoning).first(), risk_checks(breakdown).first()
    blocking = {
        "columns aren't just candidate_id, rank, score, reasoning": tuple(ranked.columns) != COLUMNS,
        f"{row['n']} rows instead of {rows}": row["n"] != rows,
        "duplicate ids": row["duplicates"] > 0,
        "scores rise with rank": row["rises"] > 0,
        "all scores are the same": row["n"] > 0 and row["scores"] <= 1,
        f"a reasoning is shorter than {least_reasoning}": row["short_reasoning"] > 0,
        "a severe risk is in the first ten": risk["severe_head"] > most_severe,
        "a disqualified row is ranked": risk["disqualified"] > 0,
        "an empty profile is in the first ten": risk["empty_head"] > 0,
    }
    warnings = {"the first ten scores are nearly the same": row["n"] >= 10 and row["top10_range"] is not None and row["top10_range"] <= flat}
    warnings |= {f"{name} is missing": True for name in files}
    found = [k for k, v in blocking.items() if v]
    return {"passed": not found, "blocking_errors": found, "warnings": [k for k, v in warnings.items() if v], "figures": {**row.asDict(), **risk.asDict()}}
