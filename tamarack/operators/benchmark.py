"""Ordering cases: what must rank above what, checked against a ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The rank of an id that a ranking lacks.
ABSENT = 99


def check_orders(ranked: DataFrame, cases: DataFrame) -> DataFrame:
    """cases (case, better, worse, least) with the ranks found and whether each holds.

    A case holds if better is ranked above worse, or, where worse is null, if better comes after the first `least`. An id
    that isn't ranked has rank ABSENT.
    """
    ranks = ranked.select(F.col("candidate_id").alias("_id"), F.col("rank").alias("_rank"))
    out = cases
    for name in ("better", "worse"):
        own = ranks.select(F.col("_id").alias(name), F.col("_rank").alias(f"{name}_rank"))
        out = out.join(own, name, "left").withColumn(f"{name}_rank", F.coalesce(f"{name}_rank", F.lit(ABSENT)))
    passed = F.when(F.col("worse").isNotNull(), F.col("better_rank") < F.col("worse_rank")).otherwise(F.col("better_rank") > F.col("least"))
    return out.select("case", "better", "worse", "better_rank", "worse_rank", passed.alias("passed"))


def pass_rate(checked: DataFrame, least: float = 0.75) -> DataFrame:
    """One row: the share of cases that hold, and whether it is enough."""
    rate = F.coalesce(F.avg(F.col("passed").cast("int")), F.lit(0.0))
    return checked.agg(F.round(rate, 4).alias("pass_rate"), (rate >= least).alias("passed"))
