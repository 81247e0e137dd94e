"""Rankings of one query under several settings, compared by what is in their heads."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions import lexicon as lx
from tamarack.operators import evidence, ranking, rules, scoring
from tamarack.operators.query import Query

# How variants change the weights, which are then brought to a sum of one.
CHANGES = {
    "default": {},
    "proof_heavy": {"proof_alignment": 0.37, "jd_relevance": 0.18, "hireability": 0.05},
    "production_heavy": {"production_readiness": 0.22, "jd_relevance": 0.20, "hireability": 0.05},
    "retrieval_eval_heavy": {"retrieval_evaluation_depth": 0.24, "jd_relevance": 0.18, "hireability": 0.05},
    "hireability_light": {"hireability": 0.03, "proof_alignment": 0.30},
    "firewall_strict": {},
    "calibration_light": {},
}
KEYWORDS = "keyword_only"


def reweighted(weights: dict, change: dict) -> dict:
    """Weights with some of them changed, adding up to one."""
    held = lx.SCORE_WEIGHTS | weights | change
    total = sum(held.values())
    return {k: v / total for k, v in held.items()} if total > 0 else held


def settings(base: ranking.Settings) -> dict[str, ranking.Settings]:
    """The settings of the weight comparison."""
    out = {name: replace(base, weights=reweighted(base.weights, change)) for name, change in CHANGES.items()}
    wall = base.firewall or rules.Firewall()
    stricter = replace(wall, max_penalty=0.65, penalties=wall.penalties | {"weak_proof_alignment": 0.22, "buzzword_stuffing": 0.22})
    out["firewall_strict"] = replace(out["firewall_strict"], firewall=stricter)
    out["calibration_light"] = replace(out["calibration_light"], calibration={**(base.calibration or {}), "max_calibration_bonus": 0.04, "max_calibration_penalty": 0.08})
    return out


def heads(fingerprints: DataFrame, query: Query, variants: dict[str, ranking.Settings], keywords: str | None = None) -> DataFrame:
    """The top rows of every variant: variant, candidate_id, rank, score and what metrics() reads.

    Variants differ in weights, risk and calibration alone, so components are worked out once: lightly for all rows,
    all variants in one pass, and deeply for the rows that are in some variant's pool. keywords names a ranking by token overlap.
    """
    spark = fingerprints.sparkSession
    some = next(iter(variants.values()))
    light = scoring.components(evidence.proof(fingerprints), query, penalties=some.penalties, semantic=some.semantic)
    walls = list(dict.fromkeys(s.firewall.name for s in variants.values() if s.firewall))
    by_name = {s.firewall.name: s.firewall for s in variants.values() if s.firewall}
    light = scoring.weigh(light, some.weights)
    for k, name in enumerate(walls):
        light = rules.assess(light, by_name[name], deep=False, name=f"risk{k}")
    light = light.select("candidate_id", "parts", *[F.struct(f"risk{k}.penalty", f"risk{k}.disqualified").alias(f"risk{k}") for k in range(len(walls))])
    pools = [tuple(r) for r in pools_of(light, variants, walls).collect()]  # a pool for each variant
    places = spark.createDataFrame(pools, f"variant string, _id {fingerprints.schema['candidate_id'].dataType.simpleString()}, place int")
    wanted = fingerprints.join(F.broadcast(places.select(F.col("_id").alias("candidate_id")).distinct()), "candidate_id", "left_semi")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deep = scoring.components(evidence.proof(wanted.repartition(min(parts, 64)), deep=True, limit=some.snippets), query, penalties=some.penalties, semantic=some.semantic).persist()
    tops = None
    for name, s in variants.items():
        own = deep.join(F.broadcast(places.where(F.col("variant") == name)), F.col("candidate_id") == F.col("_id")).drop("_id")
        one = _shown(ranking.finish(own, query, s)).withColumn("variant", F.lit(name))
        tops = one if tops is None else tops.unionByName(one)
    if keywords:
        one = ranking.keyword_only(fingerprints, query, some.top_k).select("candidate_id", "rank", "score")
        tops = tops.unionByName(one.withColumn("variant", F.lit(keywords)), allowMissingColumns=True)
    found = tops.collect()  # top_k rows for each variant
    deep.unpersist()
    return spark.createDataFrame(found, tops.schema)


#: Up to so many rows of a group, a task keeps only that many of each before they are shuffled.
_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


@contextmanager
def _kept_by_task(spark: SparkSession, n: int):
    before = spark.conf.get(_LIMIT, None)
    spark.conf.set(_LIMIT, max(n + 1, int(before or 0)))
    try:
        yield
    finally:
        spark.conf.unset(_LIMIT) if before is None else spark.conf.set(_LIMIT, before)


class _Pools:
    """Pools of all variants, to be collected in one pass over the light components."""

    def __init__(self, table: DataFrame, n: int):
        self.table, self.n = table, n

    def collect(self) -> list:
        with _kept_by_task(self.table.sparkSession, self.n):
            return self.table.collect()


def pools_of(light: DataFrame, variants: dict[str, ranking.Settings], walls: list[str]) -> _Pools:
    """variant, candidate_id, place of the rows in each variant's pool.

    light: candidate_id, parts, and a struct risk0, risk1 ... for each of the walls. Every row has its scores under all variants at once; then each
    task keeps the best rows of each variant, and only those meet.
    """
    scored, rows = light, []
    for k, (name, s) in enumerate(variants.items()):
        scored = scoring.weigh(scored, s.weights)
        if s.firewall:
            scored = scoring.with_risk(scored.withColumn("risk", F.col(f"risk{walls.index(s.firewall.name)}")))
        scored = scored.withColumn(f"_v{k}", F.struct(F.col("score.calibrated_final_score").alias("by"), F.col("score.final_score").alias("light_score"))).drop("score", "risk")
        rows.append(F.struct(F.lit(name).alias("variant"), F.lit(s.pool).alias("pool"), F.col(f"_v{k}.by").alias("by"), F.col(f"_v{k}.light_score").alias("light_score")))
    most = max(s.pool for s in variants.values())
    each = scored.select("candidate_id", F.explode(F.array(*rows)).alias("r")).select("candidate_id", "r.*")
    best = Window.partitionBy("variant").orderBy(F.desc("by"), F.concat(F.col("candidate_id").cast("string"), F.lit(ranking.LAST)))
    held = each.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most).where(F.col("_n") <= F.col("pool"))
    place = F.row_number().over(Window.partitionBy("variant").orderBy(F.desc("light_score"), "candidate_id"))
    return _Pools(held.select("variant", "candidate_id", place.alias("place")), most)


def _shown(ranked: DataFrame) -> DataFrame:
    of = lambda struct, field, kind: F.col(f"{struct}.{field}") if struct in ranked.columns else F.lit(None).cast(kind)
    return ranked.select(
        "candidate_id",
        "rank",
        F.col("score.calibrated_final_score").alias("score"),
        (F.size("score.unsupported_required_skills") > 0).alias("unsupported"),
        *[F.col(f"proof.{k}").alias(k) for k in ("proof_alignment_score", "production_evidence_score", "retrieval_ranking_evidence_score", "evaluation_evidence_score")],
        of("risk", "risk_score", "double").alias("risk_score"),
        of("risk", "risk_level", "string").alias("risk_level"),
        of("risk", "flags", "array<string>").alias("flags"),
        of("calibration", "evidence_confidence_score", "double").alias("confidence"),
        of("calibration", "top10_readiness_score", "double").alias("readiness"),
    )


def metrics(tops: DataFrame, reference: str, n: int = 100, head: int = 10) -> DataFrame:
    """For each variant: means and rates over its first n and first ten, score spreads, and overlaps with a reference variant."""
    tops = tops.where(F.col("rank") <= n)
    held = tops.where(F.col("variant") == reference).select(F.col("candidate_id").alias("_id"), (F.col("rank") <= head).alias("_head"))
    joined = tops.join(F.broadcast(held), F.col("candidate_id") == F.col("_id"), "left")  # at most n rows for each variant
    first = F.col("rank") <= head
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 4)
    rate = lambda cond: F.round(F.avg(F.coalesce(cond, F.lit(False)).cast("int")), 4)
    spread = lambda c: F.round(F.coalesce(F.max(c) - F.min(c), F.lit(0.0)), 6)
    return joined.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"),
        mean(F.col("proof_alignment_score")).alias("average_proof_alignment"),
        mean(F.col("risk_score")).alias("average_risk"),
        mean(F.col("confidence")).alias("average_evidence_confidence"),
        F.round(F.avg(F.when(first, F.coalesce("readiness", F.lit(0.0)))), 4).alias("average_top10_readiness"),
        rate(F.col("unsupported")).alias("unsupported_required_skill_rate"),
        rate(F.array_contains("flags", "buzzword_stuffing")).alias("keyword_stuffing_rate"),
        rate(F.col("production_evidence_score") > 0).alias("production_evidence_rate"),
        rate((F.col("retrieval_ranking_evidence_score") > 0) | (F.col("evaluation_evidence_score") > 0)).alias("retrieval_evaluation_evidence_rate"),
        rate(F.col("_id").isNotNull()).alias("overlap"),
        F.round(F.avg(F.when(first, F.coalesce(F.col("_head"), F.lit(False)).cast("int"))), 4).alias("top10_overlap"),
        F.count_if(first & (F.col("risk_level") == "severe")).alias("severe_in_top10"),
        spread(F.col("score")).alias("score_spread"),
        spread(F.when(first, F.col("score"))).alias("top10_score_spread"),
        F.round(F.avg("score"), 6).alias("mean_score"),
    )


def sensitivity(fingerprints: DataFrame, query: Query, base: ranking.Settings) -> DataFrame:
    """The seven weight variants and the ranking by token overlap, against the default; semantic matching as base has it."""
    name = "keyword_baseline_reference"
    return metrics(heads(fingerprints, query, settings(base), keywords=name), "default")


def ablation(fingerprints: DataFrame, query: Query, base: ranking.Settings) -> DataFrame:
    """Token overlap alone, then the score without and with risk and calibration; overlaps are with token overlap alone."""
    plain = replace(base, firewall=None, calibration=None)
    fire = replace(plain, firewall=base.firewall or rules.Firewall())
    full = replace(fire, calibration=base.calibration or {})
    return metrics(heads(fingerprints, query, {"baseline": plain, "plus_firewall": fire, "plus_firewall_plus_calibration": full}, keywords=KEYWORDS), KEYWORDS)
