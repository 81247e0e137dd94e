"""The flagship: score every fingerprint in one light pass, then rework a bounded shortlist.

Plan: one projection over the fingerprints ending in a top-N (each task keeps N rows), whose result, at most
the largest pool, is spread over tasks again; everything after works on those rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.operators import evidence, rules, scoring
from tamarack.operators.query import Query, constraints

#: Sorts an id that is a prefix of another after it, among equal scores.
LAST = "\U0010ffff"


@dataclass(frozen=True)
class Settings:
    """compat keeps the order in which adjustments reach the final score; without it the strict pass and the
    guarded head show in the result also where a later stage would hide them."""

    top_k: int = 100
    strict_pool: int = 300
    firewall: rules.Firewall | None = None
    strict_top_n: int = 10
    risk_pool: int = 500
    calibration: dict | None = None
    calibration_pool: int = 700
    weights: dict = field(default_factory=dict)
    penalties: dict = field(default_factory=dict)
    semantic: dict | None = None
    snippets: int = 5
    compat: bool = True

    @property
    def pool(self) -> int:
        return max(1, self.top_k, self.strict_pool, self.risk_pool if self.firewall else 0, self.calibration_pool if self.calibration is not None else 0)


def _components(fingerprints: DataFrame, query: Query, s: Settings, deep: bool) -> DataFrame:
    return scoring.components(evidence.proof(fingerprints, deep=deep, limit=s.snippets), query, penalties=s.penalties, semantic=s.semantic)


def light_scores(fingerprints: DataFrame, query: Query, s: Settings) -> DataFrame:
    """Every fingerprint with its light score, less its light risk if there is a firewall."""
    df = scoring.weigh(_components(fingerprints, query, s, deep=False), s.weights)
    return scoring.with_risk(rules.assess(df, s.firewall, deep=False)) if s.firewall else df


def top(df: DataFrame, score: str, n: int) -> DataFrame:
    """The n best rows by a score; among equals the smaller id, but a longer one before its own prefix."""
    return df.orderBy(F.desc(score), F.concat(F.col("candidate_id").cast("string"), F.lit(LAST))).limit(n)


def shortlist(fingerprints: DataFrame, query: Query, s: Settings) -> DataFrame:
    """The light pass: the pool's best rows by light score."""
    df = top(light_scores(fingerprints, query, s), "score.calibrated_final_score", s.pool)
    return df.select(*fingerprints.columns, F.col("score.final_score").alias("light_score"))


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Number a shortlist's rows; it has at most as many as the pool."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def banded(df: DataFrame, s: Settings) -> DataFrame:
    """The guard on high risks, disqualification, and the two bands: safe head, then the rest.

    df has candidate_id, and the structs score, proof and risk; it gets original_rank, safe_head and adjusted_rank.
    """
    df = numbered(df, "original_rank", F.desc("score.final_score"), F.col("candidate_id"))
    df = scoring.with_risk(df)
    level, alignment = F.col("risk.risk_level"), F.col("proof.proof_alignment_score")
    guarded = F.round(F.greatest(F.lit(0.0), F.col("score.risk_adjusted_score") - 0.08), 6)
    left = F.when((level == "high") & (alignment < 0.85), guarded).otherwise(F.col("score.risk_adjusted_score"))
    df = df.withColumn("score", F.col("score").withField("risk_adjusted_score", left))
    if not s.compat:
        df = df.withColumn("score", F.col("score").withField("calibrated_final_score", F.col("score.risk_adjusted_score")))
    if s.firewall.disqualify_severe:
        df = df.where(~F.col("risk.disqualified"))
    safe = (level != "severe") & ((level != "high") | (alignment >= 0.85))
    order = [F.desc("score.risk_adjusted_score"), F.col("candidate_id")]
    place = F.row_number().over(Window.partitionBy(safe).orderBy(*order))
    df = df.withColumn("safe_head", safe & (place <= s.strict_top_n))
    return numbered(df, "adjusted_rank", F.desc("safe_head"), *order)


def rank_profiles(fingerprints: DataFrame, query: Query, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The top_k fingerprints for a query, with rank, final score, reasoning, and every intermediate struct.

    What the light pass leaves, at most the largest pool, is one partition; it is spread over tasks again for the deep pass.
    """
    s = settings
    spread = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pool = numbered(shortlist(fingerprints, query, s), "place", F.desc("light_score"), F.col("candidate_id")).repartition(min(spread, 64))
    return finish(_components(pool, query, s, deep=True), query, s).drop("parts")


def finish(df: DataFrame, query: Query, s: Settings) -> DataFrame:
    """The ranking of a pool whose rows have place, proof and parts: strict pass, risk and bands, calibration, order."""
    df = scoring.weigh(df, s.weights)
    df = df.withColumn("strict", F.col("place") <= s.strict_pool)
    df = scoring.strict(df, F.col("strict"))
    if not s.compat:
        df = df.withColumn("score", F.col("score").withField("calibrated_final_score", F.col("score.final_score")))
    if s.firewall:
        df = df.where(F.col("place") <= max(s.risk_pool, s.calibration_pool if s.calibration is not None else 0))
        df = banded(rules.assess(df, s.firewall, deep=True), s)
    if s.calibration is not None:
        order = [F.col("adjusted_rank")] if s.firewall else [F.col("place")]
        df = numbered(df, "calibration_place", *order)
        if "risk" not in df.columns:
            df = df.withColumn("risk", F.lit(None).cast("struct<risk_score:double,risk_level:string,disqualified:boolean,flags:array<string>,penalty:double>"))
        df = scoring.calibrate(df, constraints(query), config=s.calibration, where=F.col("calibration_place") <= s.calibration_pool)
    head = [F.desc("safe_head")] if s.firewall and not s.compat else []
    order = [*head, F.desc("score.calibrated_final_score"), F.col("candidate_id")]
    df = numbered(df.orderBy(*order).limit(s.top_k), "rank", *order)
    return df.withColumn("reasoning", reasoning(df))


def reasoning(df: DataFrame) -> Column:
    """One line on what speaks for a row and what against."""
    proof, score = F.col("proof"), F.col("score")
    listed = lambda a, n: F.array_join(F.slice(a, 1, n), ", ")
    spaced = lambda a, n: F.array_join(F.transform(F.slice(a, 1, n), lambda x: F.replace(x, F.lit("_"), F.lit(" "))), ", ")
    good = [
        F.when(F.size(proof["supported_skills"]) > 0, F.concat(F.lit("supported evidence for "), listed(proof["supported_skills"], 4))),
        F.when(proof["retrieval_ranking_evidence_score"] >= 0.25, F.lit("retrieval/ranking work")),
        F.when(proof["evaluation_evidence_score"] >= 0.25, F.lit("evaluation practice")),
        F.when(proof["production_evidence_score"] >= 0.25, F.lit("production deployment")),
    ]
    own = F.array_compact(F.array(*good))
    own = F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("partial JD term alignment")))
    more, bad = [], [
        F.when(F.size(score["unsupported_required_skills"]) > 0, F.concat(F.lit("limited proof for "), listed(score["unsupported_required_skills"], 3))),
        F.when(score["neutral_hireability_used"], F.lit("availability signals are incomplete")),
        F.when(score["penalty_score"] > 0, F.lit("basic profile-quality penalties apply")),
    ]
    if "adjusted_rank" in df.columns:
        more.append(F.when(F.col("risk.risk_level") == "low", F.lit("low risk")))
        bad.append(F.when((F.col("risk.risk_level") != "low") & (F.size("risk.flags") > 0), F.concat(F.lit("risk flags: "), spaced(F.col("risk.flags"), 2))))
    if "calibration" in df.columns:
        more.append(F.when(F.col("calibration.top10_readiness_score") >= 0.65, F.lit("strong top-10 evidence readiness")))
        told = F.col("calibration.negative_constraints_triggered")
        bad.append(F.when(F.size(told) > 0, F.concat(F.lit("calibration constraints: "), spaced(told, 2))))
    extra = F.array_compact(F.array(*more)) if more else F.array().cast("array<string>")
    concerns = F.array_compact(F.array(*bad))
    head = F.concat(F.lit("Evidence-based match: "), F.array_join(F.concat(own, extra), "; "), F.lit("."))
    return F.concat(head, F.when(F.size(concerns) > 0, F.concat(F.lit(" Concern: "), F.array_join(concerns, "; "), F.lit("."))).otherwise(""))


def keyword_only(fingerprints: DataFrame, query: Query, top_k: int) -> DataFrame:
    """Token overlap alone; of a tie at the cut the larger id is kept, and what is kept is listed by id."""
    held = F.array_distinct(F.split("raw_norm", " "))
    wanted = query.tokens
    score = F.size(F.array_intersect(held, scoring.strings(wanted))) / F.lit(float(max(1, len(wanted))))
    best = fingerprints.select("candidate_id", score.alias("score")).orderBy(F.desc("score"), F.desc("candidate_id")).limit(top_k)
    return numbered(best, "rank", F.desc("score"), F.col("candidate_id"))
