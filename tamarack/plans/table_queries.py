"""The engine's operators over the driver's tables, each with the SQL that must agree.

A query maps columns of the tables to the columns that an operator works on, and calls the operator: what is compared with the SQL is
what the library computes. SQL speaks DuckDB's dialect. Both sides compute with doubles in the same order, and lists are
joined to strings, so values can be compared as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions import lexicon as lx
from tamarack.functions import text as tx
from tamarack.operators import evidence, features, ranking, reports, rules, scoring, similarity, validators, variants
from tamarack.operators import query as queries
from tamarack.plans import profile_queries as profiles
from tamarack.plans import profile_sql as psql
from tamarack.plans.profile_sql import clamped, cleaned, rounded
from tamarack.plans.sql_text import sql_count, sql_rewritten, sql_squeeze, sql_words
from tamarack.streaming.events import hourly_counts

QUERIES: dict = {}
ORACLE_SQL: dict = {}
STOP = ", ".join(f"'{w}'" for w in lx.STOPWORDS)
#: Phrases that occur in the invented prose of the documents.
PHRASES = {"of_the": ("of the", "the of"), "and": ("and",), "de_la": ("de la", "la de"), "le": ("le", "les"), "der": ("der", "die", "das")}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _squeezed(text: str = "text"):
    return tx.squeeze(F.coalesce(text, F.lit("")))


def _item_tokens(items: DataFrame) -> DataFrame:
    kept = F.filter(F.array_distinct(tx.words(_squeezed())), lambda w: (F.length(w) > 2) & ~w.isin(*lx.STOPWORDS))
    return items.select("item_id", kept.alias("wanted"))


ITEM_SQL = f"SELECT item_id, list_filter(list_distinct({sql_words(sql_squeeze('text'))}), lambda w: length(w) > 2 AND w NOT IN ({STOP})) AS wanted FROM benchmark"


ITEM_CLEAN = f"SELECT list_filter(list_distinct({sql_words(cleaned('text'))}), lambda w: length(w) > 2 AND w NOT IN ({STOP})) AS wanted FROM benchmark WHERE item_id = 0"


def _item_query(spark, sf_dir) -> queries.Query:
    """The first benchmark item as a query document."""
    item = table(spark, sf_dir, "benchmark").where("item_id = 0").first()
    return queries.parse(item["text"] if item else "")


@query(f"""
WITH q AS ({ITEM_CLEAN}), d AS (SELECT doc_id, list_distinct({sql_words(sql_squeeze("coalesce(text, '')"))}) AS held FROM documents),
s AS (SELECT doc_id, len(list_intersect(wanted, held)) / len(wanted) AS score FROM d, q),
b AS (SELECT * FROM s ORDER BY score DESC, doc_id DESC LIMIT 100)
SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM b""")
def lexical_topk(spark, sf_dir):
    """Token overlap of every document with one query text, and the best hundred."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("candidate_id"), _squeezed().alias("raw_norm"))
    return ranking.keyword_only(docs, _item_query(spark, sf_dir), 100).select("rank", F.col("candidate_id").alias("doc_id"), "score")


@query(f"""
WITH q AS ({ITEM_SQL}), d AS (SELECT doc_id, list_distinct({sql_words(sql_squeeze("coalesce(text, '')"))}) AS held FROM documents)
SELECT doc_id, item_id, len(list_intersect(wanted, held)) / len(wanted) AS overlap FROM d, q
WHERE len(wanted) > 0 AND len(list_intersect(wanted, held)) / len(wanted) >= 0.5""")
def token_overlap_pairs(spark, sf_dir):
    """Documents that hold at least half of an item's tokens, by a join on tokens."""
    items = _item_tokens(table(spark, sf_dir, "benchmark"))
    keys = items.select("item_id", F.size("wanted").alias("n"), F.explode("wanted").alias("w"))
    held = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(tx.words(_squeezed()))).alias("w"))
    shared = held.join(keys, "w").groupBy("doc_id", "item_id", "n").agg(F.count(F.lit(1)).alias("shared"))
    return shared.select("doc_id", "item_id", (F.col("shared") / F.col("n")).alias("overlap")).where("overlap >= 0.5")


_TOTAL = " + ".join(sql_count("p", t) for terms in PHRASES.values() for t in terms)
_NAMES = " || ".join("CASE WHEN " + " + ".join(sql_count("p", t) for t in terms) + f" > 0 THEN '{name};' ELSE '' END" for name, terms in PHRASES.items())


@query(f"""
WITH d AS (SELECT doc_id, {sql_squeeze("coalesce(text, '')")} AS c FROM documents),
p AS (SELECT doc_id, ' ' || c || ' ' AS p, len(regexp_extract_all(c, '{tx.TOKEN_SQL}')) AS n FROM d)
SELECT doc_id, n::INT AS n_tokens, CASE WHEN n = 0 THEN 0.0 ELSE least(1.0, ({_TOTAL}) / n) END AS density, {_NAMES} AS terms FROM p""")
def phrase_density(spark, sf_dir):
    """Occurrences of phrases against the number of tokens, and which phrases occur."""
    d = tx.settled(table(spark, sf_dir, "documents").select("doc_id", "text"), {"c": _squeezed()})
    every = [t for terms in PHRASES.values() for t in terms]
    d = tx.settled(d, {"p": tx.padded(F.col("c")), "n_tokens": F.size(tx.tokens(F.col("c"))), "held": tx.found(F.col("c"), every)})
    density = F.when(F.col("n_tokens") == 0, 0.0).otherwise(F.least(F.lit(1.0), tx.phrase_counts(F.col("p"), F.col("held")) / F.col("n_tokens")))
    return d.select("doc_id", "n_tokens", density.alias("density"), F.array_join(F.transform(tx.named(F.col("held"), PHRASES), lambda x: F.concat(x, F.lit(";"))), "").alias("terms"))


@query(f"""
SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct, coalesce(list_max(list_transform(t, lambda x: length(x))), 0)::INT AS longest
FROM (SELECT doc_id, regexp_extract_all({sql_squeeze("coalesce(text, '')")}, '{tx.TOKEN_SQL}') AS t FROM documents)""")
def token_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.tokens(_squeezed()).alias("t"))
    longest = F.coalesce(F.array_max(F.transform("t", lambda x: F.length(x))), F.lit(0))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), longest.alias("longest"))


@query(f"""SELECT doc_id, {cleaned("text")} AS cleaned FROM documents""")
def clean_text_basic(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT conv_id, turn, {sql_rewritten('text')} AS rewritten FROM conversations")
def transliterate_numbers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.phrases_and_numbers(F.col("text")).alias("rewritten"))


_FLAT = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query(rf"""
WITH s AS (SELECT doc_id, list_transform(list_filter(string_split(regexp_replace(regexp_replace({_FLAT}, '([.!?;])\s+', '\1' || chr(1), 'g'), '\s+[|]\s+', chr(1), 'g'), chr(1)),
  lambda x: trim(x) <> ''), lambda x: trim(x, ' -;,.')) AS parts FROM documents),
m AS (SELECT doc_id, len(parts)::INT AS n_sentences, list_filter(list_transform(parts, lambda x: {{'s': x, 'p': ' ' || {cleaned('x')} || ' '}}), lambda x: contains(x.p, ' of ') AND x.s <> '') AS hits FROM s),
u AS (SELECT doc_id, n_sentences, list_filter(hits, lambda x, i: list_position(list_transform(hits, lambda y: y.p), x.p) = i) AS hits FROM m)
SELECT doc_id, n_sentences, coalesce(array_to_string(list_transform(hits[1:3], lambda x: trim(substr(x.s, 1, 240))), '#'), '') AS snippets FROM u""")
def sentence_snippets(spark, sf_dir):
    """Sentences with a term in them, the first three that differ, cut to 240 characters."""
    d = tx.settled(table(spark, sf_dir, "documents").select("doc_id", "text"), {"found": evidence.pairs(F.col("text"), sought=tx.strings(["of"]))})
    return d.select("doc_id", F.size("found").alias("n_sentences"), F.array_join(evidence.snippets(F.col("found"), tx.strings(["of"]), 3), "#").alias("snippets"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey::VARCHAR || chr(1114111) LIMIT 500")
def bounded_shortlist(spark, sf_dir):
    """The best 500 by score; among equals the smaller id, but a longer one before its own prefix."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate_id"), "o_totalprice")
    return ranking.top(orders, "o_totalprice", 500).select(F.col("candidate_id").alias("o_orderkey"), "o_totalprice")


# A pool of customers with what the bands go by: a score, a risk report and an alignment.
_POOL_SQL = f"""
WITH c AS (SELECT c_custkey AS id, {rounded("(c_acctbal + 1000.0::DOUBLE) / 11000.0::DOUBLE", 6)} AS final, (c_custkey % 21) / 20.0::DOUBLE AS alignment, (c_nationkey % 6) / 20.0::DOUBLE AS penalty,
  CASE c_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'severe' END AS risk_level, c_custkey % 4 = 3 AND c_custkey % 8 = 3 AS disqualified FROM customer),
p AS (SELECT * FROM c ORDER BY final DESC, id::VARCHAR || chr(1114111) LIMIT 300),
o AS (SELECT *, row_number() OVER (ORDER BY final DESC, id) AS original, {rounded("CASE WHEN disqualified THEN 0.0::DOUBLE ELSE " + clamped("final - penalty") + " END", 6)} AS risked FROM p),
a AS (SELECT *, CASE WHEN risk_level = 'high' AND alignment < 0.85 THEN {rounded("greatest(0.0::DOUBLE, risked - 0.08::DOUBLE)", 6)} ELSE risked END AS adjusted,
  risk_level <> 'severe' AND (risk_level <> 'high' OR alignment >= 0.85) AS safe FROM o WHERE NOT disqualified),
h AS (SELECT *, safe AND row_number() OVER (PARTITION BY safe ORDER BY adjusted DESC, id) <= 10 AS head FROM a),
b AS (SELECT *, row_number() OVER (ORDER BY head DESC, adjusted DESC, id) AS place FROM h)"""


def _banded(spark, sf_dir) -> DataFrame:
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    final = F.round((F.col("c_acctbal") + 1000.0) / 11000.0, 6)
    level = F.element_at(tx.strings(["low", "medium", "high", "severe"]), (key % 4 + 1).cast("int"))
    risk = F.struct(level.alias("risk_level"), ((key % 4 == 3) & (key % 8 == 3)).alias("disqualified"), ((F.col("c_nationkey") % 6) / 20.0).alias("penalty"))
    score = F.struct(*[final.alias(k) for k in ("final_score", "risk_adjusted_score", "calibrated_final_score")])
    pool = c.select(key.alias("candidate_id"), score.alias("score"), F.struct(((key % 21) / 20.0).alias("proof_alignment_score")).alias("proof"), risk.alias("risk"))
    return ranking.banded(ranking.top(pool, "score.final_score", 300), ranking.Settings(firewall=rules.Firewall()))


@query(f"{_POOL_SQL} SELECT place::INT AS rank, id AS c_custkey, adjusted AS risk_adjusted, final, head AS safe_head FROM b")
def two_band_rerank(spark, sf_dir):
    """Penalties, the guard on high risks, disqualification, and the ten best safe rows before all others."""
    return _banded(spark, sf_dir).select(F.col("adjusted_rank").alias("rank"), F.col("candidate_id").alias("c_custkey"), F.col("score.risk_adjusted_score").alias("risk_adjusted"), F.col("score.final_score").alias("final"), "safe_head")


@query(f"""{_POOL_SQL} SELECT id AS candidate_id, original::INT AS original_rank, place::INT AS adjusted_rank, (original - place)::INT AS rank_change,
  CASE WHEN original > place THEN 'moved up' WHEN original < place THEN 'moved down' ELSE 'unchanged' END AS reason FROM b""")
def rank_change_audit(spark, sf_dir):
    return reports.rank_changes(_banded(spark, sf_dir))


_PARTS = {"jd_relevance": "p_size / 50.0", "must_have_skill": "(p_partkey % 11) / 10.0", "proof_alignment": "p_retailprice / 2000.0", "retrieval_evaluation_depth": "(p_partkey % 7) / 6.0", "production_readiness": "(p_size % 10) / 9.0", "hireability": "(p_partkey % 3) / 2.0"}
_COST = "CASE WHEN p_size < 5 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END"


def _sql_part(name: str) -> str:
    top, below = _PARTS[name].rsplit("/ ", 1)
    return f"({top}) / {below}::DOUBLE"


def _sql_weighted(weights: dict) -> str:
    total = " + ".join(f"{weights[k]!r}::DOUBLE * ({_sql_part(k)})" for k in _PARTS)
    return rounded(clamped(f"{total} - {_COST}"), 6)


def _parts(spark, sf_dir) -> DataFrame:
    """Parts as rows with the components of a score."""
    each = [(F.expr(v.rsplit("/ ", 1)[0]) / F.lit(float(v.rsplit("/ ", 1)[1]))).alias(k) for k, v in _PARTS.items()]
    cost = F.when(F.col("p_size") < 5, 0.15).otherwise(0.0).alias("cost")
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.struct(*each, cost).alias("parts"))


@query(f"SELECT p_partkey, {_sql_weighted(lx.SCORE_WEIGHTS)} AS score FROM part")
def weighted_score(spark, sf_dir):
    """The base score: a weighted sum of six components less penalties, within 0 and 1."""
    return _parts(spark, sf_dir).select("p_partkey", scoring.weighted(F.col("parts"), lx.SCORE_WEIGHTS, F.col("parts.cost")).alias("score"))


@query(f"""
WITH c AS (SELECT c_custkey, (c_acctbal + 1000.0) / 11000.0 AS base, (c_custkey % 13) / 12.0::DOUBLE AS proof, (c_custkey % 5) / 4.0::DOUBLE AS retr, (c_custkey % 3) / 2.0::DOUBLE AS eval,
  (c_custkey % 9) / 8.0::DOUBLE AS prod, c_nationkey % 7 AS unsup, (c_custkey % 17) / 16.0::DOUBLE AS dens FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN {rounded(clamped("base + (0.05::DOUBLE * proof + 0.035::DOUBLE * retr + 0.025::DOUBLE * eval + 0.03::DOUBLE * prod - least(0.12::DOUBLE, 0.025::DOUBLE * unsup) - 0.08::DOUBLE * dens)"), 6)} ELSE base END AS adjusted FROM c""")
def strict_adjust(spark, sf_dir):
    key = F.col("c_custkey")
    proof = [((key % m) / float(m - 1)).alias(n) for n, m in (("proof_alignment_score", 13), ("retrieval_ranking_evidence_score", 5), ("evaluation_evidence_score", 3), ("production_evidence_score", 9))]
    lacking = F.slice(F.array_repeat(F.lit("skill"), 7), F.lit(1), F.col("c_nationkey") % 7)
    final = (F.col("c_acctbal") + 1000.0) / 11000.0
    score = F.struct(final.alias("final_score"), final.alias("risk_adjusted_score"), lacking.alias("unsupported_required_skills"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.struct(*proof).alias("proof"), score.alias("score"), ((key % 17) / 16.0).alias("keyword_density_score"))
    return scoring.strict(c, F.col("c_custkey") % 2 == 0).select("c_custkey", F.col("score.final_score").alias("adjusted"))


# What calibration goes by, from parts: alignment, depths, risk and claims.
_CALIBRATED_SQL = f"""
WITH c AS (SELECT p_partkey AS id, {rounded("(p_partkey % 13) / 12.0::DOUBLE")} AS alignment, (p_partkey % 7) / 6.0::DOUBLE AS production, (p_partkey % 5) / 4.0::DOUBLE AS retrieval, (p_partkey % 3) / 2.0::DOUBLE AS evaluation,
  (p_size % 11) / 10.0::DOUBLE AS career, (p_size % 6) / 5.0::DOUBLE AS consistency, (p_partkey % 17) / 40.0::DOUBLE AS density, p_partkey % 4 AS lacking, CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey % 8) / 10.0::DOUBLE END AS risk,
  p_partkey % 6 = 0 AND p_partkey % 9 <> 0 AS shallow, p_brand LIKE '%1' AS research, p_retailprice / 2500.0::DOUBLE AS adjusted FROM part),
n AS (SELECT *, {clamped("1.0::DOUBLE - lacking / 3.0::DOUBLE")} AS match, least(0.15::DOUBLE, 0.0::DOUBLE + CASE WHEN density >= 0.12 AND alignment < 0.20 THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN lacking > 0 THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN evaluation = 0 THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN production = 0 THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN retrieval = 0 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN research AND production = 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN shallow THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END) AS negative FROM c),
e AS (SELECT *, {clamped("0.35::DOUBLE * career + 0.25::DOUBLE * production + 0.20::DOUBLE * retrieval + 0.20::DOUBLE * evaluation")} AS depth,
  {clamped("0.30::DOUBLE * alignment + 0.20::DOUBLE * match + 0.20::DOUBLE * production + 0.18::DOUBLE * retrieval + 0.12::DOUBLE * evaluation")} AS technical FROM n),
r AS (SELECT *, {clamped("0.55::DOUBLE * alignment + 0.25::DOUBLE * consistency + 0.20::DOUBLE * depth")} AS confidence, {clamped("technical * (1.0::DOUBLE - 0.65::DOUBLE * coalesce(risk, 0.0::DOUBLE))")} AS ready FROM e),
k AS (SELECT *, {clamped("0.30::DOUBLE * confidence + 0.15::DOUBLE * career + 0.25::DOUBLE * match + 0.10::DOUBLE * 0.505::DOUBLE + 0.20::DOUBLE * ready")} AS combined FROM r),
b AS (SELECT *, {rounded("least(0.08::DOUBLE, greatest(0.0::DOUBLE, combined - 0.50::DOUBLE) * 0.16::DOUBLE * " + clamped("0.5::DOUBLE * alignment + 0.5::DOUBLE * match") + ")")} AS bonus,
  {rounded("least(0.15::DOUBLE, negative + greatest(0.0::DOUBLE, 0.25::DOUBLE - confidence) * 0.20::DOUBLE)")} AS cost FROM k)"""


@query(f"""{_CALIBRATED_SQL}
SELECT id AS p_partkey, {rounded("confidence")} AS confidence, {rounded("ready")} AS readiness, {rounded("negative")} AS negative, bonus, cost, {rounded(clamped("adjusted + bonus - cost"), 6)} AS calibrated FROM b""")
def calibrated_score(spark, sf_dir):
    """Confidence, readiness, negative constraints, bonus and penalty, and the score that they move; no signal is known, so hireability is neutral."""
    key, size = F.col("p_partkey"), F.col("p_size")
    required = ["Python", "Retrieval", "Ranking"]
    wanted = queries.Constraints(required, [], "unknown", True, True, True, [], [], [])
    depths = {"production_depth_score": (key % 7) / 6.0, "retrieval_depth_score": (key % 5) / 4.0, "evaluation_depth_score": (key % 3) / 2.0, "career_depth_score": (size % 11) / 10.0, "career_consistency_score": (size % 6) / 5.0}
    borne = F.slice(tx.strings(required), F.lit(1), (F.lit(3) - key % 4).cast("int"))
    flags = F.when(key % 6 == 0, tx.strings(["shallow_project_evidence"])).otherwise(tx.strings([]))
    none = lambda kind: F.lit(None).cast(kind)
    adjusted = F.col("p_retailprice") / 2500.0
    p = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.struct(F.round((key % 13) / 12.0, 4).alias("proof_alignment_score"), borne.alias("supported_skills"), tx.strings([]).alias("weakly_supported_skills")).alias("proof"),
        F.struct(*[v.alias(k) for k, v in depths.items()]).alias("career_evidence"),
        ((key % 17) / 40.0).alias("keyword_density_score"),
        F.when(key % 9 != 0, F.struct(((key % 8) / 10.0).alias("risk_score"), flags.alias("flags"))).alias("risk"),
        F.struct(adjusted.alias("risk_adjusted_score"), adjusted.alias("calibrated_final_score")).alias("score"),
        F.when(F.col("p_brand").endswith("1"), "Research on parts.").otherwise("Parts.").alias("career_evidence_text"),
        F.lit("").alias("raw_text_compact"),
        F.struct(none("double").alias("recruiter_response_rate"), none("double").alias("interview_completion_rate"), none("string").alias("last_active_date")).alias("behavior"),
        F.struct(none("boolean").alias("open_to_work_flag"), none("boolean").alias("willing_to_relocate"), none("double").alias("notice_period_days")).alias("availability"),
    )
    c = scoring.calibrate(p, wanted)
    told = {"confidence": "evidence_confidence_score", "readiness": "top10_readiness_score", "negative": "negative_constraint_penalty", "bonus": "calibration_bonus", "cost": "calibration_penalty"}
    return c.select("p_partkey", *[F.col(f"calibration.{v}").alias(k) for k, v in told.items()], F.col("score.calibrated_final_score").alias("calibrated"))


@query("""
WITH r AS (SELECT s_suppkey, (s_suppkey % 101) / 100.0::DOUBLE AS risk, (s_suppkey % 8) / 10.0::DOUBLE AS total FROM supplier)
SELECT s_suppkey, least(0.5::DOUBLE, greatest(0.0::DOUBLE, CASE
  WHEN risk < 0.25::DOUBLE THEN least(0.03::DOUBLE, greatest(risk * 0.10::DOUBLE, total * 0.15::DOUBLE))
  WHEN risk < 0.50::DOUBLE THEN least(0.10::DOUBLE, greatest(0.04::DOUBLE, 0.04::DOUBLE + (risk - 0.25::DOUBLE) * 0.24::DOUBLE, total * 0.30::DOUBLE))
  WHEN risk < 0.75::DOUBLE THEN least(0.25::DOUBLE, greatest(0.11::DOUBLE, 0.11::DOUBLE + (risk - 0.50::DOUBLE) * 0.56::DOUBLE, total * 0.45::DOUBLE))
  ELSE greatest(0.30::DOUBLE, 0.30::DOUBLE + (risk - 0.75::DOUBLE) * 0.80::DOUBLE, total * 0.60::DOUBLE) END)) AS penalty FROM r""")
def piecewise_penalty(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 101) / 100.0).alias("risk"), ((F.col("s_suppkey") % 8) / 10.0).alias("total"))
    return s.select("s_suppkey", rules.penalty(F.col("risk"), F.col("total"), 0.5).alias("penalty"))


def _fingerprints(spark, sf_dir) -> DataFrame:
    return features.fingerprints(profiles.records(spark, sf_dir))


@query(f"""{psql.PROOF}, {psql.scored(queries.parse(profiles.JOB))}, {psql.risk(True, "scored")}
SELECT 'P' || doc_id AS candidate_id, {rounded("risk")} AS risk_score, risk_level, disqualified, array_to_string(flags, '|') AS flags, penalty,
  {rounded("CASE WHEN disqualified THEN 0.0::DOUBLE ELSE " + clamped("final_score - penalty") + " END", 6)} AS left_over FROM risked""")
def rule_flags(spark, sf_dir):
    """All 27 rules over scored profiles, and what their penalty leaves of the score."""
    df = scoring.base(evidence.proof(_fingerprints(spark, sf_dir)), queries.parse(profiles.JOB))
    df = scoring.with_risk(rules.assess(df, rules.Firewall(), deep=True))
    return df.select("candidate_id", "risk.risk_score", "risk.risk_level", "risk.disqualified", F.array_join("risk.flags", "|").alias("flags"), "risk.penalty", F.col("score.risk_adjusted_score").alias("left_over"))


@query(f"""SELECT flag AS value, count(*) AS n FROM (SELECT candidate_id, unnest(string_split(flags, '|')) AS flag FROM ({psql.AUDIT}) WHERE flags <> '') GROUP BY flag ORDER BY n DESC, min(candidate_id) LIMIT 15""")
def flag_histogram(spark, sf_dir):
    """Frequency of flags; among equals the one seen first."""
    return reports.histogram(reports.audit(_fingerprints(spark, sf_dir)), "flags", 15)


@query(f"""SELECT risk_level, count(*) AS n, count(*) FILTER (flags <> '') AS flagged, count(*) FILTER (disqualified) AS disqualified, {rounded("avg(risk_score)")} AS mean_risk, {rounded("avg(penalty)")} AS mean_penalty
FROM ({psql.AUDIT}) GROUP BY risk_level""")
def risk_levels(spark, sf_dir):
    return reports.risk_summary(reports.audit(_fingerprints(spark, sf_dir)))


@query(f"""WITH light AS MATERIALIZED (SELECT candidate_id, light_flags AS flags FROM ({psql.scores(queries.parse(profiles.JOB))})),
deep AS MATERIALIZED (SELECT candidate_id, flags FROM ({psql.AUDIT}) WHERE substr(candidate_id, 2)::INT % 3 = 0 AND substr(candidate_id, 2)::INT % 4 <> 1)
SELECT candidate_id, d.candidate_id IS NOT NULL AS deep, coalesce(d.flags, l.flags) AS flags FROM (SELECT * FROM light WHERE substr(candidate_id, 2)::INT % 4 <> 2) l FULL JOIN deep d USING (candidate_id)
WHERE coalesce(d.flags, l.flags) <> ''""")
def override_merge(spark, sf_dir):
    """Light reports, of which deep ones take the place by id; rows left without flags go. Either side has ids that the other lacks."""
    df = scoring.base(evidence.proof(_fingerprints(spark, sf_dir)), queries.parse(profiles.JOB))
    number = F.substring("candidate_id", 2, 20).cast("int")
    light = rules.assess(df, rules.Firewall(), deep=False).where(number % 4 != 2).select("candidate_id", "risk.*")
    deep = reports.audit(_fingerprints(spark, sf_dir)).where((number % 3 == 0) & (number % 4 != 1))
    return reports.merged_reports(light, deep).select("candidate_id", "deep", F.array_join("flags", "|").alias("flags"))


@query(f"""{psql.FEATURES} SELECT count(*) AS n, {rounded("avg(completeness)")} AS profile_completeness_score, {rounded("avg(density)")} AS keyword_density_score, {rounded("avg(hint)")} AS skill_evidence_hint_score,
  {rounded("avg((raw = '')::INT)")} AS empty_profile_rate, 0.0::DOUBLE AS generated_id_rate, {rounded("avg((len(explicit_n) = 0)::INT)")} AS missing_skills_rate, {rounded("avg((career = '')::INT)")} AS missing_career_rate FROM f""")
def profile_completeness(spark, sf_dir):
    return reports.profile_summary(_fingerprints(spark, sf_dir))


_USERS_SQL = """
WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS buys,
  count(*) FILTER (event_type = 'signup') AS signups, max(ts)::DATE AS last_day FROM events GROUP BY 1),
s AS (SELECT user_id, CASE WHEN user_id % 3 <> 0 THEN clicks / nullif(clicks + views, 0) END AS rr, CASE WHEN user_id % 4 <> 1 THEN (user_id % 6) / 5.0::DOUBLE END AS icr, CASE WHEN user_id % 5 <> 0 THEN last_day END AS last_day,
  CASE WHEN buys > 0 AND user_id % 7 <> 0 THEN buys::DOUBLE END AS notice, CASE WHEN user_id % 6 <> 0 THEN signups > 10 END AS open_now, CASE WHEN user_id % 4 <> 0 THEN user_id % 2 = 0 END AS moves FROM u)"""
_R13 = {
    "response": f"CASE WHEN rr IS NOT NULL THEN {clamped('rr')} ELSE 0.5::DOUBLE END", "activity": f"CASE WHEN last_day IS NOT NULL THEN {clamped(chr(39).join(['1.0::DOUBLE - date_diff(', 'day', ', last_day, DATE ', '2026-12-31', ') / 365.0::DOUBLE']))} ELSE 0.5::DOUBLE END",
    "availability": "CASE WHEN open_now IS NULL THEN 0.5::DOUBLE WHEN open_now THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END", "interview": f"CASE WHEN icr IS NOT NULL THEN {clamped('icr')} ELSE 0.5::DOUBLE END",
    "relocation": "CASE WHEN moves IS NULL THEN 0.55::DOUBLE WHEN moves THEN 0.9::DOUBLE ELSE 0.45::DOUBLE END", "notice": f"CASE WHEN notice IS NOT NULL THEN {clamped('1.0::DOUBLE - notice / 180.0::DOUBLE')} ELSE 0.5::DOUBLE END",
}
_R13_SCORE = "0.0::DOUBLE + " + " + ".join(f"{w}::DOUBLE * ({_R13[k]})" for k, w in (("response", 0.25), ("activity", 0.15), ("availability", 0.20), ("interview", 0.15), ("relocation", 0.10), ("notice", 0.15)))
_R4 = f"""list_filter([CASE WHEN rr IS NOT NULL THEN {clamped('rr')} END, CASE WHEN icr IS NOT NULL THEN {clamped('icr')} END, CASE WHEN notice IS NOT NULL THEN {clamped('1.0::DOUBLE - notice / 180.0::DOUBLE')} END,
  CASE WHEN open_now THEN 1.0::DOUBLE WHEN NOT open_now THEN 0.35::DOUBLE END, CASE WHEN moves THEN 0.8::DOUBLE WHEN NOT moves THEN 0.5::DOUBLE END], lambda x: x IS NOT NULL)"""


@query(f"""{_USERS_SQL}, l AS (SELECT *, {_R4} AS held FROM s)
SELECT user_id, CASE WHEN len(held) > 0 THEN list_reduce(list_prepend(0.0::DOUBLE, held), lambda a, b: a + b) / len(held) ELSE 0.5::DOUBLE END AS signals, len(held) = 0 AS neutral, {rounded(clamped(_R13_SCORE))} AS calibrated FROM l""")
def hireability_signals(spark, sf_dir):
    """Both hireability scores over signals that are made of events, some unknown."""
    kinds = {"clicks": "click", "views": "view", "buys": "purchase", "signups": "signup"}
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(n) for n, k in kinds.items()], F.max("ts").cast("date").alias("last_day"))
    key, none = F.col("user_id"), F.lit(None)
    behavior = {
        "recruiter_response_rate": F.when((key % 3 != 0) & (F.col("clicks") + F.col("views") > 0), F.col("clicks") / (F.col("clicks") + F.col("views"))), "response_rate": none.cast("double"),
        "interview_completion_rate": F.when(key % 4 != 1, (key % 6) / 5.0), "last_active_date": F.when(key % 5 != 0, F.col("last_day").cast("string")),
    }
    availability = {
        "notice_period_days": F.when((F.col("buys") > 0) & (key % 7 != 0), F.col("buys").cast("double")), "notice_period": none.cast("double"), "open_to_work_flag": F.when(key % 6 != 0, F.col("signups") > 10),
        "open_to_work": none.cast("boolean"), "willing_to_relocate": F.when(key % 4 != 0, key % 2 == 0), "relocation": none.cast("boolean"),
    }
    held = u.select("user_id", *[F.struct(*[v.alias(k) for k, v in x.items()]).alias(n) for n, x in (("behavior", behavior), ("availability", availability))], F.lit("").alias("raw_text_compact"), F.lit("").alias("career_evidence_text"))
    score, neutral = scoring.hireability()
    return held.select("user_id", score.alias("signals"), neutral.alias("neutral"), scoring.calibrated_hireability()["hireability_score"].alias("calibrated"))


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::INT) AS total_k, count(DISTINCT (props->>'$.k')) AS n_k FROM events GROUP BY 1")
def event_json_props(spark, sf_dir):
    """Fields found in a JSON column at run time."""
    e = table(spark, sf_dir, "events").select("event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total_k"), F.countDistinct("k").alias("n_k"))


_SETS = {name: variants.reweighted({}, change) for name, change in variants.CHANGES.items()}
_FACTS = "p_partkey AS id, p_partkey % 3 = 0 AS unsupported, (p_partkey % 9) / 8.0::DOUBLE AS alignment, p_size % 4 > 1 AS produced, p_size % 5 > 2 AS retrieved, p_partkey % 6 = 0 AS evaluated, (p_partkey % 11) / 10.0::DOUBLE AS risk, p_partkey % 13 = 0 AS stuffed, p_partkey % 17 = 0 AS severe, (p_size % 7) / 6.0::DOUBLE AS confidence, (p_size % 9) / 8.0::DOUBLE AS readiness"
_HEADS_SQL = "h AS MATERIALIZED (" + " UNION ALL ".join(f"(SELECT '{n}' AS variant, row_number() OVER (ORDER BY score DESC, id::VARCHAR || chr(1114111)) AS rank, * FROM (SELECT {_FACTS}, {_sql_weighted(w)} AS score FROM part) QUALIFY rank <= 100)" for n, w in _SETS.items()) + ")"


@query(f"""WITH {_HEADS_SQL}, k AS (SELECT id, rank <= 10 AS first FROM h WHERE variant = 'default')
SELECT variant, count(*) AS n, {rounded("avg(alignment)")} AS average_proof_alignment, {rounded("avg(risk)")} AS average_risk, {rounded("avg(confidence)")} AS average_evidence_confidence, {rounded("avg(readiness) FILTER (rank <= 10)")} AS average_top10_readiness,
  {rounded("avg(unsupported::INT)")} AS unsupported_required_skill_rate, {rounded("avg(stuffed::INT)")} AS keyword_stuffing_rate, {rounded("avg(produced::INT)")} AS production_evidence_rate, {rounded("avg((retrieved OR evaluated)::INT)")} AS retrieval_evaluation_evidence_rate,
  {rounded("avg((k.id IS NOT NULL)::INT)")} AS overlap, {rounded("avg(coalesce(k.first, false)::INT) FILTER (rank <= 10)")} AS top10_overlap, count(*) FILTER (rank <= 10 AND severe) AS severe_in_top10,
  {rounded("max(score) - min(score)", 6)} AS score_spread, {rounded("max(score) FILTER (rank <= 10) - min(score) FILTER (rank <= 10)", 6)} AS top10_score_spread, {rounded("avg(score)", 6)} AS mean_score
FROM h LEFT JOIN k USING (id) GROUP BY variant""")
def ablation_overlap(spark, sf_dir):
    """The metrics of the heads of seven rankings, whose weights are those of the comparison."""
    key, size = F.col("p_partkey"), F.col("p_size")
    facts = {
        "unsupported": key % 3 == 0, "proof_alignment_score": (key % 9) / 8.0, "production_evidence_score": F.when(size % 4 > 1, 0.5).otherwise(0.0), "retrieval_ranking_evidence_score": F.when(size % 5 > 2, 0.5).otherwise(0.0),
        "evaluation_evidence_score": F.when(key % 6 == 0, 0.5).otherwise(0.0), "risk_score": (key % 11) / 10.0, "risk_level": F.when(key % 17 == 0, "severe").otherwise("low"),
        "flags": F.when(key % 13 == 0, tx.strings(["buzzword_stuffing"])).otherwise(tx.strings([])), "confidence": (size % 7) / 6.0, "readiness": (size % 9) / 8.0,
    }
    base = _parts(spark, sf_dir).select(key.alias("candidate_id"), "parts", *[v.alias(k) for k, v in facts.items()])
    tops = None
    for name, weights in _SETS.items():
        scored = base.withColumn("score", scoring.weighted(F.col("parts"), weights, F.col("parts.cost")))
        one = ranking.numbered(ranking.top(scored, "score", 100), "rank", F.desc("score"), F.concat(F.col("candidate_id").cast("string"), F.lit("\U0010ffff"))).withColumn("variant", F.lit(name))
        tops = one if tops is None else tops.unionByName(one)
    return variants.metrics(tops, "default")


@query("""
WITH r AS (SELECT o_orderpriority AS grp, o_orderkey, o_totalprice / 400000.0::DOUBLE AS score, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rank, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderstatus || repeat('x', (o_orderkey % 60)::INT) END AS reasoning FROM orders),
l AS (SELECT *, lag(score) OVER (PARTITION BY grp ORDER BY rank) AS before FROM r)
SELECT grp, count(*) AS n, count(*) - count(DISTINCT o_orderkey) AS duplicates, (max(rank) = count(*) AND min(rank) = 1) AS continuous, count(*) FILTER (score < 0 OR score > 1) AS bad_scores, count(*) FILTER (score > before) AS rises,
  count(DISTINCT score) AS scores, count(*) FILTER (reasoning = '') AS no_reasoning, count(*) FILTER (length(reasoning) < 40) AS short_reasoning, round(avg(length(reasoning)), 2) AS mean_reasoning,
  round(max(score) FILTER (rank <= 10) - min(score) FILTER (rank <= 10), 6) AS top10_range FROM l GROUP BY grp""")
def validator_checks(spark, sf_dir):
    """Continuity of ranks, scores that don't fall, duplicate ids, scores out of range, reasoning that is too short."""
    o = table(spark, sf_dir, "orders")
    reason = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.concat("o_orderstatus", F.repeat(F.lit("x"), (F.col("o_orderkey") % 60).cast("int"))))
    rank = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey"))  # builds the input: five rankings
    r = o.select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("candidate_id"), rank.alias("rank"), (F.col("o_totalprice") / 400000.0).alias("score"), reason.alias("reasoning"))
    return validators.checks(r, by="grp")


@query("""
WITH b AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN 1.5 ELSE p_retailprice / 2500.0::DOUBLE END AS score, p_partkey AS rank, p_partkey % 31 = 0 AS disqualified, CASE WHEN p_partkey % 4 = 0 THEN 'severe' ELSE 'low' END AS level,
  CASE WHEN p_partkey % 5 = 0 THEN 'empty_profile_text|x' WHEN p_partkey % 29 = 0 THEN 'a' || chr(10) ELSE '' END AS flags FROM part)
SELECT count(*) FILTER (score > 1) AS bad_risk_scores, 0 AS bad_calibrated_scores, count(*) FILTER (disqualified) AS disqualified, count(*) FILTER (contains(flags, chr(10))) AS broken_flags,
  count(*) FILTER (rank <= 10 AND level = 'severe') AS severe_head, count(*) FILTER (rank <= 10 AND contains(flags, 'empty')) AS empty_head FROM b""")
def breakdown_checks(spark, sf_dir):
    """Bad scores, disqualified rows, and severe or empty profiles among the first ten."""
    key = F.col("p_partkey")
    flags = F.when(key % 5 == 0, "empty_profile_text|x").when(key % 29 == 0, "a\n").otherwise("")
    score = F.when(key % 50 == 0, 1.5).otherwise(F.col("p_retailprice") / 2500.0)
    p = table(spark, sf_dir, "part").select(key.alias("rank"), score.alias("risk_adjusted_score"), (key % 31 == 0).alias("disqualified"), F.when(key % 4 == 0, "severe").otherwise("low").alias("risk_level"), flags.alias("risk_flags"))
    return validators.risk_checks(p)


@query(f"""
WITH t AS (SELECT conv_id, turn, list_filter(list_transform(string_split(coalesce(text, ''), ' '), lambda w: {{'k': {cleaned('w')}, 'v': trim(w)}}), lambda x: x.k <> '') AS w FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: y.k), x.k) = i), lambda x: x.v), ' ') AS terms FROM t""")
def ordered_distinct(spark, sf_dir):
    """Distinct words by their normal form, each as it was spelled first."""
    kept = features.first_spellings(F.split(F.coalesce("text", F.lit("")), " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.transform(kept, lambda x: x["v"]), " ").alias("terms"))


def _sql_cosine(name: str, grams: str, wanted: str) -> str:
    """The cosine over the query's grams; grams: (doc_id, g), wanted: (g)."""
    return f"""{name}_q AS (SELECT g, 1.0::DOUBLE + ln(count(*)) AS wt FROM ({wanted}) GROUP BY g), {name}_n AS (SELECT sqrt(sum(wt * wt)) AS norm FROM {name}_q),
{name}_c AS (SELECT doc_id, g, 1.0::DOUBLE + ln(count(*)) AS tf FROM ({grams}) WHERE g IN (SELECT g FROM {name}_q) GROUP BY doc_id, g),
{name} AS (SELECT doc_id, sum(wt / norm * tf) / sqrt(sum(tf * tf)) AS score FROM {name}_c JOIN {name}_q USING (g), {name}_n GROUP BY doc_id)"""


def _sql_grams(source: str, key: str) -> tuple[str, str]:
    words = f"SELECT {key} unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS g FROM (SELECT {key} list_filter(regexp_extract_all(c, '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 1) AS w FROM {source})"
    chars = " UNION ALL ".join(f"SELECT {key} substr(x, i, {n}) AS g FROM (SELECT {key} x, unnest(range(1, greatest(length(x) - {n} + 1, 1) + 1)) AS i FROM (SELECT {key} ' ' || unnest({sql_words('c')}) || ' ' AS x FROM {source}) WHERE length(x) >= {n} OR {n} = 3)" for n in (3, 4, 5))
    return words, chars


_DOC_GRAMS, _ITEM_GRAMS = _sql_grams("d", "doc_id,"), _sql_grams("i", "")


@query(f"""
WITH d AS MATERIALIZED (SELECT doc_id, {sql_squeeze("coalesce(text, '')")} AS c FROM documents), i AS MATERIALIZED (SELECT {cleaned('text')} AS c FROM benchmark WHERE item_id = 0),
{_sql_cosine('by_word', _DOC_GRAMS[0], _ITEM_GRAMS[0])}, {_sql_cosine('by_char', _DOC_GRAMS[1], _ITEM_GRAMS[1])}
SELECT doc_id, round({clamped("0.55::DOUBLE * coalesce(by_word.score, 0.0::DOUBLE) + 0.45::DOUBLE * coalesce(by_char.score, 0.0::DOUBLE)")}, 6) AS score FROM d LEFT JOIN by_word USING (doc_id) LEFT JOIN by_char USING (doc_id)""")
def tfidf_similarity(spark, sf_dir):
    """Cosines over the query's words and pairs of words, and over its grams of 3 to 5 characters, of whole texts; 0 where nothing is shared."""
    d = table(spark, sf_dir, "documents").select("doc_id", _squeezed().alias("c"))
    return similarity.scores(d, "doc_id", "c", _item_query(spark, sf_dir).normalized).select("doc_id", F.round("score", 6).alias("score"))


_JOB = queries.parse(profiles.JOB)
_BLEND = "CASE WHEN alike > 0 THEN " + clamped("0.65::DOUBLE * lexical + 0.35::DOUBLE * alike") + " ELSE lexical END"
_BLENDED = {"jd_relevance": "blend", "must_have_skill": "must", "proof_alignment": "alignment", "retrieval_evaluation_depth": "depth_score", "production_readiness": "production", "hireability": "hire"}


@query(f"""{psql.PROOF}, {psql.scored(_JOB)}, d AS MATERIALIZED (SELECT doc_id, lt AS c FROM s4), i AS MATERIALIZED (SELECT '{_JOB.normalized}' AS c),
{_sql_cosine('by_word', _DOC_GRAMS[0], _ITEM_GRAMS[0])}, {_sql_cosine('by_char', _DOC_GRAMS[1], _ITEM_GRAMS[1])},
m AS (SELECT s4.*, {clamped("0.55::DOUBLE * coalesce(by_word.score, 0.0::DOUBLE) + 0.45::DOUBLE * coalesce(by_char.score, 0.0::DOUBLE)")} AS alike FROM s4 LEFT JOIN by_word USING (doc_id) LEFT JOIN by_char USING (doc_id)),
b AS (SELECT *, {_BLEND} AS blend FROM m)
SELECT 'P' || doc_id AS candidate_id, {rounded("lexical")} AS lexical, {rounded("alike")} AS alike, {rounded("blend")} AS jd_relevance_score,
  {rounded(clamped(" + ".join(f"{w!r}::DOUBLE * {_BLENDED[k]}" for k, w in lx.SCORE_WEIGHTS.items()) + " - cost"), 6)} AS final_score FROM b""")
def semantic_blend(spark, sf_dir):
    """The base score with semantic matching on: relevance blends token overlap with the cosines over the profile's whole bounded text."""
    on = {"enabled": True, "max_candidate_chars": 2 * features.MAX_TEXT}  # a profile's text is never longer
    df = scoring.weigh(scoring.components(evidence.proof(_fingerprints(spark, sf_dir)), _JOB, penalties={}, semantic=on), {})
    return df.select("candidate_id", F.round("parts.lexical", 4).alias("lexical"), F.round("parts.alike", 4).alias("alike"), "score.jd_relevance_score", "score.final_score")


@query(f"""
WITH q AS ({ITEM_CLEAN}), d AS (SELECT doc_id, list_distinct({sql_words(sql_squeeze("coalesce(text, '')"))}) AS held FROM documents),
s AS (SELECT doc_id, len(list_intersect(wanted, held)) / len(wanted) AS score FROM d, q),
b AS (SELECT * FROM s ORDER BY score DESC, doc_id DESC LIMIT 50),
r AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM b)
SELECT rank, doc_id, score, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN toxic = 1 THEN 'severe' ELSE 'low' END END AS risk_level, coalesce(c.lang, '') AS skills,
  '## ' || rank || '. ' || doc_id || chr(10) || 'overlap' || CASE WHEN c.lang IS NOT NULL THEN chr(10) || 'Supported: ' || c.lang || chr(10) || '- ' || c.source ELSE '' END AS markdown
FROM r LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 <> 0) c USING (doc_id) WHERE rank <= 20""")
def explanation_join(spark, sf_dir):
    """Cards for the head of a ranking, joined with what a breakdown and proofs know of each id."""
    docs = table(spark, sf_dir, "documents")
    best = ranking.keyword_only(docs.select(F.col("doc_id").alias("candidate_id"), _squeezed().alias("raw_norm")), _item_query(spark, sf_dir), 50).withColumn("reasoning", F.lit("overlap"))
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("candidate_id"), F.when(F.col("toxic") == 1, "severe").otherwise("low").alias("risk_level"))
    borne = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("candidate_id"), F.array("lang").alias("supported_skills"), F.array("source").alias("snippets"))
    cards = reports.explanation_cards(best, known, borne, 20)
    return cards.select("rank", F.col("candidate_id").alias("doc_id"), "score", "risk_level", F.coalesce(F.array_join("supported_skills", ","), F.lit("")).alias("skills"), "markdown")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def sha_digest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return reports.digest(d, "text").select("doc_id", F.col("text_sha256").alias("digest"))


@query(rf"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, {sql_squeeze('t')} AS cleaned FROM p""")
def html_strip_clean(spark, sf_dir):
    """The text of pages without scripts, styles, comments and tags, cleaned."""
    t = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", tx.squeeze(t).alias("cleaned"))


@query("""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def windowed_stream_counts(spark, sf_dir):
    """The streaming adapter's hourly counts, as a batch over the same plan."""
    return hourly_counts(table(spark, sf_dir, "events"))
