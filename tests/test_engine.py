"""Profiles end to end: small records whose results follow by hand, and eight cases whose order is known."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tamarack.operators import evidence, features, ranking, reports, rules, scoring, validators, variants
from tamarack.functions import lexicon as lx
from tamarack.operators.query import clean, constraints, parse

SCHEMA = (
    "candidate_id string, current_title string, years_of_experience double, location string, skills array<string>, "
    "summary string, career_history array<struct<company:string,description:string>>, education string, "
    "signals struct<recruiter_response_rate:double,interview_completion_rate:double,last_active_date:string,notice_period_days:int,open_to_work_flag:boolean,willing_to_relocate:boolean>"
)
GOOD = (0.8, 0.9, "2026-12-01", 30, True, True)
JOB = parse("Must have Python, embeddings, retrieval, ranking and evaluation (NDCG, MRR) in production. Docker preferred.")
MANY = ["Python", "RAG", "LLM", "Embeddings", "Retrieval", "Ranking", "NDCG", "MRR", "Docker", "Kubernetes", "AWS", "PyTorch"]


def person(name, title, years, skills, career, signals=GOOD, summary=None):
    return (name, title, years, None, skills, summary, [("Co", career)] if career else None, None, signals)


PEOPLE = [
    person("STRONG", "Senior Search Engineer", 7.0, ["Python", "Retrieval", "Ranking", "Embeddings", "Evaluation"], "Built and deployed a python retrieval and ranking service with embeddings in production for users. Led offline evaluation with ndcg and mrr , monitoring latency. Shipped api on aws with docker and kubernetes ."),
    person("STUFFER", "Engineer", 0.0, MANY, None, None, "python rag llm embeddings retrieval ranking ndcg mrr docker kubernetes aws pytorch " * 3),
    person("RESEARCH", "Research Scientist", 4.0, ["Python", "NLP"], "Wrote papers as a research scientist in an academic lab on nlp and python ."),
    person("SERVICE", "Customer Support Lead", 6.0, ["Excel"], "Handled tickets and escalations for clients."),
    person("GENERAL", "Data Scientist", 5.0, ["Python", "Machine Learning"], "Developed machine learning models in python and deployed an api to production for users ."),
    person("GEM", "Software Engineer", 5.0, ["Python"], "Built search relevance for a marketplace. Implemented ranking and retrieval in python , measured with ndcg and a/b testing , deployed to production for users ."),
    person("EMPTY", None, None, [], None, None),
    person("SILENT", "Search Engineer", 5.0, ["Python", "Search"], "Implemented search in python and deployed it to production .", None),
]


@pytest.fixture(scope="module")
def fingerprints(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fp") / "fp.parquet")
    features.fingerprints(spark.createDataFrame(PEOPLE, SCHEMA)).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def by_id(fingerprints):
    return {r.candidate_id: r for r in fingerprints.collect()}


def test_fingerprint_fields(by_id):
    r = by_id["STRONG"]
    assert r.claimed_skills[:5] == ["Python", "Retrieval", "Ranking", "Embeddings", "Evaluation"]
    assert {"AWS", "Docker", "Kubernetes", "APIs"} <= set(r.claimed_skills)
    assert r.missing_fields == ["education", "location"]  # a description inside the career serves as the summary
    assert r.profile_completeness_score == 0.8
    assert r.keyword_density_score >= 0.25 and r.anomaly_flags == ["extremely_high_keyword_density"]
    assert r.behavior.recruiter_response_rate == 0.8 and r.availability.open_to_work_flag is True
    career = r.career_evidence
    assert career.seniority_level == "senior"
    assert career.evaluation_terms_found == ["ndcg", "mrr", "offline evaluation"]
    assert career.evaluation_depth_score == 0.75
    empty = by_id["EMPTY"]
    assert empty.anomaly_flags == ["empty_profile_text", "missing_skills", "missing_experience"]
    assert empty.profile_completeness_score == 0.2
    assert by_id["STUFFER"].anomaly_flags == ["extremely_high_keyword_density"]


def test_nested_record_without_id(spark):
    schema = (
        "candidate_id string, profile struct<headline:string,summary:string,current_title:string,years_of_experience:int,location:string>, "
        "skills array<struct<name:string,duration_months:int>>, career_history array<struct<title:string,description:string>>, education string, "
        "signals struct<recruiter_response_rate:double,notice_period_days:int,open_to_work_flag:boolean>"
    )
    row = (None, ("Engineer", None, "ML Engineer", 5, "Pune"), [("Python", 12), ("python ", 1), ("C++", None)], [("Dev", "Worked on Kafka .")], None, (0.5, 30, True))
    r = features.fingerprints(spark.createDataFrame([row], schema)).first()
    assert r.candidate_id == "GENERATED_000000001"
    assert "missing_candidate_id" in r.anomaly_flags
    assert r.claimed_skills == ["Python", "C++", "Machine Learning", "Kafka"]
    assert r.career_evidence_text == "worked on kafka . dev" and r.location == "pune"
    assert r.has_behavior and r.has_availability and r.years_of_experience == 5.0


def test_csv_booleans(spark):
    df = spark.createDataFrame([("1", "True")], "id string, open_to_work string")
    assert features.fingerprints(df).first().availability.open_to_work is True
    assert features.fingerprints(df, parse_booleans=False).first().availability.open_to_work is None


def test_light_and_deep_evidence_differ(spark):
    df = features.fingerprints(spark.createDataFrame([person("A", "Dev", 3.0, ["Python", "Rust", "Kafka"], "Built python.", summary="we worked with rust and go")], SCHEMA))
    light, deep = evidence.proof(df).first().proof, evidence.proof(df, deep=True).first().proof
    assert light.supported_skills == [] and light.unsupported_skills == ["Python", "Rust", "Kafka"]
    assert deep.supported_skills == ["Python"] and deep.weakly_supported_skills == ["Rust", "Kafka"]  # near an action in the raw text
    assert deep.evidence_snippets["Python"] == ["co built python"]
    assert "worked with rust" in deep.evidence_snippets["Rust"][0]
    assert deep.proof_alignment_score == 0.6


def plain_deep(row):
    """Claims by support, from loops over sentences and over matches in the raw text."""

    def sentences(text):
        flat = " ".join((text or "").split())
        return [x for x in (s.strip(" -;,.") for s in re.split(r"(?<=[.!?;])\s+|\s+\|\s+", flat)) if x]

    def mentions(texts, aliases):
        return any(f" {a} " in f" {clean(s)} " for t in texts for s in sentences(t) for a in aliases)

    def near_action(raw, aliases):
        for a in aliases:
            for m in re.finditer(rf"(?<!\w){re.escape(a)}(?!\w)", raw):
                if any(x in raw[max(0, m.start() - 110) : m.end() + 110] for x in lx.ACTIONS):
                    return True
        return False

    known = {clean(n): a for n, a in evidence.ALIASES.items()}
    out = {2: [], 1: [], 0: []}
    for skill, norm in zip(row.claimed_skills, row.claimed_norm, strict=True):
        aliases = known.get(norm, [norm])
        how = 2 if mentions((row.career_evidence_text, row.current_title), aliases) else 1 if mentions((row.education_text,), aliases) or near_action(row.raw_norm, aliases) else 0
        out[how].append(skill)
    return out


def test_deep_evidence_agrees_with_loops(spark):
    rng = random.Random(21)
    terms = [a for aliases in evidence.ALIASES.values() for a in aliases] + ["rust", "go", "cobol"]
    filler = ["we", "the", "team", "with", "for", "and", "of", "teams", "built", "improved", "retrievals", "xpython", "users"]

    def prose(n):
        return " ".join((rng.choice(terms) if rng.random() < 0.15 else rng.choice(filler)) + rng.choice(["", "", "", ".", ";", ",", " |"]) for _ in range(n))

    skills = [*lx.SKILLS, "Rust", "Go", "COBOL", "python", "Learning to Rank"]
    rows = [(f"P{i}", rng.choice(["Search Engineer", "ML lead", "Clerk"]), None, None, rng.sample(skills, rng.randint(0, 9)), prose(rng.choice([0, 5, 60])), [("Co", prose(rng.choice([1, 20, 80])))], prose(rng.choice([0, 4])), None) for i in range(60)]
    fp = features.fingerprints(spark.createDataFrame(rows, SCHEMA))
    got = evidence.proof(fp, deep=True).collect()
    told = {0: 0, 1: 0, 2: 0}
    for r in got:
        expected = plain_deep(r)
        assert (r.proof.supported_skills, r.proof.weakly_supported_skills, r.proof.unsupported_skills) == (expected[2], expected[1], expected[0]), r.candidate_id
        n = sum(map(len, expected.values()))
        assert r.proof.proof_alignment_score == (round((len(expected[2]) + 0.4 * len(expected[1])) / n, 4) if n else 0.0)
        told = {k: told[k] + len(v) for k, v in expected.items()}
    assert min(told.values()) > 20


def test_base_score_by_hand(spark):
    query = parse("Must have Python. Docker preferred.")
    df = features.fingerprints(spark.createDataFrame([person("A", "Dev", 3.0, ["Python"], "wrote python code")], SCHEMA))
    s = scoring.base(evidence.proof(df), query).first().score
    assert query.tokens == ["docker", "docker.", "must", "preferred.", "python."] or set(query.tokens) == {"must", "python.", "docker", "preferred."}
    n = len(query.tokens)
    held = len(set("dev python wrote python code python".split()) & set(query.tokens))
    lexical = 0.55 * held / n + 0.45 * 0.5
    hire = (0.8 + 0.9 + (1 - 30 / 180) + 1.0 + 0.8) / 5
    assert s.must_have_skill_score == 1.0
    assert s.hireability_score == round(hire, 4)
    assert abs(s.final_score - (0.25 * lexical + 0.20 + 0.25 + 0.10 * hire)) < 1e-6


def test_semantic_matches_a_plain_computation(spark):
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    from tamarack.operators import similarity

    query, other = "search ranking search engine", "ranking of search engine search results"
    total = 0.0
    for share, grams in ((0.55, lambda t: similarity._word_grams(t, 1, 2)), (0.45, lambda t: similarity._char_grams(t, 3, 5))):
        known = similarity.weights(grams(query))
        tf = {g: 1 + math.log(n) for g, n in Counter(grams(other)).items() if g in known}
        total += share * sum(known[g] * w for g, w in tf.items()) / math.sqrt(sum(w * w for w in tf.values()))
    got = spark.createDataFrame([(other,)], "t string").select(similarity.similarity(query, F.col("t"))).first()[0]
    assert abs(got - total) < 1e-9
    assert spark.range(1).select(similarity.similarity(query, F.lit(""))).first()[0] == 0.0


def test_semantic_of_long_texts_costs_no_more_than_a_few_cleanings(spark):
    import time

    from pyspark.sql import functions as F

    from tamarack.functions import text as tx
    from tamarack.operators import similarity

    texts = [" ".join(f"{w}{i * k % 997}" for k in range(300) for w in ("search ", "ranking ", "engine", "in production ")) for i in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).persist()
    assert df.count() == 60

    def seconds(column):
        took = []
        for _ in range(2):
            began = time.monotonic()
            df.select(column.alias("x")).write.format("noop").mode("overwrite").save()
            took.append(time.monotonic() - began)
        return min(took)

    assert seconds(similarity.similarity(JOB.normalized, F.col("t"), max_chars=12_000)) < 1.0 + 4 * seconds(tx.clean(F.col("t")))
    df.unpersist()


def test_rules_fire(fingerprints):
    flags = {r.candidate_id: set(r.flags) for r in reports.audit(fingerprints).collect()}
    assert {"buzzword_stuffing", "many_claimed_skills_weak_evidence", "generic_ai_keyword_spam", "weak_proof_alignment"} <= flags["STUFFER"]
    assert "research_only_for_production_jd" in flags["RESEARCH"]
    assert {"empty_profile_text", "missing_availability_signals"} <= flags["EMPTY"]
    assert "buzzword_stuffing" not in flags["STRONG"]


@pytest.mark.parametrize(
    ("title", "years", "text", "flag"),
    [
        ("Dev", -1.0, "x", "negative_experience"), ("Dev", 50.0, "x", "suspiciously_high_experience"), ("Dev", 2.0, "has 12 years of experience", "impossible_years_of_experience"),
        ("Dev", 20.0, "since 2020", "impossible_years_of_experience"), ("Senior Dev", None, "x", "experience_missing_for_senior_role"), ("Senior Dev", 1.0, "x", "senior_title_without_experience"),
        ("Junior Dev", 12.0, "x", "unrealistic_experience_for_title"), ("Dev", 2.0, "expert in java with 0 months", "zero_duration_expert_claim"),
    ],
)
def test_single_rules(spark, title, years, text, flag):
    df = features.fingerprints(spark.createDataFrame([person("A", title, years, ["Excel"], text)], SCHEMA))
    assert flag in reports.audit(df).first().flags


def test_eight_cases_rank_as_expected(fingerprints):
    settings = ranking.Settings(top_k=8, firewall=rules.Firewall(), calibration={})
    rows = ranking.rank_profiles(fingerprints, JOB, settings).collect()
    place = {r.candidate_id: r["rank"] for r in rows}
    at = lambda name: place.get(name, 99)
    checks = [
        at("STRONG") < at("STUFFER"), at("GEM") < at("STUFFER"), at("STRONG") < at("RESEARCH"), at("GENERAL") < at("SERVICE"),
        at("STRONG") < at("GENERAL"), at("EMPTY") > 3, at("SILENT") < at("SERVICE"),
    ]
    assert sum(checks) / len(checks) >= 0.75
    assert at("STRONG") == 1
    assert [r["rank"] for r in sorted(rows, key=lambda r: (-r.score.calibrated_final_score, r.candidate_id))] == list(range(1, len(rows) + 1))
    again = ranking.rank_profiles(fingerprints, JOB, settings).collect()
    assert [(r.candidate_id, r.score) for r in rows] == [(r.candidate_id, r.score) for r in again]


def test_strict_pass_shows_outside_compat(fingerprints):
    plain = ranking.rank_profiles(fingerprints, JOB, ranking.Settings(top_k=8)).collect()
    shown = ranking.rank_profiles(fingerprints, JOB, ranking.Settings(top_k=8, compat=False)).collect()
    assert any(r.score.final_score != r.score.calibrated_final_score for r in plain)
    assert all(r.score.final_score == r.score.calibrated_final_score for r in shown)


def test_scores_over_a_table_equal_the_column(spark):
    from pyspark.sql import functions as F

    from tamarack.operators import similarity

    query = "search ranking search engine a b"
    texts = ["ranking of search engine search results", "", "zebra", "engine " * 900 + "search engines", "a", "aaaa aaaaaaa", "search" * 300 + " x" + "ranking" * 147 + "sea"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    alone = {r.id: r.s for r in df.select("id", similarity.similarity(query, F.col("t"), max_chars=10**6).alias("s")).collect()}
    got = {r.id: r.score for r in similarity.scores(df, "id", "t", query).collect()}
    assert got == pytest.approx(alone) and got[2] == 0.0 < got[3]


def test_long_dotted_texts_have_tokens(spark):
    from pyspark.sql import functions as F

    from tamarack.functions import text as tx

    df = spark.createDataFrame([("1." * 100_000,), ("a+b#c.d. " * 20_000,)], "t string")
    assert sorted(r.n for r in df.select(F.size(tx.tokens(F.col("t"))).alias("n")).collect()) == [1, 20_000]


def test_outputs_and_validation(spark, fingerprints, tmp_path):
    ranked = ranking.rank_profiles(fingerprints, JOB, ranking.Settings(top_k=5, firewall=rules.Firewall(), calibration={})).persist()
    reports.write_outputs(ranked, str(tmp_path))
    table, broken = (spark.read.csv(f"{tmp_path}/{name}", header=True) for name in ("ranked", "breakdown"))
    assert len(broken.columns) == 28
    assert validators.validate(table, 5, breakdown=broken, calibrated=True) == []
    assert "duplicate ids" in validators.validate(table.unionByName(table), 10)
    assert validators.validate(table.drop("score"), 5) == ["missing columns: score"]
    assert "scores out of range" in validators.validate(table.withColumn("score", table.score.cast("double") + 5), 5)
    bad = broken.withColumns({"risk_level": F.lit("severe"), "disqualified": F.lit("true")})
    assert {"a disqualified row is ranked", "a severe risk is in the first ten"} <= set(validators.validate(table, 5, breakdown=bad))
    told = validators.safety(table, broken, rows=5, files=("proofs",))
    assert told["passed"] and told["warnings"] == ["proofs is missing"]
    assert not validators.safety(table.withColumn("reasoning", F.lit("short")), bad, rows=5)["passed"]
    proofs = spark.read.json(f"{tmp_path}/proofs")
    cards = reports.explanation_cards(table, broken, proofs, 2).orderBy("rank").collect()
    assert [c["rank"] for c in cards] == [1, 2] and cards[0].markdown.startswith("## 1. STRONG")
    assert reports.proofs_of(proofs, ["STRONG"]).count() == 1
    assert reports.histogram(fingerprints, "anomaly_flags", 3).first()["n"] >= 1
    assert reports.profile_summary(fingerprints).first().n == 8
    report = reports.write_calibration(ranked, constraints(JOB), str(tmp_path))
    assert report["candidates_calibrated"] == 5 and 0 < report["top10_average_readiness"] < 1
    audit = reports.write_audit(reports.audit(fingerprints), str(tmp_path), ranked)
    assert audit["n"] == 8 and audit["top10"]["n"] == 5
    assert spark.read.text(f"{tmp_path}/risk_audit.json").count() > 5
    assert reports.plain({"a": float("nan"), "b": (1, float("inf"))}) == {"a": None, "b": [1, None]}


def test_audits_and_variants(fingerprints):
    found = reports.audit(fingerprints).persist()
    assert sum(r.n for r in reports.risk_summary(found).collect()) == 8
    merged = reports.merged_reports(found, found.where("candidate_id = 'STUFFER'")).collect()
    assert {r.candidate_id for r in merged if r.deep} == {"STUFFER"}
    assert all(abs(sum(s.weights.values()) - 1) < 1e-9 for s in variants.settings(ranking.Settings()).values())
    base = ranking.Settings(top_k=4, firewall=rules.Firewall(), calibration={})
    got = {r.variant: r for r in variants.ablation(fingerprints, JOB, base).collect()}
    assert got["keyword_only"].overlap == 1.0 and len(got) == 4 and got["baseline"].n == 4
    assert got["plus_firewall"].average_risk > 0 == got["baseline"].average_risk
    swept = {r.variant: r for r in variants.sensitivity(fingerprints, JOB, base).collect()}
    assert len(swept) == 8 and swept["default"].overlap == 1.0


def test_variants_share_components_and_agree_with_whole_rankings(fingerprints):
    base = ranking.Settings(top_k=5, firewall=rules.Firewall(), calibration={})
    some = {k: v for k, v in variants.settings(base).items() if k in ("proof_heavy", "firewall_strict")}
    tops = variants.heads(fingerprints, JOB, some).collect()
    for name, s in some.items():
        own = [(r.candidate_id, r["rank"], r.score.calibrated_final_score) for r in ranking.rank_profiles(fingerprints, JOB, s).collect()]
        assert sorted((r.candidate_id, r["rank"], r.score) for r in tops if r.variant == name) == sorted(own)


def test_calibration_by_hand(spark):
    df = features.fingerprints(spark.createDataFrame([person("A", "Dev", 3.0, ["Python"], "wrote python code")], SCHEMA))
    query = parse("Must have Python in production systems.")
    df = scoring.base(evidence.proof(df, deep=True), query)
    from pyspark.sql import functions as F

    df = df.withColumn("risk", F.struct(F.lit(0.1).alias("risk_score"), F.array().cast("array<string>").alias("flags")))
    c = scoring.calibrate(df, constraints(query)).first()
    assert c.calibration.jd_constraint_match_score == 1.0
    assert c.calibration.negative_constraints_triggered == ["no_production_evidence"]
    assert c.calibration.negative_constraint_penalty == 0.06
    hire = 0.25 * 0.8 + 0.15 * (1 - 30 / 365) + 0.20 + 0.15 * 0.9 + 0.10 * 0.9 + 0.15 * (1 - 30 / 180)
    assert c.calibration.hireability.hireability_score == round(hire, 4)


def test_rows_outside_the_calibration_pool_keep_their_scores(fingerprints):
    s = ranking.Settings(firewall=rules.Firewall(), calibration={}, calibration_pool=2, risk_pool=8, top_k=8)
    rows = ranking.rank_profiles(fingerprints, JOB, s).select("candidate_id", "calibration", "score").collect()
    plain = [r for r in rows if r.calibration is None]
    assert len(plain) >= 3 and all(r.score.calibrated_final_score == r.score.risk_adjusted_score for r in plain)
