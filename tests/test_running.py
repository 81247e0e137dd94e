"""The stream's own best rows; rows before rows; sanitising at any depth; numbers without a map."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tamarack.operators import features, ranking, reports, rules, scoring, validators, variants
from tamarack.sources import readers
from tamarack.streaming.top import RunningTop


def best(rows, n):
    """By score, then the smaller id, a longer one before its own prefix."""
    return sorted(rows, key=lambda r: (-r[1], r[0] + "\U0010ffff"))[:n]


def told(df):
    return [tuple(r) for r in ranking.top(df, "final_score", 10**6).collect()]


def test_stream_keeps_the_best_of_all_batches(spark, tmp_path):
    rng = random.Random(1)
    batches = [[(rng.choice(["A", "B", "C"]) * rng.randint(1, 3) + str(i % 7), rng.randint(0, 6) / 4) for i in range(rng.randint(0, 30))] for _ in range(5)]
    top = RunningTop(spark, str(tmp_path / "top"), 8)
    schema, seen = "candidate_id string, final_score double", []
    assert top.current() is None

    def after(df, number):
        assert told(df) == best([r for b in seen for r in b], 8)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = top.writer(stream, after).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    for k, rows in enumerate(batches):  # stopped and started again between batches
        seen.append(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
        assert told(top.current()) == best([r for b in seen for r in b], 8), k
    assert len(list((tmp_path / "top").glob("batch=*"))) <= 2


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "candidate_id string, final_score double")
    top = RunningTop(spark, str(tmp_path), 3)
    one, two = [("A", 1.0), ("B", 0.5)], [("C", 0.7), ("AA", 1.0)]
    for rows, number in ((one, 0), (two, 1), (two, 1)):
        got = told(top.merge(frame(rows), number))
    assert got == best(one + two, 3)
    (tmp_path / "batch=2").mkdir()  # a version that was never finished
    assert told(top.current()) == got and told(top.merge(frame([]), 2)) == got


def plain_previous(rows):
    out = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        out |= {r: before[3] if before else None for before, r in zip([None, *own], own)}  # noqa: B905
    return out


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_previous_row_across_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice(["x", "y", None]), rng.randint(0, 60), f"id{i}", rng.choice([None, rng.random()])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, rank int, candidate_id string, score double")
    got = validators.with_previous(df, "score", "rank", "candidate_id", ("g",), ranges=ranges)
    assert {tuple(r[:4]): r.before for r in got.collect()} == plain_previous(rows)
    same = validators.with_previous(df.drop("g"), "score", "rank", "candidate_id", ranges=ranges).collect()
    assert {("", *r[:3]): r.before for r in same} == plain_previous([("", *r[1:]) for r in rows])


def test_rises_over_missing_ranks(spark):
    df = spark.createDataFrame([("a", 1, 0.9, "x" * 50), ("b", 2, 0.5, "x" * 50), ("c", 4, 0.8, "x" * 50)], "candidate_id string, rank int, score double, reasoning string")
    assert validators.checks(df).first().rises == 1
    assert validators.checks(df.where("rank < 4")).first().rises == 0
    assert "scores rise with rank" in validators.validate(df, 3)


def test_sanitised_at_any_depth(spark):
    row = F.expr("named_struct('a', array(cast('NaN' AS double), 1.5D, null), 'm', map('k', array(named_struct('f', cast('inf' AS float), 'n', 1))), 'd', map(cast('nan' AS double), 1, 2.0D, 2))")
    df = spark.range(1).select(row.alias("nested col"), F.lit(float("-inf")).alias("x.y"), F.lit(None).cast("struct<f:double>").alias("none"))
    out = reports.finite(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    assert json.loads(out.toJSON().first()) == {"nested col": {"a": [None, 1.5, None], "m": {"k": [{"n": 1}]}, "d": {"2.0": 2}}}


def test_numbers_by_a_table_of_offsets(spark):
    df = spark.range(0, 1000, 1, 50).where("id % 7 <> 3").select("id", F.lit("x").alias("_pid_"))
    numbered = readers.with_row_number(df)
    assert [r.row_number for r in numbered.orderBy("id").collect()] == list(range(1, df.count() + 1))
    small = len(readers.with_row_number(spark.range(0, 10, 1, 2))._jdf.queryExecution().analyzed().toString())
    assert len(readers.with_row_number(spark.range(0, 10, 1, 3000))._jdf.queryExecution().analyzed().toString()) < 1.05 * small


def test_pools_of_all_variants_in_one_pass(spark):
    """As each variant's own top-N, with ties, and with pools larger than Spark's own limit for keeping rows by task."""
    rng = random.Random(6)
    parts = "struct<jd_relevance:double,must_have_skill:double,proof_alignment:double,retrieval_evaluation_depth:double,production_readiness:double,hireability:double,cost:double,lexical:double,alike:double,matched:array<string>,lacking:array<string>,neutral:boolean>"
    rows = [(f"id{i % 2000}", (*[rng.randint(0, 4) / 4 for _ in range(6)], 0.1 * rng.randint(0, 1), 0.5, 0.5, [], [], False), (rng.randint(0, 3) / 10, rng.random() < 0.1)) for i in range(2500)]
    light = spark.createDataFrame(rows, f"candidate_id string, parts {parts}, risk0 struct<penalty:double,disqualified:boolean>").repartition(5)
    wall = rules.Firewall()
    some = {"plain": ranking.Settings(strict_pool=50, top_k=10), "risky": ranking.Settings(firewall=wall, risk_pool=1500, strict_pool=20), "heavy": ranking.Settings(weights={"hireability": 0.9}, strict_pool=300)}
    got = {}
    for variant, _, place in variants.pools_of(light, some, [wall.name]).collect():
        got.setdefault(variant, []).append(place)
    pools = {(v, i) for v, i, _ in variants.pools_of(light, some, [wall.name]).collect()}
    for name, s in some.items():
        one = scoring.weigh(light, s.weights)
        one = scoring.with_risk(one.withColumn("risk", F.col("risk0"))) if s.firewall else one
        own = ranking.top(one, "score.calibrated_final_score", s.pool).select("candidate_id").collect()
        assert sorted(got[name]) == list(range(1, s.pool + 1)) and {(name, r[0]) for r in own} == {p for p in pools if p[0] == name}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with variants._kept_by_task(spark, 1500):
            plan = variants.pools_of(light, some, [wall.name]).table._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_cards_tell_strengths_and_risks(spark):
    ranked = spark.createDataFrame([("A", 1, "0.9", "why"), ("B", 2, "0.7", "so")], "candidate_id string, rank int, score string, reasoning string")
    known = [("A", "0.5", "1.0", "0.2", "0.75", "0.7", "high", "weak_proof_alignment|buzzword_stuffing", "0.05", "0"), ("B", "0.5", "0", "x", None, "0.35", None, "", None, "0.1")]
    names = ("candidate_id", "final_score", "retrieval_ranking_evidence_score", "production_evidence_score", "evidence_confidence_score", "calibrated_hireability_score", "risk_level", "risk_flags", "penalty_score", "calibration_penalty")
    proofs = spark.createDataFrame([("A", ["Python", "SQL"], ["did it"])], "candidate_id string, supported_skills array<string>, snippets array<string>")
    got = {r.candidate_id: r for r in reports.explanation_cards(ranked, spark.createDataFrame(known, " string, ".join(names) + " string"), proofs).collect()}
    a, b = got["A"], got["B"]
    assert a.strengths == ["Career evidence for Python, SQL.", "Retrieval or ranking work is well borne out.", "Confidence in the evidence is above the middle."]
    assert a.risk_notes == ["Risk level: high.", "Flags: weak proof alignment, buzzword stuffing.", "Profile penalty: 0.050."]
    assert a.hireability_notes[0].endswith("interview.") and b.hireability_notes == ["Behaviour or availability is weak.", "Hireability: 0.350."]
    assert b.strengths == ["The query is matched in part; little is borne out."] and b.risk_notes == ["Risk level: low.", "Calibration penalty: 0.100."]
    assert "- did it" in a.card and "| Retrieval and ranking | 1.000 |" in a.card and "- No snippet." in b.card and a.scores["Production"] == 0.2


def test_summary_is_observed_while_writing(spark, tmp_path):
    from tests.test_engine import PEOPLE, SCHEMA

    fp = features.fingerprints(spark.createDataFrame(PEOPLE, SCHEMA))
    got = reports.write_fingerprints(fp, str(tmp_path / "fp"))
    stored = spark.read.parquet(str(tmp_path / "fp"))
    row = reports.profile_summary(stored).first().asDict()
    assert {k: got[k] for k in row} == row
    for name, column in (("top_missing_fields", "missing_fields"), ("top_anomaly_flags", "anomaly_flags")):
        assert list(got[name].items()) == [(r.value, r.n) for r in reports.histogram(stored, column, 15).collect()]
    none = reports.write_fingerprints(features.fingerprints(spark.createDataFrame([], SCHEMA)), str(tmp_path / "none"))
    assert none["n"] == 0 and none["top_missing_fields"] == {} and none["warning"] is None
