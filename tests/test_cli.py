"""The command line end to end on small files."""

import json
import zipfile

import pytest

from tamarack import cli, config
from tamarack.operators import benchmark
from tests.test_engine import PEOPLE

KEYS = ("candidate_id", "current_title", "years_of_experience", "location", "skills", "summary", "career_history", "education", "signals")
SIGNALS = ("recruiter_response_rate", "interview_completion_rate", "last_active_date", "notice_period_days", "open_to_work_flag", "willing_to_relocate")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    with open(folder / "people.jsonl", "w") as f:
        for p in PEOPLE:
            row = dict(zip(KEYS, p, strict=True))
            row["career_history"] = [{"company": c, "description": d} for c, d in p[6] or []]
            row["signals"] = dict(zip(SIGNALS, p[8], strict=True)) if p[8] else None
            f.write(json.dumps({k: v for k, v in row.items() if v is not None}) + "\n")
        f.write("not json\n[1]\n")
    (folder / "job.txt").write_text("\ufeffMust have Python, retrieval, ranking and evaluation (NDCG) in production. Docker preferred.")
    (folder / "settings.yaml").write_text("ranking:\n  top_k: 5\n  score_weights:\n    jd_relevance: 0.25\nhoneypot_firewall:\n  enabled: true\nevidence_calibration:\n  enabled: true  # yes\nbenchmark:\n  min_pass_rate: 0.9\n")
    (folder / "cases.jsonl").write_text("\n".join(json.dumps(c) for c in ({"case": "evidence", "better": "STRONG", "worse": "STUFFER"}, {"case": "empty", "better": "EMPTY", "least": 3}, {"case": "gem", "better": "GEM", "worse": "STUFFER"})))
    return folder


def run(spark, folder, mode, *more):
    common = ["--output", f"{folder}/out", "--config", f"{folder}/settings.yaml", "--query", f"{folder}/job.txt"]
    return cli.main([mode, *common, *more], spark)


def test_modes_in_turn(spark, folder, capsys):
    assert run(spark, folder, "rank") == 2  # nothing was profiled yet
    assert run(spark, folder, "profile-and-rank", "--input", f"{folder}/people.jsonl") == 0
    out = folder / "out"
    summary = json.loads((out / "profiler_summary.json").read_text())
    assert (summary["n"], summary["loader_errors"]) == (8, 2) and "missing_skills" in summary["top_anomaly_flags"]
    assert json.loads((out / "validation.json").read_text()) == {"valid": True, "errors": []}
    assert json.loads((out / "risk_audit.json").read_text())["n"] == 8
    assert run(spark, folder, "validate") == 0
    assert run(spark, folder, "audit") == run(spark, folder, "explain") == run(spark, folder, "benchmark", "--cases", f"{folder}/cases.jsonl") == 0
    assert (out / "explanation_cards.md").read_text().startswith("## 1. STRONG")
    assert run(spark, folder, "profile-runtime") == run(spark, folder, "ablation") == 0
    runtime = json.loads((out / "runtime_profile.json").read_text())
    assert runtime["rows"] == 8 and runtime["peak_memory"]["driver_heap_mb"] > 0 and runtime["peak_memory"]["samples"] >= 2
    card = (out / "explanation_cards.md").read_text()
    assert "**Strengths**" in card and "Risk level: low." in card and "| Proof alignment | " in card
    assert set(json.loads((out / "ablation.json").read_text())) == {"keyword_only", "baseline", "plus_firewall", "plus_firewall_plus_calibration"}
    assert run(spark, folder, "rank", "--top-k", "3", "--no-risk", "--no-calibrate") == 0
    assert run(spark, folder, "validate") == 1  # three rows where the settings want five
    capsys.readouterr()
    assert run(spark, folder, "demo", "--input", f"{folder}/people.jsonl", "--loose", "--top-k", "3", "--risk-pool", "6", "--calibration-pool", "4", "--strict-top-n", "1") == 0
    told = capsys.readouterr().out
    assert told.startswith("valid\n1. STRONG: ") and "\n3. " in told and "\n4. " not in told
    assert {p["path"] for p in json.loads((out / "demo" / "schema_report.json").read_text())["paths"]} >= {"candidate_id", "career_history.description", "signals.open_to_work_flag"}
    assert run(spark, folder, "digest") == 0
    assert "content_sha256" in capsys.readouterr().out
    assert run(spark, folder, "package") == 0
    with zipfile.ZipFile(out / "package.zip") as z:
        names = z.namelist()
    assert "manifest.json" in names and "explanation_cards.md" in names and any(n.startswith("ranked/") for n in names)


def test_yaml_without_a_library(folder):
    text = "a: 1\nb:\n  c: 'x y'  # why\n  d: [1, 2.5, true]\n  e:\n    f: null\nlist:\n  - p\n  - 2\n# end\n"
    assert config.parse(text) == {"a": 1, "b": {"c": "x y", "d": [1, 2.5, True], "e": {"f": None}}, "list": ["p", 2]}
    own = (folder / "settings.yaml").read_text()
    assert config.parse(own) == config.load(str(folder / "settings.yaml"))
    s = config.settings(config.parse(own))
    assert (s.top_k, s.firewall.max_penalty, s.calibration_pool) == (5, 0.5, 700)
    assert config.settings({}).firewall is None and config.load(None) == {}


def test_absent_ids_rank_last(spark):
    ranked = spark.createDataFrame([("a", 1), ("b", 2)], "candidate_id string, rank int")
    cases = spark.createDataFrame([("x", "a", "b", None), ("y", "c", "b", None), ("z", "c", None, 3), ("w", "a", None, 3)], "case string, better string, worse string, least int")
    checked = benchmark.check_orders(ranked, cases)
    assert {r.case: (r.better_rank, r.passed) for r in checked.collect()} == {"x": (1, True), "y": (99, False), "z": (99, True), "w": (1, False)}
    assert tuple(benchmark.pass_rate(checked).first()) == (0.5, False)
