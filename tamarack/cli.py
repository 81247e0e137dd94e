"""The command line: python -m tamarack MODE ... (see --help).

Exit codes: 0 if all went well, 1 if a validation failed, 2 if an input is missing.
"""

from __future__ import annotations

import argparse
import io
import json
import sys
import time
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack import config as settings_file
from tamarack.memory import Sampler
from tamarack.operators import benchmark, features, query, ranking, reports, rules, validators, variants
from tamarack.sources import loose, readers

FINGERPRINTS = "fingerprints.parquet"
#: Rows that a runtime is projected to.
PROJECTED = 100_000


class Missing(Exception):
    """An input that isn't there."""


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tamarack", description=__doc__.splitlines()[0])
    p.add_argument("mode", choices=sorted(MODES))
    p.add_argument("--input", help="records: .csv, .json, .jsonl or .parquet")
    p.add_argument("--query", help="a file with the query document")
    p.add_argument("--output", default="output", help="the folder of fingerprints and reports")
    p.add_argument("--fingerprints", help="stored fingerprints; by default those in the output folder")
    p.add_argument("--config", help="a YAML file")
    p.add_argument("--cases", help="a JSON Lines file of ordering cases (case, better, worse, least)")
    p.add_argument("--top-k", type=int)
    p.add_argument("--limit", type=int, help="valid records to read")
    p.add_argument("--risk", action=argparse.BooleanOptionalAction, default=None, help="risk rules, over what the config says")
    p.add_argument("--calibrate", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--strict-pool", type=int, help="rows that the strict pass reworks")
    p.add_argument("--strict-top-n", type=int, help="safe rows that come before all others")
    p.add_argument("--risk-pool", type=int, help="rows that the deep risk rules see")
    p.add_argument("--calibration-pool", type=int, help="rows that are calibrated")
    p.add_argument("--top-n", type=int, help="cards of explain, 10 by default")
    p.add_argument("--batch-rows", type=int, help="rows that are read from Parquet at a time")
    p.add_argument("--loose", action="store_true", help="walk each record by itself, without a schema of all")
    p.add_argument("--master", help="the Spark master, where none is set")
    return p


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Run:
    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args = spark, args
        self.config = settings_file.load(args.config)
        self.store = args.fingerprints or f"{args.output}/{FINGERPRINTS}"

    def need(self, path: str | None, what: str) -> str:
        if not path or not exists(self.spark, path):
            raise Missing(f"{what} is missing: {path or 'no path given'}")
        return path

    def fingerprints(self) -> DataFrame:
        found, self.errors = readers.read_fingerprints(self.spark, self.need(self.store, "the table of fingerprints"))
        return found

    def query(self) -> query.Query:
        text = self.spark.read.text(self.need(self.args.query, "the query document"), wholetext=True).first()
        return query.parse((text["value"] if text else "").lstrip("\ufeff"))

    def settings(self, **changes) -> ranking.Settings:
        own = {k: getattr(self.args, k) for k in ("top_k", "risk", "calibrate", "strict_pool", "strict_top_n", "risk_pool", "calibration_pool")}
        return settings_file.settings(self.config, **(own | changes))

    def write(self, name: str, value) -> None:
        reports.write_json(self.spark, f"{self.args.output}/{name}.json", value)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.csv(self.need(f"{self.args.output}/{name}", f"the {name} table"), header=True, multiLine=True, escape='"')


def profile(run: Run) -> int:
    path = run.need(run.args.input, "the input")
    if run.args.batch_rows:
        run.spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", run.args.batch_rows)
    if run.args.loose:
        records = loose.read_records(run.spark, path, run.args.limit)
        schema = {"total_records": records.count(), "paths": loose.inspect(records).collect(), "format": readers.detect_format(path), "malformed": readers.count_errors(run.spark, path)}
    else:
        records = readers.read_records(run.spark, path, run.args.limit)
        schema = readers.inspect_schema(records, path)
    most = int(run.config.get("max_text_length_per_candidate", features.MAX_TEXT))
    summary = reports.write_fingerprints(features.fingerprints(records, max_text=most), run.store)
    run.write("schema_report", schema)
    run.write("profiler_summary", {**summary, "loader_errors": schema["malformed"]})
    return 0


def rank(run: Run) -> int:
    fingerprints, wanted, s = run.fingerprints(), run.query(), run.settings()
    ranked = ranking.rank_profiles(fingerprints, wanted, s).persist()  # top_k rows
    reports.write_outputs(ranked, run.args.output)
    if s.firewall:
        reports.write_audit(reports.audit(fingerprints, s.firewall), run.args.output, ranked)
    if s.calibration is not None:
        reports.write_calibration(ranked, query.constraints(wanted), run.args.output)
    ranked.unpersist()
    return _validated(run, min(s.top_k, fingerprints.limit(s.top_k).count()), s)


def _validated(run: Run, rows: int, s: ranking.Settings) -> int:
    wrong = validators.validate(run.table("ranked"), rows, breakdown=run.table("breakdown") if s.firewall else None, calibrated=s.calibration is not None)
    run.write("validation", {"valid": not wrong, "errors": wrong})
    print("\n".join(wrong) or "valid")
    return 1 if wrong else 0


def profile_and_rank(run: Run) -> int:
    run.need(run.args.query, "the query document")
    return profile(run) or rank(run)


def demo(run: Run) -> int:
    """Profiles and ranks an input with all stages on, in the output folder's demo, and prints the first rows."""
    run.args.output = f"{run.args.output}/demo"
    run.store = f"{run.args.output}/{FINGERPRINTS}"
    run.args.risk = run.args.calibrate = True
    run.args.top_k = run.args.top_k or 5
    code = profile_and_rank(run)
    for row in run.table("ranked").orderBy(F.col("rank").cast("int")).limit(5).collect():
        print(f"{row['rank']}. {row['candidate_id']}: {float(row['score']):.4f}")
    return code


def audit(run: Run) -> int:
    reports.write_audit(reports.audit(run.fingerprints(), settings_file.firewall(run.config)), run.args.output)
    return 0


def _compared(run: Run, how, name: str) -> int:
    s = run.settings(risk=True, calibrate=True)
    rows = how(run.fingerprints(), run.query(), s).orderBy("variant")
    rows.coalesce(1).write.mode("overwrite").csv(f"{run.args.output}/{name}", header=True)
    run.write(name, {r["variant"]: r for r in rows.collect()})
    return 0


def ablation(run: Run) -> int:
    return _compared(run, variants.ablation, "ablation")


def sensitivity(run: Run) -> int:
    return _compared(run, variants.sensitivity, "weight_sensitivity")


def validate(run: Run) -> int:
    own = run.config.get("submission_safety") or {}
    s = run.settings()
    expected = [n for n in ("proofs", "risk_audit.json" if s.firewall else "proofs", "calibration_report.json" if s.calibration is not None else "proofs") if not exists(run.spark, f"{run.args.output}/{n}")]
    told = validators.safety(
        run.table("ranked"), run.table("breakdown"), rows=s.top_k, least_reasoning=int(own.get("min_reasoning_chars", 40)), most_severe=int(own.get("max_top10_severe_risk", 0)),
        flat=float(own.get("warn_if_all_scores_within", 0.02)), files=tuple(dict.fromkeys(expected)),
    )
    run.write("safety", told)
    print("\n".join([*told["blocking_errors"], *told["warnings"]]) or "passed")
    return 0 if told["passed"] else 1


def check_cases(run: Run) -> int:
    cases = run.spark.read.schema("case string, better string, worse string, least int").json(run.need(run.args.cases, "the cases"))
    fingerprints = run.fingerprints()
    ranked = ranking.rank_profiles(fingerprints, run.query(), run.settings(risk=True, calibrate=True)).select("candidate_id", "rank")
    checked = benchmark.check_orders(ranked, cases)
    told = benchmark.pass_rate(checked, float((run.config.get("benchmark") or {}).get("min_pass_rate", 0.75))).first()
    run.write("benchmark", {**told.asDict(), "cases": checked.collect()})
    return 0 if told["passed"] else 1


def profile_runtime(run: Run) -> int:
    """Times a ranking of stored fingerprints, and projects it."""
    fingerprints, wanted, s = run.fingerprints(), run.query(), run.settings(risk=True, calibrate=True)
    n, began = fingerprints.count(), time.perf_counter()
    with Sampler(run.spark) as memory:
        ranking.rank_profiles(fingerprints, wanted, s).write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - began
    projected = seconds * PROJECTED / n if n else None
    most = float((run.config.get("runtime_profile") or {}).get("warn_if_projected_ranking_seconds_above", 300))
    warnings = [f"{PROJECTED} rows are projected to take more than {most:.0f} s"] if projected and projected > most else []
    run.write("runtime_profile", {
        "rows": n, "ranking_seconds": round(seconds, 4), "rows_a_second": round(n / seconds, 1), f"projected_seconds_{PROJECTED}": projected and round(projected, 2), "warnings": warnings,
        "peak_memory": memory.peaks(), "master": run.spark.sparkContext.master, "spark": run.spark.version, "python": sys.version.split()[0],
    })
    return 0


def explain(run: Run) -> int:
    proofs = run.spark.read.json(run.need(f"{run.args.output}/proofs", "the proofs"))
    cards = reports.explanation_cards(run.table("ranked"), run.table("breakdown"), proofs, run.args.top_n or 10).orderBy("rank").collect()
    run.write("explanation_cards", cards)
    reports.write_text(run.spark, f"{run.args.output}/explanation_cards.md", "\n\n".join(c["card"] for c in cards) + "\n")
    return 0


def _files(run: Run) -> DataFrame:
    """The output folder's files but for stored fingerprints, with their digests."""
    files = run.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(run.need(run.args.output, "the output folder"))
    return reports.digest(files.where("NOT path RLIKE '[.](crc|parquet|zip)$' AND NOT path RLIKE '/_SUCCESS$'"), "content").orderBy("path")


def digest(run: Run) -> int:
    """The SHA-256 of every output file."""
    print(json.dumps(reports.plain(_files(run).select("path", "length", "content_sha256").collect()), indent=2))
    return 0


def package(run: Run) -> int:
    """A ZIP of the ranked table, its breakdown, proofs and reports, with a manifest; the tables have top_k rows."""
    run.need(f"{run.args.output}/ranked", "the ranked table")
    root = run.spark._jvm.org.apache.hadoop.fs.Path(run.args.output).toUri().getPath().rstrip("/") + "/"
    rows = _files(run).where("NOT path RLIKE '/risk_flags/'").collect()
    listed = [{"name": r["path"].split(root, 1)[-1], "bytes": r["length"], "sha256": r["content_sha256"]} for r in rows]
    manifest = {"files": listed, "config": run.config, "spark": run.spark.version, "python": sys.version.split()[0]}
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for r, told in zip(rows, listed, strict=True):
            z.writestr(zipfile.ZipInfo(told["name"]), bytes(r["content"]))
        z.writestr(zipfile.ZipInfo("manifest.json"), json.dumps(reports.plain(manifest), indent=2))
    reports.write_bytes(run.spark, f"{run.args.output}/package.zip", held.getvalue())
    return 0


MODES = {
    "profile": profile, "rank": rank, "profile-and-rank": profile_and_rank, "demo": demo, "audit": audit, "ablation": ablation, "sensitivity": sensitivity, "validate": validate, "benchmark": check_cases,
    "profile-runtime": profile_runtime, "explain": explain, "digest": digest, "package": package,
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments().parse_args(argv)
    if spark is None:
        builder = SparkSession.builder.appName("tamarack").config("spark.sql.session.timeZone", "UTC")
        spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    try:
        return MODES[args.mode](Run(spark, args))
    except Missing as e:
        print(e, file=sys.stderr)
        return 2
