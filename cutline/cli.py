"""Command line over the plans: ``spark-submit -m`` or ``python -m cutline <command>``.

Exit codes are a release gate's: 0 clear, 2 unknown or refused, 3 blocked.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cutline.functions.verdict import audit_cases
from cutline.operators.contract import ContractError
from cutline.operators.corpus import scan_corpus, scan_summary, verify_queries
from cutline.operators.evidence import publish
from cutline.operators.lineage import column_path
from cutline.plans.audit import AuditConfig, bundle_rows, run_audit, run_record
from cutline.plans.replay import drift, replay
from cutline.plans.scenario import load_scenario
from cutline.plans.sweep import flagged, sweep
from cutline.plans.validate import validate
from cutline.sources.cases import read_cases, read_edges
from cutline.sources.corpus import read_sql_corpus
from cutline.sources.history import record_runs

# A terminal report names this many findings; the full table goes to --output.
SHOWN = 50


def _validate(spark, args):
    report = validate(load_scenario(spark, args.scenario))
    return report, report["exit_code"]


def _sweep(spark, args):
    ranked = sweep(load_scenario(spark, args.scenario))
    names = [row["feature"] for row in flagged(ranked).collect()]
    report = {
        "ranked_by": "advantage_lost",
        "flagged": names,
        "findings": [row.asDict() for row in ranked.collect()],
    }
    return report, 3 if names else 0


def _scan(spark, args):
    scanned = scan_corpus(
        read_sql_corpus(spark, args.path), args.post_outcome_table, args.available, args.prediction
    ).drop("sql")
    if args.table:
        scanned.write.mode("overwrite").parquet(args.table)
    report = scan_summary(scanned).first().asDict()
    worst = scanned.where(F.col("status").isin("violation", "indeterminate"))
    first = worst.orderBy(F.col("status") != "violation", "path").limit(SHOWN)
    report["first_findings"] = [row.asDict() for row in first.collect()]
    return report, report["exit_code"]


def _verify(spark, args):
    corpus = read_sql_corpus(spark, args.path)
    row = verify_queries(corpus, args.post_outcome_table, args.available, args.prediction).drop("sql").first()
    if row is None:
        raise ContractError(f"not found: {args.path}")
    # For one query, not reading the source at all is as good as a cutoff.
    report = row.asDict()
    return report, report["exit_code"]


def _cases(spark, args):
    judged = audit_cases(read_cases(spark, args.path))
    if args.table:
        judged.write.mode("overwrite").parquet(args.table)
    counts = judged.groupBy("verdict", "exit_code").agg(F.count(F.lit(1)).alias("cases"))
    report = {"verdicts": [row.asDict() for row in counts.orderBy("verdict").collect()]}
    return report, max((row["exit_code"] for row in report["verdicts"]), default=2)


def _audit(spark, args):
    bundle = run_audit(spark, AuditConfig.load(args.audit, args.root))
    if args.runs:
        record_runs(run_record(spark, bundle), args.runs)
    return bundle, bundle["exit_code"]


def _publish(spark, args):
    config = AuditConfig.load(args.audit, args.root)
    bundle = run_audit(spark, config)
    rows = bundle_rows(spark, bundle, args.target_urn, spark.read.parquet(args.assets))
    report = publish(rows, args.store, approved=args.approve).first().asDict()
    if args.runs:
        record_runs(run_record(spark, bundle, report["mutation_performed"]), args.runs)
    return report, 0 if report["status"] == "published" else 2


def _trace(spark, args):
    pair = spark.createDataFrame([(args.source, args.target)], "source string, target string")
    report = column_path(read_edges(spark, args.edges), pair).first().asDict()
    code = 2 if not report["available"] else 3 if report["found"] else 0
    return report, code


def _replay(spark, args):
    report = replay(spark, args.fixture, args.post_outcome_table, args.errors)
    return report, report["exit_code"]


def _drift(spark, args):
    report = drift(
        spark,
        args.fixture,
        args.post_outcome_table,
        spark.read.parquet(args.assets),
        spark.read.parquet(args.lineage),
        args.target_urn,
    )
    return report, 0 if report["status"] == "passed" else 2


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cutline")
    top.add_argument("--output", help="write the report here as JSON")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, text: str, *required: str, **optional) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=text)
        sub.set_defaults(run=run)
        for option in required:
            sub.add_argument(option, **({"required": True} if option.startswith("--") else {}))
        for option, default in optional.items():
            sub.add_argument(f"--{option.replace('_', '-')}", default=default)
        return sub

    clocks = {"available": "available_at", "prediction": "prediction_time"}
    command("validate", _validate, "rebuild one feature and re-test it", "--scenario")
    command("sweep", _sweep, "rank every candidate column of a wide history", "--scenario")
    scan = command("scan", _scan, "scan a folder of SQL for missing cutoffs", "path", table=None, **clocks)
    scan.add_argument("--post-outcome-table", action="append", required=True)
    command("verify", _verify, "check the cutoff of one SQL file", "path", "--post-outcome-table", **clocks)
    command("cases", _cases, "judge JSON audit cases", "path", table=None)
    command("audit", _audit, "run an audit file", "--audit", root=None, runs=None)
    published = command(
        "publish", _publish, "publish an audit, once approved",
        "--audit", "--target-urn", "--store", "--assets", root=None, runs=None,
    )
    published.add_argument("--approve", action="store_true")
    command("trace", _trace, "find the directed path between two columns", "--edges", "--source", "--target")
    replayed = command("replay", _replay, "replay a recorded fixture", "--fixture", "--post-outcome-table")
    replayed.add_argument("--errors", help="where the whole table of damaged files goes")
    command(
        "drift", _drift, "compare a fixture with a catalog export",
        "--fixture", "--post-outcome-table", "--assets", "--lineage", "--target-urn",
    )
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or (
        SparkSession.builder.appName("cutline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    try:
        report, code = args.run(spark, args)
    except (ContractError, json.JSONDecodeError, KeyError, OSError, TypeError, ValueError) as error:
        report, code = {"status": "invalid_input", "error": str(error)}, 2
    text = json.dumps(report, indent=2, default=str)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as handle:
            handle.write(text + "\n")
    print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
