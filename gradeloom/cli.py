"""Command line: new weeks, expansion of submissions, scoring and summaries.

    python -m gradeloom.cli new-week --root DIR WEEK [--force] [--dry-run]
    python -m gradeloom.cli preprocess --root DIR WEEK [--reprocess] [--max-workers N]
    python -m gradeloom.cli grade --root DIR WEEK --client module:factory --subject FILE [--regrade] [--answer-key FILE] [--max-workers N]
"""

from __future__ import annotations

import argparse
import importlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import verdicts as V
from gradeloom.operators import decisions, scoring
from gradeloom.session import build_session, ship_code
from gradeloom.sources import archives, files
from gradeloom.sources.settings import Workspace, choose_assignment, env_of, resolve_key, safe_week

#: What a run writes: reports by student, their parsed form, and the summary.
REPORTS, PARSED, SUMMARY = "reports", "parsed", "summary"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def stored(spark: SparkSession, path: Path, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(str(path)) if path.exists() and any(path.rglob("*.parquet")) else empty(spark, schema)


def kept(outcomes: DataFrame, space: Workspace, name: str) -> DataFrame:
    """The outcomes as a table, which a lost executor can't change."""
    path = str(space.results / "outcomes" / name)
    outcomes.write.mode("overwrite").parquet(path)
    return outcomes.sparkSession.read.schema(outcomes.schema).parquet(path)


def preprocess(spark: SparkSession, space: Workspace, reprocess: bool = False, rasterise=None, transcode=None) -> DataFrame:
    """Expand the week's archives into pages and write them with the summary; returns the outcomes."""
    have = stored(spark, space.pages, "student_id string, page_no int")
    found = archives.read_archives(spark, str(space.raw))
    outcomes, pages = archives.preprocess(found, have, reprocess, rasterise, transcode)
    outcomes = kept(outcomes, space, "preprocess")  # decided before the pages that it looks at are written over
    files.write_pages(pages, str(space.pages))
    write_summary(outcomes.withColumn("line", decisions.preprocess_line(F.col("student_id"), F.col("detail"))), space, "preprocess_summary")
    return outcomes


def grade(spark: SparkSession, space: Workspace, subject: dict[str, str], answer: str, client, regrade: bool = False, workers: int = 4) -> DataFrame:
    """Score the students that need it, write their reports, their parsed form and the summary; returns the outcomes."""
    results, schema = space.results, "student_id string, body string"
    pages = stored(spark, space.pages, "student_id string, page_no int, content binary")
    old = stored(spark, results / REPORTS, schema)
    students = scoring.usable_pages(pages)
    decided = students.join(old, "student_id", "left").withColumn("action", decisions.grading_action(F.col("body"), regrade))
    todo = scoring.build_prompts(decided.where("action <> 'skip'").select("student_id", "pages"), subject["prompt_template"], subject, answer)
    # The only stage whose tasks are bounded by what the model's service takes.
    scored = scoring.score(todo.repartition(workers), client)
    fresh = results / f"{REPORTS}.new"
    scoring.with_failure_reports(scored).write.mode("overwrite").parquet(str(fresh))  # a call can't be repeated
    scored = spark.read.parquet(str(fresh))
    skipped = decided.where("action = 'skip'").select("student_id", F.lit("skipped").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))
    outcomes = scored.select("student_id", "status", "attempts", "error").unionByName(skipped)
    outcomes = kept(outcomes, space, "grade")
    scored.select("student_id", "body").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("student_id").parquet(str(results / REPORTS))
    parsed = V.parse_reports(stored(spark, results / REPORTS, schema), "body", V.read_format(subject["output_format"]))
    parsed.select("student_id", files.payload_column(F.concat("student_id", F.lit(".txt"))).alias("payload")).write.mode("overwrite").parquet(str(results / PARSED))
    write_summary(outcomes.withColumn("line", decisions.grading_line(F.col("student_id"), F.col("error"))), space, "grading_summary")
    return outcomes


def grade_one(spark: SparkSession, student: str, images: list[bytes], subject: dict[str, str], answer: str, client) -> tuple[bool, str]:
    """Whether one student's pages could be scored, and the report, also if they couldn't."""
    pages = spark.createDataFrame([(student, i, x) for i, x in enumerate(images, 1)], "student_id string, page_no int, content binary")
    prompts = scoring.build_prompts(scoring.usable_pages(pages).select("student_id", "pages"), subject["prompt_template"], subject, answer)
    row = scoring.with_failure_reports(scoring.score(prompts, client)).first()
    return row.status == "success", row.body


def chosen_week(root: Path, week: str | None, assignment: str | None) -> str:
    """The week that is named, that of the assignment that is, or that of the only assignment there is."""
    if week:
        return week
    found = choose_assignment([str(p) for p in sorted(root.glob("*/assignment.json"))], assignment)
    return json.loads(Path(found).read_text(encoding="utf-8"))["week_name"]


def write_summary(outcomes: DataFrame, space: Workspace, name: str) -> None:
    rows = outcomes.withColumn("week", F.lit(space.week))
    summary = decisions.summary_text(rows, "week", "student_id", "status", F.col("line"))
    none = outcomes.sparkSession.createDataFrame([("\n".join([*(f"{k}：{v}" for k, v in zip(decisions.SUMMARY_LABELS, (space.week, 0, 0, 0, 0), strict=True)), f"{decisions.FAILED_STUDENTS}：", decisions.NONE_LINE, ""]),)], "summary string")
    files.write_summary(none if outcomes.isEmpty() else summary, str(space.results / SUMMARY / name))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gradeloom", description=__doc__.splitlines()[0])
    sub = parser.add_subparsers(dest="command", required=True)
    commands = {name: sub.add_parser(name) for name in ("new-week", "preprocess", "grade", "grade-one")}
    for name, p in commands.items():
        if name == "new-week":
            p.add_argument("week")
        else:
            p.add_argument("week", nargs="?")
            p.add_argument("--assignment", help="its configuration; neither is needed where there is one assignment")
        p.add_argument("--root", type=Path, default=Path("."))
        p.add_argument("--max-workers", type=int, default=4)
    commands["new-week"].add_argument("--force", action="store_true")
    commands["new-week"].add_argument("--dry-run", action="store_true")
    commands["preprocess"].add_argument("--reprocess", action="store_true")
    commands["grade"].add_argument("--regrade", "--retry-failed", dest="regrade", action="store_true")
    for name in ("grade", "grade-one"):
        commands[name].add_argument("--answer-key", "--tex", dest="answer_key", type=Path)
        commands[name].add_argument("--client", required=True, help="module:factory of the model's client")
        commands[name].add_argument("--subject", type=Path, required=True)
    commands["grade-one"].add_argument("--student", required=True)
    commands["grade-one"].add_argument("--images", nargs="+", type=Path, required=True)
    a = parser.parse_args(args)
    if a.max_workers < 1:
        parser.error("--max-workers must be 1 or more")
    if a.command == "new-week":
        print("\n".join(Workspace(a.root, a.week).create(a.force, a.dry_run)))
        return 0
    try:
        week = chosen_week(a.root, a.week, a.assignment)
    except (ValueError, KeyError, OSError) as e:
        parser.error(f"no assignment to work on: {e}")
    space = Workspace(a.root, week)
    if not (a.root / safe_week(week)).is_dir():
        parser.error(f"there is no week {week}")
    spark = build_session()
    ship_code(spark)
    if a.command == "preprocess":
        outcomes = preprocess(spark, space, a.reprocess)
    else:
        subject = json.loads(a.subject.read_text(encoding="utf-8"))
        local = a.root / ".env"
        key, source = resolve_key(subject.get("api_key_env", ""), env_of(local.read_text(encoding="utf-8")) if local.exists() else {})
        if key is None:
            parser.error(f"no key for the model ({source})")
        module, _, factory = a.client.partition(":")
        answer, client = (a.answer_key or space.answer).read_text(encoding="utf-8"), getattr(importlib.import_module(module), factory)
        if a.command == "grade-one":
            good, report = grade_one(spark, a.student, [p.read_bytes() for p in a.images], subject, answer, client)
            print(report)
            return 0 if good else 1
        outcomes = grade(spark, space, subject, answer, client, a.regrade, a.max_workers)
    for row in outcomes.groupBy("status").count().orderBy("status").collect():
        print(row["status"], row["count"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
