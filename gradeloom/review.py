"""What a review front end asks for: weeks, students, one student's report, edits, tasks and logs.

Each function stands for one request and returns a DataFrame; serving them is left to the front end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.functions import verdicts as V
from gradeloom.operators import decisions, ordered
from gradeloom.streaming import logs


def weeks(configs: DataFrame, folders: DataFrame) -> DataFrame:
    """Weeks by age; one whose configuration can't be read has its defaults. folders: week, created_at."""
    joined = folders.join(configs.select(F.col("assignment_id").alias("week"), "week_name", "subject_config"), "week", "left")
    return joined.select("week", F.coalesce("week_name", "week").alias("name"), F.coalesce("subject_config", F.lit("")).alias("subject_config"), "created_at")


def students(pages: DataFrame, texts: DataFrame, payloads: DataFrame, keyword: str = "") -> DataFrame:
    """Students with pages: how many, and whether a result is there as data or as text."""
    counted = pages.groupBy("student_id").agg(F.count(F.lit(1)).alias("page_count"))
    some = lambda frame, column, name: frame.where(F.octet_length(column) > 0).select("student_id", F.lit(True).alias(name))
    joined = counted.join(some(texts, "body", "t"), "student_id", "left").join(some(payloads, "payload", "p"), "student_id", "left")
    rows = joined.select("student_id", "page_count", (F.coalesce("t", F.lit(False)) | F.coalesce("p", F.lit(False))).alias("has_result"), F.lit(False).alias("has_export_image"))
    wanted = keyword.strip().lower()
    return rows.where(F.lower("student_id").contains(wanted)) if wanted else rows


def student(pages: DataFrame, results: DataFrame, student_id: str) -> DataFrame:
    """One student's page addresses and report. results is what sources.files.load_results gives."""
    own = F.col("student_id") == student_id
    numbers = pages.where(own).agg(F.array_sort(F.collect_list("page_no")).alias("n"))
    images = F.transform("n", lambda n: F.concat(F.lit("/images/"), T.url_part(F.lit(student_id)), F.lit("/page_"), n.cast("string"), F.lit(".png")))
    report = results.where(own).select(F.struct("student_name_or_id", "overall", "modules", "error_details_by_question", "proof_review_by_question").alias("report")).limit(1)
    return numbers.select(F.lit(student_id).alias("student_id"), images.alias("images")).join(report, F.lit(True), "left")


def save(texts: DataFrame, edits: DataFrame, fmt: V.ReportFormat) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edits (student_id, payload, rendered, version) over the stored texts (student_id, body).

    Returns the new texts, the new payloads of the edited students, and the requests to render them anew,
    which are urgent. An edit's own text wins; without one its payload is written out.
    """
    payload = F.from_json("payload", V.PAYLOAD)
    entries = F.transform(F.map_entries(payload["modules"]), lambda e: F.struct(e["key"].alias("title"), e["value"]["raw_text"].alias("raw_text"), e["value"]["items"].alias("items")))
    rendered = V.render_report(payload["student_name_or_id"], payload["overall"], F.coalesce(entries, F.array().cast("array<struct<title:string,raw_text:string,items:array<string>>>")))
    last = ordered.latest(edits.where("student_id IS NOT NULL"), ["student_id"], [F.desc("version")])
    last = last.withColumn("body", F.coalesce("rendered", rendered))
    new = ordered.upsert(texts.select("student_id", "body", F.lit(0).alias("version")), last.select("student_id", "body", "version"), ["student_id"], ["version"]).drop("version")
    from gradeloom.sources.files import payload_column

    stored = V.enriched(last, "payload", "body", fmt).select("student_id", payload_column(F.concat("student_id", F.lit(".txt"))).alias("payload"))
    requests = last.select("student_id", F.lit("request").alias("kind"), F.lit(True).alias("urgent"))
    return new, stored, requests


def edited(old: DataFrame, new: DataFrame) -> DataFrame:
    """Students whose payload says something else than before, to a reader."""
    sign = lambda frame: frame.select("student_id", V.payload_signature(F.col("payload")).alias("signature"))
    return ordered.changed(sign(old), sign(new), "student_id", "signature").select("student_id")


def tasks(events: DataFrame) -> DataFrame:
    """The latest task of each kind and week, with its label."""
    rows = logs.latest_tasks(events)
    return rows.withColumn("label", decisions.task_label(F.col("status"), F.col("error"), F.col("returnCode")))


def task(events: DataFrame, task_id: str) -> DataFrame:
    """One task by its id; no row if there is none."""
    return events.where(F.col("taskId") == task_id).limit(1)


def task_log(lines: DataFrame, task_id: str, since: int = 0, limit: int = 60) -> DataFrame:
    """A page of one task's log, with the log's length. lines: taskId, line_no, line."""
    own = lines.where(F.col("taskId") == task_id).withColumnRenamed("line_no", "n")
    return ordered.page(own, ["taskId"], ["n"], since, limit).select("line_no", "line", "total")


def export_status(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Shown status of each student's export. records: the machine's state; sources: student_id, source_at."""
    joined = sources.join(records, "student_id", "full")
    status = decisions.export_status(F.col("status"), F.col("source_at").isNotNull(), F.col("text"), F.col("cached_at"), F.col("source_at"))
    return joined.select("student_id", status.alias("status")).select("student_id", "status", *decisions.status_flags(F.col("status")))
