"""What to do with submissions, and what came of it: decisions, summaries and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.verdicts import NEEDS_REVIEW

#: Texts of summaries.
NO_DETAIL, NONE_LINE = "处理失败", "- 无"
NO_INPUT = "未识别到可处理的 PDF 或图片文件"
NO_PAGES = "未找到符合 page_*.png 的标准化图片"
SUMMARY_LABELS = ("周目录", "总学生数", "成功数", "失败数", "跳过数")
FAILED_STUDENTS = "失败学生列表"
NOT_RUN, RUNNING, SUCCEEDED, FAILED = "未运行", "运行中", "成功", "失败"


def grading_action(result: Column, regrade: bool = False) -> Column:
    """run, regrade, retry or skip for the text of an earlier result; absent and empty ones are run.

    A text of blanks alone counts as a result.
    """
    there = F.coalesce(F.length(result), F.lit(0)) > 0
    kept = F.when(result.contains(NEEDS_REVIEW), "retry").otherwise("skip")
    return F.when(~there, "run").when(F.lit(regrade), "regrade").otherwise(kept)


def preprocess_action(pages: Column, reprocess: bool = False) -> Column:
    return F.when((F.coalesce(pages, F.lit(0)) > 0) & ~F.lit(reprocess), "skip").otherwise("run")


def preprocess_outcome(action: Column, old_pages: Column, candidates: Column, new_pages: Column, error: Column) -> Column:
    """status, page_count and detail of a submission after expansion."""
    row = lambda status, pages, detail: F.struct(F.lit(status).alias("status"), pages.cast("int").alias("page_count"), detail.cast("string").alias("detail"))
    none = F.lit(None)
    return (
        F.when(action == "skip", row("skipped", F.coalesce(old_pages, F.lit(0)), none))
        .when(F.coalesce(candidates, F.lit(0)) == 0, row("failed", F.lit(0), F.lit(NO_INPUT)))
        .when(error.isNotNull() | (F.coalesce(new_pages, F.lit(0)) == 0), row("failed", F.lit(0), error))
        .otherwise(row("success", new_pages, none))
    )


def preprocess_line(student: Column, detail: Column) -> Column:
    """A failure in the summary of expansion; without detail it says that processing failed."""
    return F.concat(F.lit("- "), student, F.lit(": "), F.coalesce(F.nullif(detail, F.lit("")), F.lit(NO_DETAIL)))


def grading_line(student: Column, error: Column) -> Column:
    """A failure in the summary of grading; without an error it is the name alone."""
    return F.concat(F.lit("- "), student, F.coalesce(F.concat(F.lit(": "), F.nullif(error, F.lit(""))), F.lit("")))


def status_counts(status: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "success").alias("succeeded"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "skipped").alias("skipped"),
    ]


def summary_text(outcomes: DataFrame, week: str, student: str, status: str, line: Column) -> DataFrame:
    """The report of each week: counts, and a line for each failure in the order of students.

    The lines of failures are what is asked for, so a week's report is as long as its failures are many.
    """
    failed = F.col(status) == "failed"
    lines = F.array_sort(F.collect_list(F.when(failed, F.struct(F.col(student).cast("string").alias("s"), line.alias("line")))))
    one = outcomes.groupBy(week).agg(*status_counts(F.col(status)), lines.alias("__lines"))
    shown = F.when(F.size("__lines") == 0, F.lit(NONE_LINE)).otherwise(F.array_join(F.transform("__lines", lambda x: x["line"]), "\n"))
    text = F.concat_ws("\n", *(
        F.concat(F.lit(f"{label}："), F.col(value).cast("string")) for label, value in zip(SUMMARY_LABELS, (week, "total", "succeeded", "failed", "skipped"), strict=True)
    ), F.lit(f"{FAILED_STUDENTS}："), shown)
    return one.select(week, F.concat(text, F.lit("\n")).alias("summary"))


def empty_summary(spark, week: str) -> DataFrame:
    """The report of a week that had no submissions."""
    rows = spark.createDataFrame([], "week string, student string, status string, line string")
    counts = rows.agg(*status_counts(F.col("status")))
    return counts.select(F.lit(week).alias("week"), "total", "succeeded", "failed", "skipped")


def json_counts(results: DataFrame, week: str, text: str, parsed_ok: Column) -> DataFrame:
    """How many results became structured and how many did not; an empty text counts as failed."""
    ok = (F.coalesce(F.length(text), F.lit(0)) > 0) & parsed_ok
    return results.groupBy(week).agg(F.count_if(ok).alias("ok"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"))


def first_missing(required: list[str]) -> Column:
    """The first of the fields that is null or blank; null if all are there."""
    from gradeloom.functions.text import strip

    return F.coalesce(*(F.when(F.coalesce(strip(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in required))


def task_label(status: Column, error: Column, code: Column) -> Column:
    """What is shown for a task: not run, running, success, or failed with its cause."""
    cause = F.coalesce(F.nullif(error, F.lit("")), F.concat(F.lit("exit "), code.cast("string")), F.lit("unknown"))
    return F.when(status.isNull(), F.lit(NOT_RUN)).when(status == "running", F.lit(RUNNING)).when(status == "success", F.lit(SUCCEEDED)).otherwise(F.concat(F.lit(f"{FAILED}（"), cause, F.lit("）")))


def status_flags(status: Column) -> list[Column]:
    return [(status == s).alias(s) for s in ("ready", "queued", "rendering", "missing")]


def export_status(stored: Column, has_source: Column, cached_text: Column, cached_at: Column, source_at: Column) -> Column:
    """The status shown of an export: stored ones only while work goes on, else by the cache's age."""
    from gradeloom.functions.text import strip

    busy = F.coalesce(stored.isin("queued", "rendering"), F.lit(False))
    fresh = (F.coalesce(strip(cached_text), F.lit("")) != "") & (F.coalesce(cached_at, F.lit(0.0)) >= F.coalesce(source_at, F.lit(0.0)) - 1e-6)
    return F.when(busy, stored).when(~has_source, F.lit("missing")).when(fresh, F.lit("ready")).otherwise(F.lit("stale"))


def id_collisions(names: DataFrame, raw: str, safe: Column) -> DataFrame:
    """Safe names that several raw ones share, with how many."""
    return names.select(F.col(raw), safe.alias("safe")).distinct().groupBy("safe").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
