"""Scoring by an outside model, whose failures are rows and not errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import media
from gradeloom.functions import text as T
from gradeloom.functions import verdicts as V
from gradeloom.operators.decisions import NO_PAGES

MAX_ATTEMPTS = 2
#: Texts of failed gradings.
CALL_FAILED, NO_SCORE, TRY_AGAIN = "判卷脚本调用失败，需人工复核", "评分失败", "请检查该学生图片目录和接口状态后重试。"
SCHEMA = "student_id string, status string, attempts int, error string, body string"
#: Called with a prompt and the pages as data addresses; gives parts of the answer as they come.
Client = Callable[[str, list[str]], Iterator[str]]


def build_prompts(students: DataFrame, template: str, subject: dict[str, str], answer: str) -> DataFrame:
    """students(student_id) with the prompt of each."""
    name = F.col("student_id")
    shown = T.fill(F.lit(subject["output_format"]), {"student_name": name})
    values = {"subject_name": F.lit(subject["subject_name"]), "standard_answer": F.lit(answer), "grading_requirements": F.lit(subject["grading_requirements"]), "output_format": shown, "student_name": name}
    return students.withColumn("prompt", T.fill(F.lit(template), values))


def score(students: DataFrame, client: Callable[[], Client], attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """students(student_id, prompt, pages) -> outcome and report text; each student is tried `attempts` times.

    client is called once in every task, so it may open a connection. Model calls can't be repeated with the
    same result: write the outcome before using it twice. Causes are told apart: no pages, blank answers, and
    errors of the client.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                pages = [] if r.pages is None else list(r.pages)
                if not pages:
                    rows.append((r.student_id, "failed", 1, NO_PAGES, None))
                    continue
                error, body = None, ""
                for n in range(1, attempts + 1):
                    try:
                        call = call or client()
                        body = "".join(call(r.prompt, pages)).strip()
                        error = None if body else "blank answer"
                    except Exception as e:
                        error, body = f"{type(e).__name__}: {e}", ""
                    if body:
                        break
                rows.append((r.student_id, "success" if body else "failed", n, error, body or None))
            yield pd.DataFrame(rows, columns=["student_id", "status", "attempts", "error", "body"])

    return students.select("student_id", "prompt", "pages").mapInPandas(run, SCHEMA)


def with_failure_reports(scored: DataFrame) -> DataFrame:
    """Failed students get the report that says so, which makes the next run try them again."""
    report = V.failure_report(F.col("student_id"), F.lit(CALL_FAILED), F.array(F.coalesce("error", F.lit(NO_SCORE))), F.array(F.lit(TRY_AGAIN)))
    return scored.withColumn("body", F.when(F.col("status") == "success", F.col("body")).otherwise(report))


def usable_pages(pages: DataFrame, content: str = "content", limit: int = media.SAFE_IMAGE_BYTES, compress: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """Data addresses of each student's pages by number.

    Pages of more than `limit` bytes are made smaller, and only these go to Python. Unreadable ones, and those
    that are too large even then, are left out and counted.
    """
    smaller = compress or media.Shrinker(limit)
    rows = pages.select("student_id", "page_no", F.col(content).alias("content"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = []
            for data in part["content"]:
                try:
                    made.append(smaller(bytes(data)))
                except Exception:  # a page that can't be read; it's counted below
                    made.append(None)
            yield part.assign(content=made)

    large = F.coalesce(F.octet_length("content") > limit, F.lit(False))
    both = rows.where(~large).unionByName(rows.where(large).mapInPandas(run, rows.schema))
    jpeg = F.startswith("content", F.lit(b"\xff\xd8\xff"))
    uri = media.data_uri(F.col("content"), F.when(jpeg, "image/jpeg").otherwise("image/png"))
    ok = F.coalesce((F.octet_length("content") > 0) & ~media.uri_too_long(uri), F.lit(False))
    marked = both.select("student_id", "page_no", F.when(ok, uri).alias("uri"))
    parts: Column = F.array_sort(F.collect_list(F.when(F.col("uri").isNotNull(), F.struct("page_no", "uri"))))
    return marked.groupBy("student_id").agg(F.transform(parts, lambda x: x["uri"]).alias("pages"), F.count_if(F.col("uri").isNull()).alias("left_out"))
