"""Queries that SQL has no words for: archives, mathematics, scoring and the export machine.

Each makes its input from the tables, so that all of its rows are used.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from gradeloom.functions import latex
from gradeloom.operators import scoring
from gradeloom.plans.registry import Registry, table
from gradeloom.sources import archives
from gradeloom.streaming import export_state

REGISTRY = Registry()
query = REGISTRY.query


def _zip(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def _archives(pages):
    """Web pages packed as submissions: two files and an archive in an archive."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            bodies = [_zip({"a/p10.png": h.encode(), "p2.pdf": b"%PDF" + h.encode(), "notes.txt": b"no", "inner.zip": _zip({"x/p1.jpg": h.encode()})}) for h in part["html"].fillna("")]
            yield pd.DataFrame({"student_id": part["page_id"].astype(str), "content": bodies})

    return pages.select("page_id", "html").mapInPandas(run, "student_id string, content binary")


@query("""SELECT page_id::VARCHAR AS student_id, unnest(['inner.zip/p1.jpg', 'p2.pdf', 'p10.png']) AS relative_name, unnest(['image', 'pdf', 'image']) AS kind,
unnest([strlen(coalesce(html, '')), strlen(coalesce(html, '')) + 4, strlen(coalesce(html, ''))])::BIGINT AS bytes FROM pages""")
def archive_expand(spark, sf_dir):
    """Candidate files of nested archives."""
    files = archives.candidates(_archives(table(spark, sf_dir, "pages")))
    return files.select("student_id", "relative_name", "kind", F.octet_length("data").cast("long").alias("bytes"))


@query("""SELECT page_id::VARCHAR AS student_id, unnest([1, 2, 3, 4])::INT AS page_no, unnest(['inner.zip/p1.jpg', 'p2.pdf', 'p2.pdf', 'p10.png']) AS made_from FROM pages""")
def archive_pages(spark, sf_dir):
    """Pages of archives, numbered in the natural order of their files."""
    source = _archives(table(spark, sf_dir, "pages"))
    have = spark.createDataFrame([], "student_id string, page_no int")
    _, pages = archives.preprocess(source, have, rasterise=lambda d: [b"p2.pdf", b"p2.pdf"], transcode=lambda d: b"image")
    names = F.when(F.col("page_no") == 1, "inner.zip/p1.jpg").when(F.col("page_no") == 4, "p10.png").otherwise("p2.pdf")
    ok = F.col("content") == F.when(F.col("page_no").isin(1, 4), F.lit("image")).otherwise("p2.pdf").cast("binary")
    return pages.where(ok).select("student_id", "page_no", names.alias("made_from"))


@query("""SELECT doc_id, unnest([0, 1, 2])::INT AS pos, unnest(['text', 'inline_math', 'text']) AS kind, unnest([source || ' has ', 'x_' || doc_id, ' and \\$5']) AS value FROM documents""")
def math_tokens(spark, sf_dir):
    """Texts cut into words and formulas."""
    made = F.concat("source", F.lit(" has $x_"), F.col("doc_id").cast("string"), F.lit("$ and \\$5"))
    docs = table(spark, sf_dir, "documents").select("doc_id", made.alias("made"))
    spark.udtf.register("math_tokens", latex.MathTokens)
    docs.createOrReplaceTempView("math_texts")
    return spark.sql("SELECT doc_id, pos, kind, value FROM math_texts, LATERAL math_tokens(made)")


@query("""SELECT doc_id, 'a & ' || doc_id || ';c & d' AS cells, 2 AS columns FROM documents""")
def matrix_cells(spark, sf_dir):
    """Cells of matrices whose rows were set apart by blanks alone."""
    made = F.concat(F.lit("\\begin{pmatrix} a  "), F.col("doc_id").cast("string"), F.lit(" \\\\ c d \\\\ \\end{pmatrix}"))
    rows = latex.matrix_cells_of(latex.spaced_rows_of(F.col("made")))
    docs = table(spark, sf_dir, "documents").select("doc_id", made.alias("made")).withColumn("rows", rows)
    return docs.select("doc_id", F.array_join(F.transform("rows", lambda r: F.array_join(r, " & ")), ";").alias("cells"), latex.matrix_width(F.col("rows")).alias("columns"))


class _Stub:
    """A scorer that answers from the prompt, fails once for some students and always for others."""

    def __init__(self) -> None:
        self.seen: set[str] = set()

    def __call__(self, prompt: str, pages: list[str]) -> Iterator[str]:
        n = int(prompt.rpartition(" ")[2])
        if n % 7 == 0:
            raise TimeoutError("no answer")
        if n % 5 == 0 and prompt not in self.seen:
            self.seen.add(prompt)
            return iter([" "])
        return iter(["整体情况：", "全对", f"\n{len(pages)} pages "])


@query("""SELECT c_custkey::VARCHAR AS student_id, CASE WHEN c_custkey % 11 = 0 OR c_custkey % 7 = 0 THEN 'failed' ELSE 'success' END AS status,
CASE WHEN c_custkey % 11 = 0 THEN 1 WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN 2 ELSE 1 END::INT AS attempts,
CASE WHEN c_custkey % 11 = 0 THEN '未找到符合 page_*.png 的标准化图片' WHEN c_custkey % 7 = 0 THEN 'TimeoutError: no answer' END AS error,
CASE WHEN c_custkey % 11 = 0 OR c_custkey % 7 = 0 THEN NULL ELSE '整体情况：全对' || chr(10) || '2 pages' END AS body FROM customer""")
def score_stub(spark, sf_dir):
    """Outcomes of a scorer with every kind of failure."""
    pages = F.when(F.col("c_custkey") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("data:a"), F.lit("data:b")))
    students = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("student_id"), F.concat(F.lit("grade "), F.col("c_custkey").cast("string")).alias("prompt"), pages.alias("pages"))
    return scoring.score(students, _Stub)


def export_events(spark, sf_dir):
    kinds = F.expr("CASE event_type WHEN 'view' THEN 'request' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'signup' THEN 'source' ELSE CASE WHEN event_id % 3 = 0 THEN 'finish' ELSE 'request' END END")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("student_id"), F.col("event_id").alias("seq"), kinds.alias("kind"), F.col("event_id").cast("double").alias("at"), (F.col("value") > 30).alias("urgent"),
        F.when(F.col("event_type") == "purchase", F.lit("text")).alias("text"), F.when(F.col("event_type") == "error", F.lit("broken")).alias("error"))


#: The machine's rules as a recursion over each student's events. A source is there once `src` isn't null.
FSM = """WITH RECURSIVE e AS (
SELECT user_id::VARCHAR AS student_id, event_id AS seq, event_id::DOUBLE AS at, coalesce(value > 30, FALSE) AS urgent, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
CASE event_type WHEN 'view' THEN 'request' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'signup' THEN 'source' ELSE CASE WHEN event_id % 3 = 0 THEN 'finish' ELSE 'request' END END AS kind,
CASE WHEN event_type = 'purchase' THEN 'text' END AS text, CASE WHEN event_type = 'error' THEN 'broken' END AS error FROM events),
s AS (
SELECT student_id, 0::BIGINT AS n, 0::BIGINT AS seq, 'missing' AS status, '' AS error, '' AS text, NULL::DOUBLE AS src, 0::DOUBLE AS cached, NULL::DOUBLE AS rendering, FALSE AS rerun, FALSE AS urgent FROM e WHERE n = 1
UNION ALL
SELECT e.student_id, e.n, e.seq,
CASE WHEN e.kind = 'request' THEN CASE WHEN s.src IS NULL THEN 'missing' WHEN s.status = 'rendering' THEN 'rendering' ELSE 'queued' END
     WHEN e.kind = 'start' AND s.status = 'queued' THEN 'rendering'
     WHEN done THEN CASE WHEN again THEN 'queued' WHEN e.error IS NULL THEN 'ready' ELSE 'error' END ELSE s.status END,
CASE WHEN e.kind = 'request' OR e.kind = 'start' AND s.status = 'queued' THEN '' WHEN done THEN CASE WHEN again OR e.error IS NULL THEN '' ELSE e.error END ELSE s.error END,
CASE WHEN done AND NOT again THEN CASE WHEN e.error IS NULL THEN coalesce(e.text, '') ELSE '' END ELSE s.text END,
CASE WHEN e.kind = 'source' THEN e.at ELSE s.src END,
CASE WHEN done AND NOT again AND e.error IS NULL THEN coalesce(s.rendering, 0) ELSE s.cached END,
CASE WHEN e.kind = 'start' AND s.status = 'queued' THEN s.src WHEN done THEN NULL ELSE s.rendering END,
CASE WHEN e.kind = 'request' AND s.src IS NOT NULL AND s.status = 'rendering' THEN TRUE WHEN done THEN FALSE ELSE s.rerun END,
CASE WHEN e.kind = 'request' AND s.src IS NOT NULL AND s.status <> 'rendering' THEN e.urgent OR (s.status = 'queued' AND s.urgent)
     WHEN e.kind = 'start' AND s.status = 'queued' THEN FALSE WHEN done AND again THEN TRUE WHEN done AND e.error IS NULL THEN s.urgent ELSE s.urgent END
FROM s JOIN e ON e.student_id = s.student_id AND e.n = s.n + 1,
LATERAL (SELECT e.kind = 'finish' AND s.status = 'rendering' AS done) d,
LATERAL (SELECT s.rerun OR (e.error IS NULL AND coalesce(s.src, 0) > coalesce(s.rendering, 0) + 1e-6) AS again) g)
SELECT student_id, seq, shown AS status, error, shown = 'ready' AS ready, urgent FROM
(SELECT *, CASE WHEN status IN ('queued', 'rendering') THEN status WHEN src IS NULL THEN 'missing' WHEN trim(text) <> '' AND cached >= src - 1e-6 THEN 'ready' ELSE 'stale' END AS shown FROM s WHERE n > 0)"""


@query(FSM)
def export_fsm(spark, sf_dir):
    """Reported states of exports after every event."""
    return export_state.export_batch(export_events(spark, sf_dir))
