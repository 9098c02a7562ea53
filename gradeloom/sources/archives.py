"""Submissions from archives: nested zip files become rows of candidate files and pages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import media
from gradeloom.functions import text as T

#: Bounds on what one archive may hold; the rest of it is reported as an error and not read.
MAX_DEPTH, MAX_FILES, MAX_BYTES = 16, 10_000, 2 << 30
#: Fixed value: the text of a PDF that gives no page.
PDF_FAILED = "PDF 转图失败"
CANDIDATE_SCHEMA = "student_id string, pos int, relative_name string, kind string, data binary, error string"
PAGE_SCHEMA = "student_id string, pos int, page int, content binary, error string"


class ArchiveError(Exception):
    pass


def expand(data: bytes, name: str = "", prefix: str = "", depth: int = 0, room: list[int] | None = None) -> Iterator[tuple[str, str, bytes]]:
    """(name chain, kind, bytes) of the files in an archive and the archives in it; other kinds are left out.

    Folders within an archive are dropped from names. The outermost archive has no name in the chain.
    """
    room = [MAX_FILES, MAX_BYTES] if room is None else room
    if depth > MAX_DEPTH:
        raise ArchiveError("archives are nested too deep")
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for member in archive.infolist():
            if member.is_dir():
                continue
            room[0] -= 1
            room[1] -= member.file_size
            if min(room) < 0:
                raise ArchiveError("the archive is too large")
            body, base = archive.read(member), member.filename.rpartition("/")[2]
            kind, chain = media.kind_of(base, body), f"{prefix}{base}"
            if kind == "zip":
                yield from expand(body, base, f"{chain}/", depth + 1, room)
            elif kind:
                yield chain, kind, body


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """student_id and content of the zip files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)
    return files.select(T.safe_name(T.stem_of(T.url_text(F.col("path")))).alias("student_id"), "content")


def candidates(archives: DataFrame) -> DataFrame:
    """A row for each candidate file, in archive order; an archive that can't be read gives one row with its error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for student, content in zip(part["student_id"], part["content"], strict=True):
                rows = []
                try:
                    rows = [(student, i, n, k, d, None) for i, (n, k, d) in enumerate(expand(bytes(content or b"")))]
                except Exception as e:
                    rows = [(student, 0, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["student_id", "pos", "relative_name", "kind", "data", "error"])

    return archives.select("student_id", "content").mapInPandas(run, CANDIDATE_SCHEMA)


def to_pages(files: DataFrame, rasterise: Callable[[bytes], list[bytes]] | None = None, transcode: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """Pages of candidate files, before numbering; rasterise and transcode are the libraries' parts and can be given."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        png = transcode or media.to_png
        pdf = rasterise or pdf_pages
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                if r.kind is None:
                    rows.append((r.student_id, r.pos, 0, None, r.error))
                    continue
                try:
                    made = pdf(bytes(r.data)) if r.kind == "pdf" else [png(bytes(r.data))]
                    if not made:
                        raise RuntimeError(f"{PDF_FAILED}：{r.relative_name}")
                    rows += [(r.student_id, r.pos, i, d, None) for i, d in enumerate(made)]
                except Exception as e:
                    rows.append((r.student_id, r.pos, 0, None, str(e)))
            yield pd.DataFrame(rows, columns=["student_id", "pos", "page", "content", "error"])

    return files.select("student_id", "pos", "relative_name", "kind", "data", "error").mapInPandas(run, PAGE_SCHEMA)


def pdf_pages(data: bytes, zoom: float = 3.0) -> list[bytes]:
    """Pages of a PDF as PNG; no page at all if it can't be read. Needs the rendering library."""
    try:
        import fitz

        with fitz.open(stream=data, filetype="pdf") as book:
            return [p.get_pixmap(matrix=fitz.Matrix(zoom, zoom)).tobytes("png") for p in book]
    except Exception:
        return []


def preprocess(archives: DataFrame, existing: DataFrame, reprocess: bool = False, rasterise=None, transcode=None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, pages) of a run; existing has the student_id and page_no of pages that are there.

    Students with pages are skipped before anything is expanded, unless reprocess is set. A student whose
    files can't all be turned into pages has none.
    """
    from pyspark.sql import Window

    from gradeloom.operators.decisions import preprocess_outcome

    have = existing.groupBy("student_id").agg(F.count(F.lit(1)).cast("int").alias("old_pages"))
    todo = archives if reprocess else archives.join(have, "student_id", "left_anti")
    files = candidates(todo)
    order = Window.partitionBy("student_id").orderBy(T.natural_key(F.col("relative_name")), "pos")
    ranked = files.withColumn("pos", F.row_number().over(order))
    made = to_pages(ranked, rasterise, transcode)
    per = made.groupBy("student_id").agg(F.count("content").cast("int").alias("new_pages"), F.min("error").alias("error"))
    numbered = made.where("content IS NOT NULL").withColumn("page_no", F.row_number().over(Window.partitionBy("student_id").orderBy("pos", "page")))
    good = per.where("error IS NULL AND new_pages > 0").select("student_id")
    pages = numbered.join(good, "student_id", "left_semi").select("student_id", "page_no", "content")
    joined = archives.select("student_id").join(have, "student_id", "left").join(per, "student_id", "left")
    action = F.when((F.coalesce("old_pages", F.lit(0)) > 0) & ~F.lit(reprocess), "skip").otherwise("run")
    seen = F.coalesce("new_pages", F.lit(0)) + F.when(F.col("error").isNotNull(), 1).otherwise(0)
    outcome = preprocess_outcome(action, F.col("old_pages"), seen, F.col("new_pages"), F.col("error"))
    return joined.select("student_id", outcome.alias("x")).select("student_id", "x.status", "x.page_count", "x.detail"), pages
