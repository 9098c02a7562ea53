"""Reports, pages and logs as files: reading and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.functions import verdicts as V

#: Fixed value: names of page images, whatever their case.
PAGE = r"(?i)^page_(\d+)\.png$"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """student_id and body of the text files of a folder, whole."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return rows.select(T.stem_of(T.url_text(F.col("_metadata.file_path"))).alias("student_id"), F.col("value").alias("body"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """student_id and payload of the JSON files of a folder, as texts."""
    rows = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return rows.select(T.stem_of(T.url_text(F.col("_metadata.file_path"))).alias("student_id"), F.col("value").alias("payload"))


def page_numbers(names: DataFrame, name: str) -> DataFrame:
    """Names of pages with their numbers; other names are left out."""
    return names.where(F.col(name).rlike(PAGE)).withColumn("page_no", F.regexp_extract(name, PAGE, 1).cast("int"))


def shown_pages(names: DataFrame, name: str) -> DataFrame:
    """All PNG names with the number behind their last underscore, 0 without one."""
    number = F.coalesce(F.nullif(F.regexp_extract(name, r"(?i)_(\d+)\.png$", 1), F.lit("")).try_cast("int"), F.lit(0))
    return names.where(F.lower(name).endswith(".png")).withColumn("page_no", number)


def list_pages(spark: SparkSession, folder: str) -> DataFrame:
    """student_id and page_no of the pages under <folder>/<student>/; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][nN][gG]").load(folder).select("path")
    parts = F.split(T.url_text(F.col("path")), "/")
    rows = files.select(F.element_at(parts, -2).alias("student_id"), F.element_at(parts, -1).alias("name"))
    return page_numbers(rows, "name").select("student_id", "page_no")


def load_results(payloads: DataFrame, texts: DataFrame, fmt: V.ReportFormat) -> DataFrame:
    """Reports by student: from the payload if it isn't empty, else from the text, else empty ones."""
    both = payloads.join(texts, "student_id", "full")
    text = F.when(F.coalesce(T.strip(F.col("body")), F.lit("")) != "", F.col("body")).otherwise("")
    both = both.withColumn("payload", F.when(F.octet_length("payload") > 0, F.col("payload"))).withColumn("body", text)
    return V.enriched(both, "payload", "body", fmt)


def payload_column(result_path, parsed: bool = True):
    """The JSON text of parsed reports, with where they are from."""
    return F.to_json(F.struct(
        result_path.alias("result_txt"), F.lit(parsed).alias("parsed_with_output_format"), "student_name_or_id", "overall", "modules", "error_details_by_question", "proof_review_by_question"))


def write_by_student(rows: DataFrame, text: str, folder: str) -> None:
    """One text a student under <folder>/student_id=<id>/; partitions that are written replace older ones."""
    rows.select("student_id", F.col(text).alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("student_id").text(folder)


def write_pages(pages: DataFrame, folder: str) -> None:
    """Pages as a table by student; partitions that are written replace older ones."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("student_id").parquet(folder)


def write_summary(summary: DataFrame, folder: str) -> None:
    summary.select(F.col("summary").alias("value")).write.mode("overwrite").text(folder)
