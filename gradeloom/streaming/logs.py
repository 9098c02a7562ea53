"""Task logs and task states as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.operators.ordered import latest

TASK_SCHEMA = "taskId string, task string, weekId string, status string, startedAt double, endedAt double, returnCode int, error string"


def read_log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """task_id and line of log files as they come. Offsets are in the checkpoint, so no line is lost or read twice."""
    lines = spark.readStream.text(folder)
    return lines.select(T.stem_of(F.col("_metadata.file_path")).alias("task_id"), F.col("value").alias("line"))


def shown_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines for readers: blank ones and command echoes are left out."""
    return lines.where((T.strip(F.col(line)) != "") & ~F.col(line).startswith("[CMD]"))


def start_tail(lines: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Give every new batch of lines to sink, once."""
    return lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_tasks(events: DataFrame) -> DataFrame:
    """The latest task of each kind and week; of equal ones the one that came first."""
    return latest(events, ["task", "weekId"], [F.desc("startedAt"), "seq"])


def final_status(code: Column) -> Column:
    """running while there is no exit code, then success or failed."""
    return F.when(code.isNull(), "running").when(code == 0, "success").otherwise("failed")


def may_start(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """Requests for which no task of the same kind and week is running, and of several the first."""
    running = tasks.where("status = 'running'").select("task", "weekId").distinct()
    return latest(requests.join(running, ["task", "weekId"], "left_anti"), ["task", "weekId"], ["seq"])


def activity(events: DataFrame, delay: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Counts of events by kind and hour of a stream; events later than the delay are left out."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return rows.groupBy(F.window("at", every), "event_type").agg(F.count(F.lit(1)).alias("n"))
