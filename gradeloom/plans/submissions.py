"""Queries on submissions: decisions, joins, summaries and listings.

Orders stand for submissions (their status for the outcome), order lines for pages, customers for students,
months for weeks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.functions.verdicts import NEEDS_REVIEW, failure_report
from gradeloom.operators import decisions
from gradeloom.plans.registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query


STATUS = "CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'F' THEN 'failed' ELSE 'skipped' END"
DETAIL = "CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("week"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("student"),
        F.expr(STATUS).alias("status"), F.expr(DETAIL).alias("detail"))


OUTCOMES = f"(SELECT strftime(o_orderdate, '%Y-%m') AS week, lpad(o_orderkey::VARCHAR, 12, '0') AS student, {STATUS} AS status, {DETAIL} AS detail FROM orders)"


@query(f"""SELECT week, count(*) AS total, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'failed') AS failed,
count(*) FILTER (status = 'skipped') AS skipped FROM {OUTCOMES} GROUP BY week""")
def status_summary(spark, sf_dir):
    """Counts by outcome for each week."""
    return outcomes(spark, sf_dir).groupBy("week").agg(*decisions.status_counts(F.col("status")))


@query(f"""SELECT week, student, '- ' || student || ': ' || coalesce(nullif(detail, ''), '处理失败') AS preprocess_line,
'- ' || student || coalesce(': ' || nullif(detail, ''), '') AS grading_line FROM {OUTCOMES} WHERE status = 'failed'""")
def failure_report_lines(spark, sf_dir):
    """Both forms of the line that a failure has in a summary."""
    failed = outcomes(spark, sf_dir).where("status = 'failed'")
    return failed.select("week", "student", decisions.preprocess_line(F.col("student"), F.col("detail")).alias("preprocess_line"), decisions.grading_line(F.col("student"), F.col("detail")).alias("grading_line"))


@query(f"""SELECT week, '周目录：' || week || chr(10) || '总学生数：' || count(*) || chr(10) || '成功数：' || count(*) FILTER (status = 'success') || chr(10) ||
'失败数：' || count(*) FILTER (status = 'failed') || chr(10) || '跳过数：' || count(*) FILTER (status = 'skipped') || chr(10) || '失败学生列表：' || chr(10) ||
coalesce(string_agg('- ' || student || coalesce(': ' || nullif(detail, ''), ''), chr(10) ORDER BY student) FILTER (status = 'failed'), '- 无') || chr(10) AS summary
FROM {OUTCOMES} GROUP BY week""")
def summary_reports(spark, sf_dir):
    """The text of each week's summary."""
    return decisions.summary_text(outcomes(spark, sf_dir), "week", "student", "status", decisions.grading_line(F.col("student"), F.col("detail")))


@query("SELECT 'none' AS week, 0::BIGINT AS total, 0::BIGINT AS succeeded, 0::BIGINT AS failed, 0::BIGINT AS skipped")
def empty_week_summary(spark, sf_dir):
    """A week without submissions still has a summary."""
    return decisions.empty_summary(spark, "none")


@query("SELECT o_orderkey, count(l_orderkey) AS pages FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def pages_per_submission(spark, sf_dir):
    """Pages of each submission; those without any have 0."""
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pages"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.join(pages, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("pages", F.lit(0)).cast("long").alias("pages"))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'run' WHEN o_orderstatus = 'F' THEN 'retry' ELSE 'skip' END AS action,
CASE WHEN o_orderstatus = 'P' THEN 'run' ELSE 'regrade' END AS forced, CASE WHEN n > 0 THEN 'skip' ELSE 'run' END AS preprocess
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def run_decision(spark, sf_dir):
    """What to do with each submission, from its earlier result and its pages."""
    result = F.expr(f"CASE o_orderstatus WHEN 'O' THEN ' ' WHEN 'F' THEN 'x {NEEDS_REVIEW} y' WHEN 'P' THEN '' END")
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    joined = table(spark, sf_dir, "orders").join(pages, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", decisions.grading_action(result).alias("action"), decisions.grading_action(result, True).alias("forced"), decisions.preprocess_action(F.col("n")).alias("preprocess"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def pending_submissions(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(pages, "o_orderkey", "left_anti")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def done_submissions(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(pages, "o_orderkey", "left_semi")


@query("""SELECT c_custkey AS id, coalesce(pages, 0)::BIGINT AS page_count, coalesce(done, 0) > 0 OR coalesce(texts, 0) > 0 AS has_result, FALSE AS has_export_image
FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS done, count(*) FILTER (o_orderstatus = 'F') AS texts FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS pages FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) b ON b.o_custkey = c_custkey""")
def student_listing(spark, sf_dir):
    """Students with their pages and whether any result is there, as data or as text."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    per_order = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    per = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("pages"), F.count_if(F.col("o_orderstatus") == "O").alias("done"), F.count_if(F.col("o_orderstatus") == "F").alias("texts"))
    joined = table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    return joined.select(F.col("c_custkey").alias("id"), F.coalesce("pages", F.lit(0)).cast("long").alias("page_count"), (some("done") | some("texts")).alias("has_result"), F.lit(False).alias("has_export_image"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), lower(trim(' 00012 ')))")
def student_search(spark, sf_dir):
    """Names that hold a keyword, whatever its case and the blanks around it."""
    return table(spark, sf_dir, "customer").where(F.lower("c_name").contains(" 00012 ".strip().lower())).select("c_custkey", "c_name")


@query("""SELECT c_custkey, coalesce(n_name, 'default') AS subject, coalesce(r_name, 'default') AS family FROM customer
LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20 LEFT JOIN region ON r_regionkey = n_regionkey""")
def subject_broadcast(spark, sf_dir):
    """Each student's subject; those without one of their own get the default. The subjects are a small fixed table."""
    subjects = table(spark, sf_dir, "nation").where("n_nationkey < 20").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    out = table(spark, sf_dir, "customer").join(subjects, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.select("c_custkey", F.coalesce("n_name", F.lit("default")).alias("subject"), F.coalesce("r_name", F.lit("default")).alias("family"))


@query("""SELECT c_custkey, a.model, a.language FROM customer, (SELECT 'm-1' AS model, 'zh' AS language) a""")
def config_for_all(spark, sf_dir):
    """One configuration row for every student."""
    config = spark.createDataFrame([("m-1", "zh")], "model string, language string")
    return table(spark, sf_dir, "customer").select("c_custkey").crossJoin(F.broadcast(config))  # one row by construction


@query(f"SELECT week, count(*) FILTER (status <> 'skipped') AS ok, count(*) FILTER (status = 'skipped') AS failed FROM {OUTCOMES} GROUP BY week")
def json_counters(spark, sf_dir):
    """Structured results and failed ones; an empty text is a failure."""
    rows = outcomes(spark, sf_dir).withColumn("text", F.when(F.col("status") != "skipped", F.lit("x")).otherwise(""))
    return decisions.json_counts(rows, "week", "text", F.lit(True))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN 'detail' WHEN o_orderstatus = 'P' THEN 'status' END AS missing FROM orders""")
def required_fields(spark, sf_dir):
    """The first field that is missing or blank."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(DETAIL).alias("detail"), F.expr("CASE WHEN o_orderstatus = 'P' THEN '\\u3000 ' ELSE o_orderstatus END").alias("status"))
    return rows.select("o_orderkey", decisions.first_missing(["detail", "status"]).alias("missing"))


@query(f"""SELECT week, rank, created_at FROM (SELECT week, created_at, row_number() OVER (ORDER BY created_at, week) AS rank FROM
(SELECT strftime(o_orderdate, '%Y-%m') AS week, epoch(min(o_orderdate))::DOUBLE AS created_at FROM orders GROUP BY 1))""")
def week_listing(spark, sf_dir):
    """Weeks by the time they began. There is one row a week, so their order is found in one task."""
    weeks = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("week")).agg(F.unix_timestamp(F.min("o_orderdate").cast("timestamp")).cast("double").alias("created_at"))
    return weeks.select("week", F.row_number().over(Window.orderBy("created_at", "week")).alias("rank"), "created_at")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '未运行' WHEN o_orderstatus = 'P' THEN '运行中' WHEN o_orderstatus = 'O' THEN '成功'
ELSE '失败（' || CASE WHEN o_orderpriority = '5-LOW' THEN 'exit ' || (o_orderkey % 3) ELSE coalesce(nullif(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END, ''), 'exit ' || (o_orderkey % 3)) END || '）' END AS label,
o_orderstatus = 'O' AS ready, o_orderstatus = 'P' AS queued, FALSE AS rendering, o_orderstatus = 'F' AS missing FROM orders""")
def task_labels(spark, sf_dir):
    """Labels and flags of task states."""
    status = F.expr("CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderstatus = 'O' THEN 'success' ELSE 'failed' END")
    shown = F.expr("CASE o_orderstatus WHEN 'O' THEN 'ready' WHEN 'P' THEN 'queued' ELSE 'missing' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", decisions.task_label(status, F.expr(DETAIL), F.col("o_orderkey") % 3).alias("label"), *decisions.status_flags(shown))


@query(f"""SELECT student, '========================================' || chr(10) || '姓名/学号：' || student || chr(10) || '整体情况：图片缺失，需人工复核' || chr(10) || '错误细节：' || chr(10) ||
'1. ' || coalesce(detail, '评分失败') || chr(10) || '2. ' || week || chr(10) || '证明题审查：' || chr(10) || '1. 未进入有效判卷流程，本项待人工复核。' || chr(10) || '改进建议：' || chr(10) || '1. 请先完成前处理。' || chr(10) || '========================================' || chr(10) AS report
FROM {OUTCOMES} WHERE status = 'failed'""")
def dead_letters(spark, sf_dir):
    """The report that stands for each failed grading."""
    failed = outcomes(spark, sf_dir).where("status = 'failed'")
    errors = F.array(F.coalesce("detail", F.lit("评分失败")), F.col("week"))
    return failed.select("student", failure_report(F.col("student"), F.lit("图片缺失，需人工复核"), errors, F.array(F.lit("请先完成前处理。"))).alias("report"))


@query(f"""SELECT o_orderkey, CASE WHEN n > 0 AND o_orderstatus = 'P' THEN 'skipped' WHEN n IS NULL THEN 'failed' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'success' END AS status,
CASE WHEN n > 0 AND o_orderstatus = 'P' THEN n WHEN n IS NULL OR o_orderstatus = 'F' THEN 0 ELSE n END::INT AS page_count,
CASE WHEN n > 0 AND o_orderstatus = 'P' THEN NULL WHEN n IS NULL THEN '{decisions.NO_INPUT}' WHEN o_orderstatus = 'F' THEN 'broken' END AS detail
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def preprocess_outcomes(spark, sf_dir):
    """Status, page count and detail of each submission after expansion."""
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    joined = table(spark, sf_dir, "orders").join(pages, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    old = F.when(F.col("o_orderstatus") == "P", F.col("n"))
    error = F.when(F.col("o_orderstatus") == "F", F.lit("broken"))
    out = decisions.preprocess_outcome(decisions.preprocess_action(old), old, F.col("n"), F.col("n"), error)
    return joined.select("o_orderkey", out.alias("x")).select("o_orderkey", "x.status", "x.page_count", "x.detail")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'rendering' ELSE 'stale' END
WHEN n IS NULL THEN 'missing' WHEN o_orderstatus <> 'F' AND o_totalprice >= n * 50000 - 1e-6 THEN 'ready' ELSE 'stale' END AS status
FROM orders LEFT JOIN (SELECT l_orderkey, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderpriority <> '1-URGENT' OR o_orderstatus <> 'P'""")
def staleness(spark, sf_dir):
    """Whether a cached export is still good."""
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("double").alias("n"))
    joined = table(spark, sf_dir, "orders").where("o_orderpriority <> '1-URGENT' OR o_orderstatus <> 'P'").join(pages, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    stored = F.expr("CASE WHEN o_orderpriority = '1-URGENT' THEN CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'rendering' END ELSE 'error' END")
    cached = F.when(F.col("o_orderstatus") != "F", F.lit("text"))
    return joined.select("o_orderkey", decisions.export_status(stored, F.col("n").isNotNull(), cached, F.col("o_totalprice"), F.col("n") * 50000).alias("status"))


@query("SELECT n_name, c_mktsegment, count(*) AS students FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name <> 'NATION_3' AND c_mktsegment <> 'MACHINERY' GROUP BY ALL")
def week_task_filter(spark, sf_dir):
    """Rows of wanted tasks and weeks, an excluded one left out."""
    joined = table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").join(table(spark, sf_dir, "nation").where("n_name <> 'NATION_3'"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("students"))
