"""Queries whose results depend on the order of rows.

Events stand for log lines and task states (the user for the task), conversations for attempts and streamed
answers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import ordered
from gradeloom.plans.registry import Registry, table
from gradeloom.streaming import logs

REGISTRY = Registry()
query = REGISTRY.query

LINE = "event_type || ' ' || value::VARCHAR"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.concat_ws(" ", "event_type", F.col("value").cast("string")).alias("line"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS page_no,
coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS first_page FROM lineitem""")
def page_sequence(spark, sf_dir):
    """Pages numbered over all files of a submission, and the page at which a file of several begins."""
    cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *cols)
    return ordered.running_start(ordered.numbered(lines, ["l_orderkey"], cols, "page_no"), ["l_orderkey"], cols, "l_quantity", "first_page")


@query(f"""SELECT user_id, line_no, {LINE} AS line, total FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS line_no, count(*) OVER (PARTITION BY user_id) AS total FROM events) WHERE line_no >= 10 AND line_no < 30""")
def log_page(spark, sf_dir):
    """Lines 10 to 29 of each log, with the log's length."""
    return ordered.page(_lines(spark, sf_dir), ["user_id"], ["event_id"], 10, 20).select("user_id", "line_no", "line", "total")


@query(f"""SELECT user_id, {LINE} AS line, from_end::INT AS from_end FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS from_end FROM events) WHERE from_end <= 25""")
def log_tail(spark, sf_dir):
    """The last 25 lines of each log."""
    return ordered.tail(_lines(spark, sf_dir), ["user_id"], [F.desc("event_id")], 25).select("user_id", "line", "from_end")


@query(f"""SELECT event_id, {LINE} AS line FROM events ORDER BY event_id DESC LIMIT 80""")
def recent_logs(spark, sf_dir):
    """The newest 80 lines of all: a report of fixed length."""
    return _lines(spark, sf_dir).orderBy(F.desc("event_id")).limit(80).select("event_id", "line")


@query(f"""SELECT user_id, event_id, {LINE} AS line FROM events WHERE event_type <> 'error'""")
def shown_log_lines(spark, sf_dir):
    """Lines for readers, without command echoes and blank ones."""
    rows = _lines(spark, sf_dir).withColumn("line", F.when(F.col("event_type") == "error", F.concat(F.lit("[CMD] "), "line")).otherwise(F.col("line")))
    return logs.shown_lines(rows).select("user_id", "event_id", "line")


@query("""SELECT user_id, event_type, arg_max(event_id, ts)::BIGINT AS event_id FROM events GROUP BY user_id, event_type""")
def latest_task(spark, sf_dir):
    """The latest task of each kind and week."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), F.col("user_id").alias("weekId"), F.col("ts").alias("startedAt"), F.col("event_id").alias("seq"))
    return logs.latest_tasks(rows).select(F.col("weekId").alias("user_id"), F.col("task").alias("event_type"), F.col("seq").alias("event_id"))


@query("""SELECT min(event_id) AS event_id, user_id, event_type FROM events a WHERE value > 20 AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND b.value <= 3) GROUP BY user_id, event_type""")
def task_guard(spark, sf_dir):
    """Requests that may start: nothing of their kind and week runs, and of several the first."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), F.col("user_id").alias("weekId"), F.col("event_id").alias("seq"), "value")
    running = rows.where("value <= 3").select("task", "weekId", F.lit("running").alias("status"))
    return logs.may_start(rows.where("value > 20"), running).select(F.col("seq").alias("event_id"), F.col("weekId").alias("user_id"), F.col("task").alias("event_type"))


@query("""SELECT event_id, user_id, before, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n = 1 OR before IS DISTINCT FROM event_type""")
def status_transitions(spark, sf_dir):
    """Events at which a task's state is another than before."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return ordered.transitions(rows, ["user_id"], ["event_id"], "event_type").select("event_id", "user_id", "before", "event_type")


@query("""SELECT c_nationkey, c_custkey, concat_ws(',', lag(c_custkey, 1) OVER w, lead(c_custkey, 1) OVER w, lag(c_custkey, 2) OVER w, lead(c_custkey, 2) OVER w) AS near,
coalesce(lag(c_custkey) OVER w, c_custkey) AS prev_item, coalesce(lead(c_custkey) OVER w, c_custkey) AS next_item FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)""")
def neighbours(spark, sf_dir):
    """Students around each one in the list of a class, and the steps back and forth."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    out = ordered.steps(ordered.neighbours(rows, ["c_nationkey"], ["c_custkey"], "c_custkey"), ["c_nationkey"], ["c_custkey"], "c_custkey")
    return out.withColumn("near", F.array_join(F.transform("near", lambda x: x.cast("string")), ","))


@query("""SELECT conv_id, coalesce(min(n) FILTER (ok), max(n))::INT AS attempts, CASE WHEN bool_or(ok) THEN 'success' ELSE 'failed' END AS status
FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, length(text) > 200 AS ok FROM conversations) WHERE n <= 2 GROUP BY conv_id""")
def attempts(spark, sf_dir):
    """Tries of each student: two at most, up to the first that succeeds."""
    return ordered.attempts(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.length("text") > 200)


@query("""SELECT conv_id, md5(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant')) AS answer_md5, md5(string_agg(text, '' ORDER BY turn) FILTER (role <> 'assistant')) AS reasoning_md5 FROM conversations GROUP BY conv_id""")
def assemble_stream(spark, sf_dir):
    """Parts of streamed answers put together, answers and reasoning apart."""
    rows = table(spark, sf_dir, "conversations")
    one = lambda cond, name: ordered.joined_text(rows.where(cond), ["conv_id"], ["turn"], "text", name)
    both = one("role = 'assistant'", "a").join(one("role <> 'assistant'", "r"), "conv_id", "full")
    return both.select("conv_id", F.md5(F.col("a").cast("binary")).alias("answer_md5"), F.md5(F.col("r").cast("binary")).alias("reasoning_md5"))


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2 DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def upsert_latest(spark, sf_dir):
    """A table with changes written over it; the last change of a key wins."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    base = ordered.latest(rows.where("event_id % 2 = 0"), ["user_id", "event_type"], [F.desc("event_id")])
    return ordered.upsert(base, rows.where("event_id % 2 = 1"), ["user_id", "event_type"], ["event_id"])


@query("""SELECT o_orderkey, l_linenumber, l_partkey, 'old' AS side FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND l_linenumber <= 2
UNION ALL SELECT o_orderkey, l_linenumber, l_partkey, 'new' FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND l_linenumber > 2""")
def clear_and_replace(spark, sf_dir):
    """Pages after a run: old ones of students that ran go, new ones come of those that succeeded."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    outcome = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'F' THEN 'failed' ELSE 'skipped' END").alias("status"))
    old, new = lines.where("l_linenumber <= 2").withColumn("side", F.lit("old")), lines.where("l_linenumber > 2").withColumn("side", F.lit("new"))
    return ordered.replace_keys(old, new, outcome, "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_quantity <= 20 THEN 0 ELSE 1 END, CASE WHEN l_quantity <= 20 THEN 0 ELSE l_quantity END, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1""")
def least_that_fits(spark, sf_dir):
    """The first candidate within the limit, or else the smallest."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return ordered.least_that_fits(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_quantity", 20).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("""SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY u IS NULL, u DESC, f)::INT AS place FROM
(SELECT user_id, event_type, min(event_id) AS f, max(event_id) FILTER (value > 30) AS u FROM events GROUP BY user_id, event_type)""")
def queue_order(spark, sf_dir):
    """The order of a queue in which urgent requests go ahead."""
    rows = table(spark, sf_dir, "events").withColumn("urgent", F.col("value") > 30)
    return ordered.queue_order(rows, ["user_id"], "event_type", "event_id", "urgent")


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY user_id, event_type) GROUP BY user_id""")
def first_seen(spark, sf_dir):
    """Kinds of each user in the order in which they were first seen."""
    kinds = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    rows = kinds.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("all"))
    return rows.select("user_id", F.array_join(F.transform("all", lambda x: x["event_type"]), ",").alias("kinds"))


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS place FROM events WHERE event_type NOT IN ('error', 'view')""")
def renumbered(spark, sf_dir):
    """Rows numbered anew after a filter."""
    rows = table(spark, sf_dir, "events").where(~F.col("event_type").isin("error", "view")).select("user_id", "event_id")
    return ordered.numbered(rows, ["user_id"], ["event_id"], "place")


@query("""SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY user_id""")
def last_request_wins(spark, sf_dir):
    """Of several answers the one that was asked for last."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("event_id"), F.max_by("value", "ts").alias("value"))


@query("""SELECT o_orderkey, count(l_orderkey) FILTER (l_quantity > 5) AS valid, count(l_orderkey) FILTER (l_quantity > 5) > 0 AS usable, greatest(1, coalesce(max(l_linenumber), 0))::INT AS columns,
coalesce(max(l_quantity), 0)::DOUBLE AS width, coalesce(sum(l_extendedprice), 0) + 24 * greatest(count(l_orderkey) - 1, 0) > 100000 AS tall FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def canvas_sizes(spark, sf_dir):
    """Valid pages, widest row and stacked height of each submission."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_quantity") > 5).alias("valid"), F.max("l_linenumber").alias("columns"), F.max("l_quantity").alias("width"), F.sum("l_extendedprice").alias("height"), F.count(F.lit(1)).alias("n"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select("o_orderkey", zero("valid").cast("long").alias("valid"), (zero("valid") > 0).alias("usable"), F.greatest(F.lit(1), zero("columns")).cast("int").alias("columns"), zero("width").cast("double").alias("width"), (zero("height") + 24 * F.greatest(zero("n") - 1, F.lit(0)) > 100000).alias("tall"))


@query("""SELECT c_custkey, 'b' || c_custkey AS a, c_name AS b, c_mktsegment AS c FROM customer""")
def merged_maps(spark, sf_dir):
    """Two maps in one; the right one wins."""
    left = F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.col("c_name"))
    right = F.create_map(F.lit("a"), F.concat(F.lit("b"), F.col("c_custkey").cast("string")), F.lit("c"), F.col("c_mktsegment"))
    keys = F.array_distinct(F.concat(F.map_keys(left), F.map_keys(right)))
    merged = F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.try_element_at(right, k), F.try_element_at(left, k))))
    return table(spark, sf_dir, "customer").select("c_custkey", merged["a"].alias("a"), merged["b"].alias("b"), merged["c"].alias("c"))


@query("""SELECT p_brand, min(p_partkey) AS first_part FROM part WHERE p_partkey <> 0 GROUP BY p_brand""")
def first_available(spark, sf_dir):
    """The first of what is left when one is taken out."""
    return table(spark, sf_dir, "part").where("p_partkey <> 0").groupBy("p_brand").agg(F.min("p_partkey").alias("first_part"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL""")
def hourly_activity(spark, sf_dir):
    """Events by kind and hour."""
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour")["start"].alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
