from pyspark.sql import functions as F

from gradeloom.operators import decisions, ordered


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_carry_and_sessions(spark):
    t = rows(spark, [(1, i, m, i == 4) for i, m in enumerate([None, "a", None, "b", None, None, "c"])], "k int, i int, m string, r boolean")
    out = ordered.carry_forward(t, ["k"], ["i"], F.col("m"), "s", F.col("r")).orderBy("i").collect()
    assert [r.s for r in out] == [None, "a", "a", "b", None, None, "c"]
    out = ordered.sessions(t, ["k"], ["i"], F.col("m").isNotNull(), "n").orderBy("i").collect()
    assert [r.n for r in out] == [0, 1, 1, 2, 2, 2, 3]


def test_page_clamps(spark):
    t = rows(spark, [(1, i) for i in range(300)], "k int, i int")
    assert [r.line_no for r in ordered.page(t, ["k"], ["i"], -5, 2).orderBy("i").collect()] == [0, 1]
    assert ordered.page(t, ["k"], ["i"], 0, 1000).count() == 200
    assert ordered.page(t, ["k"], ["i"], 0, 0).count() == 1
    assert ordered.page(t, ["k"], ["i"], 400, 10).count() == 0
    assert ordered.page(t, ["k"], ["i"], 299, 10).first().total == 300


def test_attempts(spark):
    t = rows(spark, [("a", 1, True), ("b", 1, False), ("b", 2, True), ("c", 1, False), ("c", 2, False), ("c", 3, True), ("d", 1, False)], "k string, i int, ok boolean")
    got = {r.k: (r.attempts, r.status) for r in ordered.attempts(t, ["k"], ["i"], F.col("ok")).collect()}
    assert got == {"a": (1, "success"), "b": (2, "success"), "c": (2, "failed"), "d": (1, "failed")}


def test_upsert_and_replace(spark):
    base = rows(spark, [("a", 0, "x"), ("b", 0, "y")], "k string, v int, t string")
    new = rows(spark, [("a", 1, "x1"), ("a", 2, "x2"), ("c", 1, "z")], "k string, v int, t string")
    assert {r.k: r.t for r in ordered.upsert(base, new, ["k"], ["v"]).collect()} == {"a": "x2", "b": "y", "c": "z"}
    outcome = rows(spark, [("a", "failed"), ("b", "skipped"), ("c", "success"), ("n", "no_input")], "k string, status string")
    old = rows(spark, [("a", 1, "o"), ("b", 1, "o"), ("c", 1, "o"), ("n", 1, "o")], "k string, v int, t string")
    fresh = rows(spark, [("a", 2, "f"), ("c", 2, "f")], "k string, v int, t string")
    got = {(r.k, r.t) for r in ordered.replace_keys(old, fresh, outcome, "k").collect()}
    assert got == {("b", "o"), ("n", "o"), ("c", "f")}


def test_neighbours_queue_transitions(spark):
    t = rows(spark, [(1, c) for c in "abcd"], "k int, s string")
    got = {r.s: r.near for r in ordered.neighbours(t, ["k"], ["s"], "s").collect()}
    assert got == {"a": ["b", "c"], "b": ["a", "c", "d"], "c": ["b", "d", "a"], "d": ["c", "b"]}
    q = rows(spark, [(1, "x", 1, False), (1, "y", 2, True), (1, "z", 3, True), (1, "x", 4, False)], "k int, i string, seq int, u boolean")
    assert [r.i for r in ordered.queue_order(q, ["k"], "i", "seq", "u").orderBy("place").collect()] == ["z", "y", "x"]
    s = rows(spark, [(1, i, v) for i, v in enumerate([None, None, "a", "a", None, "b"])], "k int, i int, s string")
    assert [r.i for r in ordered.transitions(s, ["k"], ["i"], "s").orderBy("i").collect()] == [0, 2, 4, 5]


def test_least_that_fits(spark):
    t = rows(spark, [("a", 1, 9), ("a", 2, 5), ("a", 3, 4), ("b", 1, 9), ("b", 2, 8), ("b", 3, 8)], "k string, i int, n int")
    got = {r.k: r.i for r in ordered.least_that_fits(t, ["k"], ["i"], "n", 5).collect()}
    assert got == {"a": 2, "b": 2}


def test_decisions(spark):
    t = rows(spark, [(None,), ("",), (" ",), ("x 需人工复核",), ("good",)], "r string")
    got = t.select(decisions.grading_action(F.col("r")).alias("a"), decisions.grading_action(F.col("r"), True).alias("b")).collect()
    assert [r.a for r in got] == ["run", "run", "skip", "retry", "skip"]
    assert [r.b for r in got] == ["run", "run", "regrade", "regrade", "regrade"]
    e = decisions.empty_summary(spark, "w").first()
    assert (e.total, e.failed) == (0, 0)
    m = rows(spark, [("a", "　"), ("a", "b"), (None, None)], "x string, y string").select(decisions.first_missing(["x", "y"]).alias("m")).collect()
    assert [r.m for r in m] == ["y", None, "x"]
    flags = decisions.export_status(F.col("s"), F.col("h"), F.col("t"), F.col("c"), F.col("a"))
    data = [("error", True, "x", 5.0, 5.0), ("error", True, " ", 9.0, 5.0), ("queued", False, None, None, None), (None, False, "x", 1.0, 1.0), ("ready", True, "x", 4.0, 5.0)]
    got = [r.v for r in rows(spark, data, "s string, h boolean, t string, c double, a double").select(flags.alias("v")).collect()]
    assert got == ["ready", "stale", "queued", "missing", "stale"]


def test_summary_text(spark):
    t = rows(spark, [("w", "b", "failed", None), ("w", "a", "failed", "e"), ("w", "c", "success", None), ("v", "d", "skipped", None)], "week string, s string, status string, d string")
    got = {r.week: r.summary for r in decisions.summary_text(t, "week", "s", "status", decisions.preprocess_line(F.col("s"), F.col("d"))).collect()}
    assert got["w"] == "周目录：w\n总学生数：3\n成功数：1\n失败数：2\n跳过数：0\n失败学生列表：\n- a: e\n- b: 处理失败\n"
    assert got["v"].endswith("失败学生列表：\n- 无\n")
