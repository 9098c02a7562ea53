import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeloom.functions import verdicts as V

FMT = V.read_format(V.DEFAULT_FORMAT)


def parse(spark, text):
    return V.parse_reports(spark.createDataFrame([(text,)], "t string"), "t", FMT).first()


def test_format():
    assert FMT == V.ReportFormat("姓名/学号", "整体情况", ("错误细节", "证明题审查", "改进建议"))
    assert V.read_format("===\n\nA:\nB：\nA:\nplain") == V.ReportFormat(None, None, ("A", "B"))


CASES = [
    ("姓名/学号：甲\n整体情况：好\n错误细节：\n1. a\nmore\n2、b\n- 3) c\n", "甲", "好", {"错误细节": ["a\nmore", "b", "c"]}),
    ("姓名/学号：甲\n姓名/学号：乙\n整体情况：x\n整体情况: y", "乙", "y", {}),
    ("错误细节：同一行\n1. b", "", "", {"错误细节": ["同一行", "b"]}),
    ("错误细节：\nfirst\nsecond\n1. x", "", "", {"错误细节": ["first\nsecond", "x"]}),
    ("错误细节：\n1.2 的结果", "", "", {"错误细节": ["2 的结果"]}),
    ("错误细节：\n1.\n后续", "", "", {"错误细节": ["后续"]}),
    ("错误细节：\n1. a\n改进建议：\n1. b\n错误细节：\n2. c", "", "", {"错误细节": ["a", "c"], "改进建议": ["b"]}),
    ("错误细节：\n1. a\n注意：说明\n", "", "", {"错误细节": ["a\n注意：说明"]}),
    ("错误细节：\n1. a\n整体情况：好\nloose", "", "好", {"错误细节": ["a"]}),
    ("　错误细节　：　\r\n　 1. a \r\n====\r\n\r\n", "", "", {"错误细节": ["a"]}),
    ("错误细节:\n1. a\rb", "", "", {"错误细节": ["a\rb"]}),
    ("", "", "", {}),
]


@pytest.mark.parametrize("text, name, overall, items", CASES)
def test_parse(spark, text, name, overall, items):
    r = parse(spark, text)
    assert (r.student_name_or_id, r.overall) == (name, overall)
    assert {k: v["items"] for k, v in r.modules.items() if v["items"]} == items
    assert [s["title"] for s in r.sections] == list(FMT.sections)


def test_null_text(spark):
    assert parse(spark, None).overall == ""


def test_questions(spark):
    r = parse(spark, "错误细节：\n1. 第2.1题错，第1.1题也错\n2. 无题号\n3. 第1.1题\n证明题审查：\n1. 见 3.14 与第1题")
    assert [q["question"] for q in r.error_questions] == ["2.1", "1.1", V.UNKNOWN_QUESTION]  # a map keeps no order
    assert r.error_details_by_question["1.1"] == ["第2.1题错，第1.1题也错", "第1.1题"]
    assert dict(r.proof_review_by_question) == {"3.14": ["见 3.14 与第1题"]}


def sections(values):
    return F.array(*(F.struct(F.lit(t).alias("title"), F.lit(raw).alias("raw_text"), F.array(*map(F.lit, items)).cast("array<string>").alias("items")) for t, raw, items in values))


def test_render(spark):
    row = spark.range(1).select(
        V.render_report(F.lit("甲"), F.lit(None).cast("string"), sections([("错误细节", "", [" a ", " "]), ("改进建议", "raw", []), ("空", "", [])])).alias("a"),
        V.render_report(F.lit("甲"), F.lit("x"), sections([("空", "", [])]), empty_item=True).alias("b"),
        V.failure_report(F.lit("乙"), F.lit("坏"), F.array(F.lit("e1"), F.lit("e2")), F.array(F.lit("c"))).alias("c"),
    ).first()
    assert row.a == f"{V.RULE}\n姓名/学号：甲\n整体情况：\n错误细节：\n1. a\n改进建议：\n1. raw\n空：\n{V.RULE}\n"
    assert row.b == f"{V.RULE}\n姓名/学号：甲\n整体情况：x\n空：\n1. \n{V.RULE}\n"
    assert "1. e1\n2. e2\n证明题审查：" in row.c and "人工复核" in row.c


ITEM = st.text(alphabet="甲乙abc xyz，。", min_size=1, max_size=12).map(str.strip).filter(bool)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(ITEM, max_size=3), min_size=3, max_size=3), ITEM, ITEM)
def test_parse_of_render(spark, items, name, overall):
    frame = spark.range(1).select(V.render_report(F.lit(name), F.lit(overall), sections([(t, "", i) for t, i in zip(FMT.sections, items)])).alias("t"))
    r = V.parse_reports(frame, "t", FMT).first()
    assert (r.student_name_or_id, r.overall) == (name, overall)
    assert [s["items"] for s in r.sections] == items


def test_enriched_and_signature(spark):
    payload = json.dumps({"student_name_or_id": "丙", "overall": 5, "modules": {"m": {"raw_text": "r", "items": ["i"]}}})
    text = "姓名/学号：甲\n整体情况：好\n错误细节：\n1. 第1.2题"
    frame = spark.createDataFrame([(payload, text), ("broken", text), (None, text)], "p string, t string")
    rows = V.enriched(frame, "p", "t", FMT).collect()
    assert rows[0].student_name_or_id == "丙" and list(rows[0].modules) == ["m"] and list(rows[0].error_details_by_question) == ["1.2"]
    assert rows[1].student_name_or_id == rows[2].student_name_or_id == "甲" and rows[1].overall == "好" and "错误细节" in rows[2].modules
    same = [{"student_name_or_id": " a ", "overall": "b", "modules": {"x": {"raw_text": "1", "items": ["i ", " "]}, "y": {"items": []}}}, {"overall": "b", "modules": {"y": {"items": [""]}, "x": {"raw_text": "2", "items": ["i"]}}, "student_name_or_id": "a"}]
    other = {"student_name_or_id": "a", "overall": "b", "modules": {"x": {"items": ["j"]}}}
    got = [r.s for r in spark.createDataFrame([(json.dumps(x),) for x in [*same, other]], "p string").select(V.payload_signature(F.col("p")).alias("s")).collect()]
    assert got[0] == got[1] != got[2]


def test_export_text(spark):
    nothing = F.lit(None).cast("string")
    row = spark.range(1).select(
        V.export_text(nothing, F.lit(" a\r\nb "), F.lit("c"), nothing, F.lit("d")).alias("a"),
        V.export_text(F.lit("  "), F.lit("x"), nothing, nothing, nothing).alias("b"),
    ).first()
    assert row.a == "a\nb" and row.b is None


def test_a_long_report(spark):
    lines = ["错误细节："] + [f"{i}. 第{i % 5000}.1题 x" if i % 2 else f"more {i}" for i in range(100_000)]
    row = V.parse_reports(spark.createDataFrame([("\n".join(lines),)], "t string"), "t", FMT).select("sections", "error_questions").first()
    items = row.sections[0]["items"]
    assert len(items) == 50_001 and items[0] == "more 0" and items[1] == "第1.1题 x\nmore 2" and items[-1] == "第4999.1题 x"
    assert [q.question for q in row.error_questions][:3] == [V.UNKNOWN_QUESTION, "1.1", "3.1"] and len(row.error_questions) == 2501
    assert all(len(q["items"]) == 20 for q in row.error_questions[1:])


def test_lines_that_only_mark(spark):
    text = "错误细节：1. a\n2.\nb\n3. \n\n证明题审查：\n=====\nfree\n4) c"
    row = V.parse_reports(spark.createDataFrame([(text,)], "t string"), "t", FMT).select("sections").first()
    assert [s["items"] for s in row.sections][:2] == [["a", "b"], ["free", "c"]]
