import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gradeloom import cli, review
from gradeloom.functions import verdicts as V
from gradeloom.sources.settings import Workspace
from test_sources import zipped

cloudpickle.register_pickle_by_value(sys.modules[__name__])
FMT = V.read_format(V.DEFAULT_FORMAT)


class Client:
    def __call__(self, prompt, pages):
        if "bad" in prompt:
            raise RuntimeError("down")
        return iter([f"姓名/学号：{prompt}\n整体情况：全对\n错误细节：\n1. {len(pages)} pages\n"])


SUBJECT = {"subject_name": "s", "prompt_template": "{student_name}", "grading_requirements": "", "output_format": V.DEFAULT_FORMAT}


def test_new_week(tmp_path, capsys):
    assert cli.main(["new-week", "--root", str(tmp_path), "w1"]) == 0
    assert (tmp_path / "w1" / "raw_submissions").is_dir() and "w1" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["preprocess", "--root", str(tmp_path), "missing"])


def test_week_from_archives_to_summary(spark, tmp_path):
    space = Workspace(tmp_path, "w 1")
    space.create()
    for name in ("a", "bad", "empty"):
        (space.raw / f"{name}.zip").write_bytes(zipped([("1.png", b"x"), ("2.png", b"y")] if name != "empty" else [("n.txt", b"")]))
    copy = lambda d: d
    got = {r.student_id: (r.status, r.page_count) for r in cli.preprocess(spark, space, transcode=copy).collect()}
    assert got == {"a": ("success", 2), "bad": ("success", 2), "empty": ("failed", 0)}
    again = {r.student_id: r.status for r in cli.preprocess(spark, space, transcode=copy).collect()}
    assert again == {"a": "skipped", "bad": "skipped", "empty": "failed"}
    assert spark.read.parquet(str(space.pages)).count() == 4
    first = {r.student_id: (r.status, r.attempts) for r in cli.grade(spark, space, SUBJECT, "answer", Client, workers=2).collect()}
    assert first == {"a": ("success", 1), "bad": ("failed", 2)}
    second = {r.student_id: r.status for r in cli.grade(spark, space, SUBJECT, "answer", Client, workers=2).collect()}
    assert second == {"a": "skipped", "bad": "failed"}  # a failure is tried again
    parsed = {r.student_id: json.loads(r.payload) for r in spark.read.parquet(str(space.results / cli.PARSED)).collect()}
    assert parsed["a"]["modules"]["错误细节"]["items"] == ["2 pages"] and V.NEEDS_REVIEW in parsed["bad"]["overall"]
    text = spark.read.text(str(space.results / cli.SUMMARY / "grading_summary"), wholetext=True).first().value
    assert "总学生数：2" in text and "跳过数：1" in text and "- bad: RuntimeError: down" in text


def test_review(spark):
    pages = spark.createDataFrame([("Al", 2), ("Al", 1), ("bo", 1)], "student_id string, page_no int")
    texts = spark.createDataFrame([("Al", "整体情况：旧"), ("bo", "")], "student_id string, body string")
    payloads = spark.createDataFrame([("zz", "{}")], "student_id string, payload string")
    got = {r.student_id: (r.page_count, r.has_result) for r in review.students(pages, texts, payloads).collect()}
    assert got == {"Al": (2, True), "bo": (1, False)}
    assert [r.student_id for r in review.students(pages, texts, payloads, " AL ").collect()] == ["Al"]
    payload = json.dumps({"student_name_or_id": "甲", "overall": "新", "modules": {"错误细节": {"items": ["第1.2题"]}}})
    edits = spark.createDataFrame([("Al", payload, None, 2), ("Al", "{}", "整体情况：早", 1), ("bo", payload, "整体情况：文", 1)], "student_id string, payload string, rendered string, version int")
    new, stored, requests = review.save(texts, edits, FMT)
    bodies = {r.student_id: r.body for r in new.collect()}
    assert "1. 第1.2题" in bodies["Al"] and bodies["bo"] == "整体情况：文"
    assert json.loads({r.student_id: r.payload for r in stored.collect()}["Al"])["error_details_by_question"] == {"1.2": ["第1.2题"]}
    assert {r.student_id for r in requests.where("urgent").collect()} == {"Al", "bo"}
    one = review.student(pages, V.parse_reports(texts, "body", FMT), "Al").first()
    assert one.images == ["/images/Al/page_1.png", "/images/Al/page_2.png"] and one.report.overall == "旧"
    changed = review.edited(spark.createDataFrame([("a", "{}"), ("b", '{"overall": "x "}')], "student_id string, payload string"), spark.createDataFrame([("a", '{"overall": "y"}'), ("b", '{"overall": "x"}'), ("c", "{}")], "student_id string, payload string"))
    assert sorted(r.student_id for r in changed.collect()) == ["a", "c"]


def test_tasks_and_logs(spark):
    schema = "taskId string, task string, weekId string, status string, startedAt double, returnCode int, error string, seq int"
    events = spark.createDataFrame([("1", "grading", "w", "failed", 1.0, 2, None, 1), ("2", "grading", "w", "success", 2.0, 0, None, 2)], schema)
    assert [(r.taskId, r.label) for r in review.tasks(events).collect()] == [("2", "成功")]
    assert review.task(events, "1").first().status == "failed" and review.task(events, "9").count() == 0
    lines = spark.createDataFrame([("1", i, f"l{i}") for i in range(5)], "taskId string, line_no int, line string")
    assert [(r.line, r.total) for r in review.task_log(lines, "1", 3).orderBy("line_no").collect()] == [("l3", 5), ("l4", 5)]
    records = spark.createDataFrame([("a", "ready", "t", 5.0), ("b", "rendering", "", 0.0)], "student_id string, status string, text string, cached_at double")
    sources = spark.createDataFrame([("a", 5.0), ("c", 1.0)], "student_id string, source_at double")
    got = {r.student_id: r.status for r in review.export_status(records, sources).collect()}
    assert got == {"a": "ready", "b": "rendering", "c": "stale"}
    weeks = review.weeks(spark.createDataFrame([("w1", "一", "s")], "assignment_id string, week_name string, subject_config string"), spark.createDataFrame([("w1", 1.0), ("w2", 2.0)], "week string, created_at double"))
    assert {r.week: r["name"] for r in weeks.collect()} == {"w1": "一", "w2": "w2"}
    assert weeks.where(F.col("subject_config") == "").count() == 1


def test_the_week_of_an_assignment(tmp_path):
    with pytest.raises(ValueError):
        cli.chosen_week(tmp_path, None, None)
    Workspace(tmp_path, "w 1").create()
    assert cli.chosen_week(tmp_path, None, None) == "w 1" and cli.chosen_week(tmp_path, "x", None) == "x"
    Workspace(tmp_path, "w2").create()
    with pytest.raises(ValueError):
        cli.chosen_week(tmp_path, None, None)
    assert cli.chosen_week(tmp_path, None, str(tmp_path / "w2" / "assignment.json")) == "w2"


def test_one_student_is_graded(spark):
    good, report = cli.grade_one(spark, "Al", [b"x", b"y"], SUBJECT, "answer", Client)
    assert good and "1. 2 pages" in report and "Al" in report
    good, report = cli.grade_one(spark, "bad", [b"x"], SUBJECT, "answer", Client)
    assert not good and V.NEEDS_REVIEW in report and "RuntimeError: down" in report
