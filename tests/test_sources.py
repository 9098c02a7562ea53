import io
import json
import sys
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gradeloom.functions import media
from gradeloom.functions import verdicts as V
from gradeloom.operators import scoring
from gradeloom.sources import archives, files, settings

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have the tests

PNG = b"\x89PNG\r\n\x1a\n" + bytes(20)


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members:
            z.writestr(name, body)
    return out.getvalue()


INNER = zipped([("deep/p1.jpg", b"j1"), ("p1.jpg", b"j2"), ("skip.txt", b"t")])
OUTER = zipped([("dir/", b""), ("dir/p10.png", b"a"), ("p2.PNG", b"b"), ("doc.bin", b"%PDF-1.4"), ("photo", PNG), ("in.zip", INNER), ("notes.md", b"n")])


def test_kinds():
    assert media.kind_of("x.png", INNER) == "zip"  # whatever its name
    assert media.kind_of("x.png", b"%PDF") == "pdf"
    assert media.kind_of("x.JPeG", b"broken") == "image"
    assert media.kind_of(".png", b"broken") is None
    assert media.kind_of("x", PNG) == "image"
    assert media.kind_of("x.txt", b"") is None


def test_expand():
    got = [(n, k) for n, k, _ in archives.expand(OUTER)]
    assert got == [("p10.png", "image"), ("p2.PNG", "image"), ("doc.bin", "pdf"), ("photo", "image"), ("in.zip/p1.jpg", "image"), ("in.zip/p1.jpg", "image")]
    nest = zipped([("p.png", b"1")])
    for _ in range(archives.MAX_DEPTH + 2):
        nest = zipped([("z.zip", nest)])
    with pytest.raises(archives.ArchiveError):
        list(archives.expand(nest))


def test_read_and_preprocess(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "001-甲 乙.zip").write_bytes(OUTER)
    (tmp_path / "raw" / "002.zip").write_bytes(b"not an archive")
    (tmp_path / "raw" / "003.zip").write_bytes(zipped([("a.txt", b"t")]))
    (tmp_path / "raw" / "004.zip").write_bytes(zipped([("a.png", b"t")]))
    (tmp_path / "raw" / "005.zip").write_bytes(zipped([("bad.png", b"t"), ("ok.png", b"t")]))
    (tmp_path / "raw" / "note.txt").write_bytes(b"x")
    found = archives.read_archives(spark, str(tmp_path / "raw"))
    assert sorted(r.student_id for r in found.collect()) == ["001-甲_乙", "002", "003", "004", "005"]
    have = spark.createDataFrame([("004", 1), ("004", 2)], "student_id string, page_no int")

    def png(data):
        if data == b"t":
            raise ValueError("broken image")
        return b"png:" + data

    outcomes, pages = archives.preprocess(found, have, rasterise=lambda d: [b"page1", b"page2"], transcode=png)
    got = {r.student_id: (r.status, r.page_count, r.detail) for r in outcomes.collect()}
    assert got["001-甲_乙"] == ("success", 7, None)
    assert got["002"][0] == "failed" and "BadZipFile" in got["002"][2]
    assert got["003"] == ("failed", 0, "未识别到可处理的 PDF 或图片文件")
    assert got["004"] == ("skipped", 2, None)
    assert got["005"] == ("failed", 0, "broken image")
    rows = pages.orderBy("page_no").collect()
    assert {r.student_id for r in rows} == {"001-甲_乙"}
    assert [bytes(r.content) for r in rows] == [b"page1", b"page2", b"png:j1", b"png:j2", b"png:b", b"png:a", b"png:" + PNG]
    files.write_pages(pages, str(tmp_path / "pages"))
    assert spark.read.parquet(str(tmp_path / "pages")).count() == 7


def test_pages_and_texts(spark, tmp_path):
    for name in ("page_1.png", "page_10.PNG", "page_2.png", "other_3.png", "page_x.png", "page_3.png.txt"):
        (tmp_path / "s1").mkdir(exist_ok=True)
        (tmp_path / "s1" / name).write_bytes(b"1")
    got = files.list_pages(spark, str(tmp_path)).orderBy("page_no").collect()
    assert [(r.student_id, r.page_no) for r in got] == [("s1", 1), ("s1", 2), ("s1", 10)]
    names = spark.createDataFrame([("page_7.png",), ("x.PNG",), ("a_b_9.png",), ("a.jpg",)], "n string")
    assert sorted(r.page_no for r in files.shown_pages(names, "n").collect()) == [0, 7, 9]
    out = tmp_path / "results"
    out.mkdir()
    (out / "甲.txt").write_text("姓名/学号：甲\n整体情况：好\n", encoding="utf-8")
    (out / "乙.txt").write_text("  \n", encoding="utf-8")
    (out / "乙.json").write_text(json.dumps({"overall": "json"}), encoding="utf-8")
    (out / "丙.json").write_text("", encoding="utf-8")
    texts, payloads = files.read_texts(spark, str(out)), files.read_payloads(spark, str(out))
    got = {r.student_id: r.overall for r in files.load_results(payloads, texts, V.read_format(V.DEFAULT_FORMAT)).collect()}
    assert got["甲"] == "好" and got["乙"] == "json" and got.get("丙", "") == ""


def test_written_payload_and_reports(spark, tmp_path):
    texts = spark.createDataFrame([("a", "整体情况：好\n错误细节：\n1. x")], "student_id string, body string")
    parsed = V.parse_reports(texts, "body", V.read_format(V.DEFAULT_FORMAT))
    payload = json.loads(parsed.select(files.payload_column(F.lit("a.txt")).alias("p")).first().p)
    assert payload["overall"] == "好" and payload["parsed_with_output_format"] is True and payload["modules"]["错误细节"]["items"] == ["x"]
    files.write_by_student(texts, "body", str(tmp_path / "t"))
    files.write_by_student(spark.createDataFrame([("b", "z")], "student_id string, body string"), "body", str(tmp_path / "t"))
    back = spark.read.text(str(tmp_path / "t"), wholetext=True)
    assert {(r.student_id, r.value.strip()) for r in back.collect()} == {("a", "整体情况：好\n错误细节：\n1. x"), ("b", "z")}


def test_env(spark):
    text = "# note\nA=1\n B = 'two' \nbad-name=3\nA=\"last\"\nnothing\nC=x=y\nD='odd\"\n"
    want = {"A": "last", "B": "two", "C": "x=y", "D": "'odd\""}
    assert settings.env_of(text) == want
    rows = spark.createDataFrame([(1, i, line) for i, line in enumerate(text.splitlines())], "f int, i int, line string")
    assert {r.name: r.value for r in settings.parse_env_lines(rows, ["f"], "i", "line").collect()} == want
    assert settings.env_text({"b": 'x"', "a": "1"}) == 'a="1"\nb="x\\""\n'
    assert settings.resolve_key("SURELY_NOT_SET", {"SURELY_NOT_SET": "k"}) == ("k", "local_env")
    assert settings.resolve_key("SURELY_NOT_SET", {}) == (None, "missing") and settings.resolve_key("", {})[1] == "missing_env_name"
    assert settings.settings_of("[1]") == settings.settings_of("no") == {} and settings.export_engine({}) == "katex"


def test_config_and_workspace(spark, tmp_path):
    (tmp_path / "c").mkdir()
    subject = dict.fromkeys(settings.SUBJECT_FIELDS, "x")
    (tmp_path / "c" / "one.json").write_text(json.dumps(subject, indent=1), encoding="utf-8")
    (tmp_path / "c" / "two.json").write_text(json.dumps(subject | {"model": " "}), encoding="utf-8")
    got = {r.file: r.missing for r in settings.read_subjects(spark, str(tmp_path / "c")).collect()}
    assert got == {"one": None, "two": "model"}
    space = settings.Workspace(tmp_path / "w", "第 1/周")
    planned = space.create(dry_run=True)
    assert len(planned) == 5 and not (tmp_path / "w").exists()
    assert space.create() == planned and space.create() == [] and len(space.create(force=True)) == 1
    assert settings.safe_week("..") == settings.safe_week(" ") == "new_week"
    assert settings.choose_assignment(["a/x.json"]) == "a/x.json" and settings.choose_assignment(["a/x.json", "b/y.json"], week="y") == "b/y.json"
    with pytest.raises(ValueError):
        settings.choose_assignment(["a", "b"])


class Flaky:
    def __init__(self):
        self.calls = 0

    def __call__(self, prompt, pages):
        self.calls += 1
        if "boom" in prompt:
            raise RuntimeError("boom")
        if "late" in prompt and self.calls == 1:
            return iter([" ", "\n"])
        return iter(["整体", "情况：", "好 "])


def test_scoring(spark):
    students = spark.createDataFrame([("a", ["u"]), ("late", ["u"]), ("boom", ["u"]), ("none", []), ("null", None)], "student_id string, pages array<string>")
    prompts = scoring.build_prompts(students, "{subject_name}|{standard_answer}|{student_name}|{output_format}{x}", {"subject_name": "s", "grading_requirements": "g", "output_format": "f {student_name}"}, "ans")
    assert prompts.where("student_id = 'a'").first().prompt == "s|ans|a|f a{x}"
    out = scoring.with_failure_reports(scoring.score(prompts.repartition(5, "student_id"), Flaky))
    got = {r.student_id: (r.status, r.attempts) for r in out.collect()}
    assert got["a"] == ("success", 1) and got["boom"] == ("failed", 2) and got["none"] == got["null"] == ("failed", 1)
    assert got["late"] in (("success", 2), ("success", 1))
    assert V.NEEDS_REVIEW in {r.student_id: r.body for r in out.collect()}["boom"]
    pages = spark.createDataFrame([("a", 2, b"x"), ("a", 1, b"y"), ("a", 3, None), ("b", 1, b"")], "student_id string, page_no int, content binary")
    got = {r.student_id: (r.pages, r.left_out) for r in scoring.usable_pages(pages).collect()}
    assert got == {"a": (["data:image/png;base64,eQ==", "data:image/png;base64,eA=="], 1), "b": ([], 1)}


def test_local_config_is_read_changed_and_replaced(tmp_path):
    config = settings.LocalConfig(tmp_path / "new" / "keys", tmp_path / "new" / "options.json")
    assert config.keys() == config.options() == {} and settings.export_engine(config.options()) == "katex"
    config.set_key(" A_1 ", " one ")
    config.set_key("B", "two = 2")
    config.set_key("A_1", "again")
    assert config.keys() == {"A_1": "again", "B": "two = 2"}
    config.options_file.write_text('{"other": 1}', encoding="utf-8")
    config.set_engine(" LaTeX ")
    assert config.options() == {"other": 1, "export_engine": "latex"}
    for change in (lambda: config.set_key("1A", "x"), lambda: config.set_key("A", " "), lambda: config.set_engine("word")):
        with pytest.raises(ValueError):
            change()
    assert len(list((tmp_path / "new").iterdir())) == 2


def filtered_png(pixels):
    """A PNG whose lines go through all five filters, written pixel by pixel."""
    import struct
    import zlib

    height, width, channels = pixels.shape
    body = b""
    for y in range(height):
        kind = y % 5
        line = [kind]
        for x in range(width):
            for c in range(channels):
                a = int(pixels[y, x - 1, c]) if x else 0
                b = int(pixels[y - 1, x, c]) if y else 0
                d = int(pixels[y - 1, x - 1, c]) if x and y else 0
                near = sorted(((abs(b - d), 0, a), (abs(a - d), 1, b), (abs(a + b - 2 * d), 2, d)))[0][2]
                line.append((int(pixels[y, x, c]) - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        body += bytes(line)
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return media.PNG_MARK + part(b"IHDR", head) + part(b"IDAT", zlib.compress(body)[:9]) + part(b"IDAT", zlib.compress(body)[9:]) + part(b"IEND", b"")


def test_pngs_are_read_and_made_smaller():
    import numpy as np

    rng = np.random.default_rng(4)
    for channels in (1, 3):
        pixels = rng.integers(0, 256, (11, 7, channels), dtype=np.uint8)
        assert (media.png_pixels(filtered_png(pixels)) == pixels).all()
        assert (media.png_pixels(media.png_bytes(pixels)) == pixels).all()
    big = rng.integers(0, 256, (300, 200, 3), dtype=np.uint8)
    small = media.Shrinker(20_000, (None, 150, 60))(media.png_bytes(big))
    if small.startswith(media.PNG_MARK):  # without the image library
        assert media.png_pixels(small).shape == (60, 40, 3) and len(small) <= 20_000
    flat = media.thumbnail(np.full((10, 10, 1), 7, np.uint8), 3)
    assert flat.shape == (3, 3, 1) and (flat == 7).all()
    with pytest.raises(ValueError):
        media.png_pixels(b"no image")
