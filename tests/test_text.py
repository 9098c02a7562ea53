import pytest
from pyspark.sql import functions as F

from gradeloom.functions import text as T


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("expr, value, want", [
    (T.strip, "　 a b\t ", "a b"),
    (T.rstrip, " a \n", " a"),
    (T.collapse_space, "　a \n\t b\x1f", "a b"),
    (T.safe_name, "  a/b:*c  d　e ", "a_b_c_d_e"),
    (T.safe_name, " 　", "unknown_student"),
    (T.strip_colon, " label：: ", "label"),
    (T.strip_quotes, "'a'", "a"),
    (T.strip_quotes, "'a\"", "'a\""),
    (T.strip_quotes, "'", "'"),
    (T.escape_quoted, 'a\\b"', 'a\\\\b\\"'),
    (T.unix_lines, "a\r\nb\rc", "a\nb\nc"),
    (lambda c: T.unix_lines(c, lone=False), "a\r\nb\rc", "a\nb\rc"),
    (T.lines_of, "a\n\n", ["a", "", ""]),
    (T.split_lines, "a\r\nb\x0bc d\n", ["a", "b", "c", "d"]),
    (T.split_lines, "", []),
    (T.label_of, "  第一 ： 值: x", "第一"),
    (T.value_of, "label： 值: x ", "值: x"),
    (T.label_of, "no label", None),
    (T.label_of, "：x", None),
    (T.suffix_of, "a/b.tar.GZ", ".gz"),
    (T.suffix_of, ".hidden", ""),
    (T.stem_of, "a/b.tar.gz", "b.tar"),
    (T.stem_of, "/x/.env", ".env"),
    (T.latex_text, "a_{b}\\~", "a\\_\\{b\\}\\textbackslash{}\\textasciitilde{}"),
    (T.html_text, "<a href='x'>&", "&lt;a href=&#39;x&#39;&gt;&amp;"),
    (T.command_slashes, "/frac{a} b/c ＼d", "\\frac{a} b/c \\d"),
    (T.quoted_pattern, "a.b*(c)", "a\\.b\\*\\(c\\)"),
    (T.cell_text, " ... ", "…"),
    (T.cell_text, "  ", " "),
    (T.url_part, "a b/ü~*", "a%20b%2F%C3%BC~%2A"),
    (T.url_text, "a%20b+c", "a b+c"),
    (T.attachment_name, "attachment; filename*=UTF-8''%E4%BD%9C.png", "作.png"),
    (T.attachment_name, 'attachment; filename="x y.png"', "x y.png"),
    (T.attachment_name, "inline", None),
    (lambda c: T.fill(c, {"a": F.lit("1"), "b": F.lit("2")}), "{a}{b}{c}", "12{c}"),
    (lambda c: T.last_lines(T.lines_of(c), 2), "a\nb\nc", ["b", "c"]),
    (lambda c: T.last_lines(T.lines_of(c), 5), "a\nb", ["a", "b"]),
    (T.question_ids, "3.14 与 第1.2题, 第 2.1 (3) 题, 第1题, 1.2", ["1.2", "2.1 (3)", "3.14"]),
    (T.has_matrix, "x \\begin{pmatrix} 1", True),
    (T.has_matrix, "begin{pmatrix}", False),
    (lambda c: T.numbered(F.split(c, ",")), "x,y", "1. x\n2. y"),
])
def test_functions(spark, expr, value, want):
    assert one(spark, expr, value) == want


def test_natural_order(spark):
    names = ["p10", "p2", "P1", "p1a", "p1", "10", "9", "a1", "1a", "page_2.png", "page_10.png", "x007", "x7", "b/2", "b/10"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(T.natural_key(F.col("n")), "n").collect()
    got = [r.n for r in rows]
    assert got.index("p2") < got.index("p10") and got.index("page_2.png") < got.index("page_10.png") and got.index("b/2") < got.index("b/10")
    assert got.index("9") < got.index("10") < got.index("a1") and got.index("1a") < got.index("a1")
    assert abs(got.index("p1") - got.index("P1")) == 1 and abs(got.index("x7") - got.index("x007")) == 1


def test_markdown(spark):
    text = "======\r\n姓名/学号： 张三\n整体情况: 好\n\n\n错误细节：\n1. a\n---------\n"
    assert one(spark, T.markdown, text) == "**姓名/学号：**张三\n**整体情况：**好\n\n## 错误细节\n\n1. a"
