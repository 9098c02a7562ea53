"""Queries that call single operators of the library on made-up files, reports and requests of all rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from gradeloom import review
from gradeloom.functions import latex, media
from gradeloom.functions import text as T
from gradeloom.functions import verdicts as V
from gradeloom.operators import scoring
from gradeloom.plans.registry import Registry, table
from gradeloom.sources import files

REGISTRY = Registry()
query = REGISTRY.query

FORMAT = V.read_format(V.DEFAULT_FORMAT)


def _md5(column):
    return F.md5(column.cast("binary"))


@query(r"""SELECT doc_id, len(a)::INT AS n_lines, md5(array_to_string(a, '|')) AS lines_md5 FROM
(SELECT doc_id, CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END AS a FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS x FROM documents))""")
def split_lines(spark, sf_dir):
    """Lines of texts at every break that ends a line."""
    lines = T.split_lines(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).alias("n_lines"), _md5(F.array_join(lines, "|")).alias("lines_md5"))


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(html, '[＼﹨∖]', '\\', 'g'), '(^|[\s{\[(,;:=<>+\-*])[/／]([A-Za-z]+)\b', '\1\\\2', 'g')) AS repaired_md5,
md5(regexp_replace(html, '([.*+?^${}()|\[\]\\])', '\\\1', 'g')) AS pattern_md5 FROM pages""")
def slash_repair(spark, sf_dir):
    """Slashes before letters as backslashes, and texts as patterns of themselves."""
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", _md5(T.command_slashes(html)).alias("repaired_md5"), _md5(T.quoted_pattern(html)).alias("pattern_md5"))


@query(r"""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '…' WHEN 1 THEN ' ' WHEN 2 THEN '…' ELSE c_name END AS cell FROM customer""")
def cell_texts(spark, sf_dir):
    """Matrix cells for display."""
    cell = F.expr(r"CASE c_custkey % 5 WHEN 0 THEN ' ... ' WHEN 1 THEN '  ' WHEN 2 THEN '\\cdots' WHEN 3 THEN concat(' ', c_name) ELSE c_name END")
    return table(spark, sf_dir, "customer").select("c_custkey", T.cell_text(cell).alias("cell"))


@query(r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN regexp_extract(url, '[^/]+$') END AS name FROM pages WHERE regexp_matches(url, '^[^;"'']+[^/;"'']$')""")
def attachment_names(spark, sf_dir):
    """File names of headers: encoded, plain, or none."""
    pages = table(spark, sf_dir, "pages").where(F.col("url").rlike(r"^[^;\"']+[^/;\"']$"))
    last = F.regexp_extract("url", "[^/]+$", 0)
    header = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("attachment; filename*=UTF-8''"), T.url_part(F.col("url")))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('attachment; filename="'), last, F.lit('"'))).otherwise("inline")
    return pages.select("page_id", T.attachment_name(header).alias("name"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber END::INT AS page_no, CASE WHEN l_linenumber % 3 = 2 THEN 0 ELSE l_linenumber END::INT AS shown_no
FROM lineitem WHERE l_linenumber % 3 <> 2 UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linenumber::INT, l_linenumber::INT FROM lineitem WHERE l_linenumber % 3 = 2""")
def page_names(spark, sf_dir):
    """Numbers of page files: of pages proper, and as a viewer shows all of them."""
    name = F.expr("CASE l_linenumber % 3 WHEN 0 THEN concat('scan_', l_linenumber, '.png') WHEN 1 THEN concat('page_', l_linenumber, '.png') ELSE concat('PAGE_0', l_linenumber, '.PNG') END")
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    rows = table(spark, sf_dir, "lineitem").select(*keys, name.alias("name"))
    shown = files.shown_pages(rows, "name").withColumnRenamed("page_no", "shown_no")
    number = F.when(F.col("name").rlike(files.PAGE), F.regexp_extract("name", files.PAGE, 1).cast("int"))
    assert files.page_numbers(rows, "name").columns == [*keys, "name", "page_no"]
    return shown.select(*keys, number.alias("page_no"), "shown_no")


def _payloads(spark, sf_dir, title: str, item):
    """A JSON payload for each order."""
    sections = F.create_map(F.lit(title), F.struct(F.lit("").alias("raw_text"), F.array(item, F.lit(" ")).alias("items")))
    payload = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("student_name_or_id"), F.col("o_orderpriority").alias("overall"), sections.alias("modules")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("student_id"), payload.alias("payload"))


@query("""SELECT o_orderkey::VARCHAR AS student_id FROM orders WHERE o_orderkey % 3 = 0""")
def payload_changes(spark, sf_dir):
    """Students whose edited report says something else; blanks around don't matter."""
    old = _payloads(spark, sf_dir, V.ERROR_SECTION, F.concat(F.lit("第1.1题 "), "o_orderstatus"))
    new = _payloads(spark, sf_dir, V.ERROR_SECTION, F.when(F.col("o_orderkey") % 3 == 0, F.lit("other")).otherwise(F.concat(F.lit("  第1.1题 "), "o_orderstatus", F.lit("\u3000"))))
    return review.edited(old, new)


@query(f"""SELECT o_orderkey::VARCHAR AS student_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 0 THEN 'from text' ELSE '' END AS overall,
CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 0 THEN '第2.1题 ' || o_orderkey END AS item,
CASE WHEN o_orderkey % 3 = 0 THEN '2.1' END AS question FROM orders""")
def loaded_results(spark, sf_dir):
    """Reports from payloads, else from texts, else empty; maps by question always come from the text."""
    payloads = _payloads(spark, sf_dir, V.ERROR_SECTION, F.col("o_orderstatus"))
    payloads = payloads.withColumn("payload", F.when(F.col("student_id").cast("long") % 2 == 0, F.col("payload")).otherwise(""))
    text = F.concat(F.lit(f"{V.NAME_LABEL}：x\n{V.OVERALL_PREFIX}：from text\n{V.ERROR_SECTION}：\n1. 第2.1题 "), F.col("o_orderkey").cast("string"))
    texts = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("student_id"), text.alias("body"))
    rows = files.load_results(payloads, texts, FORMAT)
    items = F.try_element_at("modules", F.lit(V.ERROR_SECTION))["items"]
    return rows.select("student_id", "overall", F.get(items, F.lit(0)).alias("item"), F.get(F.map_keys("error_details_by_question"), F.lit(0)).alias("question"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'shown ' || o_orderkey WHEN 1 THEN 'stored' WHEN 2 THEN o_orderstatus END AS text FROM orders""")
def export_texts(spark, sf_dir):
    """The text that is exported: the first that is there, nothing if it's blank."""
    part = lambda n, x: F.when(F.col("o_orderkey") % 4 == n, x)
    key = F.col("o_orderkey").cast("string")
    text = V.export_text(part(0, F.concat(F.lit(" shown "), key, F.lit("\r\n"))), F.lit(None).cast("string"), part(1, F.lit("stored")), part(2, F.col("o_orderstatus")), F.lit("\r\n \u3000"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))


@query(f"""SELECT o_orderkey::VARCHAR AS student_id, CASE WHEN o_orderkey % 2 = 0 THEN 'edit ' || o_orderkey
WHEN o_orderkey % 3 = 0 THEN '{V.RULE}' || chr(10) || '姓名/学号：' || o_orderkey || chr(10) || '整体情况：' || o_orderpriority || chr(10) || '改进建议：' || chr(10) || '1. ' || o_orderstatus || chr(10) || '{V.RULE}' || chr(10)
ELSE 'old' END AS body, o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 AS urgent FROM orders""")
def saved_edits(spark, sf_dir):
    """Texts after edits, by their own words or written from their payload, and the requests that follow."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("student_id"))
    edits = _payloads(spark, sf_dir, V.ADVICE_SECTION, F.col("o_orderstatus")).where("student_id % 2 = 0 OR student_id % 3 = 0")
    edits = edits.withColumn("rendered", F.when(F.col("student_id") % 2 == 0, F.concat(F.lit("edit "), "student_id"))).withColumn("version", F.lit(2))
    earlier = edits.withColumn("version", F.lit(1)).withColumn("rendered", F.lit("earlier"))
    texts, _, requests = review.save(keys.withColumn("body", F.lit("old")), edits.unionByName(earlier), FORMAT)
    return texts.join(requests.select("student_id", "urgent"), "student_id", "left").select("student_id", "body", F.coalesce("urgent", F.lit(False)).alias("urgent"))


@query("""SELECT n_name AS week, CASE WHEN n_nationkey < 12 THEN 'week ' || n_nationkey ELSE n_name END AS name, CASE WHEN n_nationkey < 12 THEN 's' || n_regionkey ELSE '' END AS subject_config, n_nationkey::DOUBLE AS created_at FROM nation""")
def week_projection(spark, sf_dir):
    """Weeks with what their configuration says, or their defaults."""
    nation = table(spark, sf_dir, "nation")
    configs = nation.where("n_nationkey < 12").select(F.col("n_name").alias("assignment_id"), F.concat(F.lit("week "), F.col("n_nationkey").cast("string")).alias("week_name"), F.concat(F.lit("s"), F.col("n_regionkey").cast("string")).alias("subject_config"))
    return review.weeks(configs, nation.select(F.col("n_name").alias("week"), F.col("n_nationkey").cast("double").alias("created_at")))


@query("""SELECT c_name AS student_id, n AS page_count, c_custkey % 2 = 0 OR c_custkey % 3 = 0 AS has_result, FALSE AS has_export_image FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE contains(lower(c_name), '1')""")
def review_students(spark, sf_dir):
    """The list of students that a reviewer searches."""
    customer = table(spark, sf_dir, "customer")
    pages = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("student_id"))
    texts = customer.select(F.col("c_name").alias("student_id"), F.when(F.col("c_custkey") % 2 == 0, "x").otherwise("").alias("body"))
    payloads = customer.where("c_custkey % 3 = 0").select(F.col("c_name").alias("student_id"), F.lit("{}").alias("payload"))
    return review.students(pages, texts, payloads, " 1 ")


@query("""SELECT c_name AS student_id, '/images/' || replace(c_name, '#', '%23') || '/page_' || min(o_orderkey) || '.png' AS first_image, count(*)::INT AS images, 'o' AS overall
FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey = (SELECT min(o_custkey) FROM orders) GROUP BY c_name""")
def review_student(spark, sf_dir):
    """One student's pages and report: the student with the least number that has any."""
    first = table(spark, sf_dir, "orders").agg(F.min("o_custkey").alias("c_custkey"))
    named = table(spark, sf_dir, "customer").join(first, "c_custkey").select("c_custkey", F.col("c_name").alias("student_id"))
    student_id = named.first().student_id
    pages = table(spark, sf_dir, "orders").join(named, F.col("o_custkey") == F.col("c_custkey")).select("student_id", F.col("o_orderkey").alias("page_no"))
    text = named.select("student_id", F.lit(f"{V.OVERALL_PREFIX}：o").alias("body"))
    results = V.parse_reports(text, "body", FORMAT)
    return review.student(pages, results, student_id).select("student_id", F.get("images", F.lit(0)).alias("first_image"), F.size("images").alias("images"), F.col("report.overall").alias("overall"))


@query("""SELECT user_id::VARCHAR || '-' || event_type AS task_id, event_id FROM events WHERE event_id = (SELECT min(event_id) FROM events)""")
def one_task(spark, sf_dir):
    """A task by its id."""
    events = table(spark, sf_dir, "events").select(F.concat_ws("-", F.col("event_id").cast("string")).alias("taskId"), F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("task_id"), "event_id")
    least = str(events.agg(F.min("event_id")).first()[0])
    return review.task(events, least).select("task_id", "event_id")


@query("""SELECT line_no::BIGINT AS line_no, event_type AS line, total FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) - 1 AS line_no, count(*) OVER () AS total FROM events WHERE user_id = (SELECT min(user_id) FROM events)) WHERE line_no >= 5 AND line_no < 15""")
def task_log_page(spark, sf_dir):
    """Ten lines of one task's log from its sixth on, with its length."""
    events = table(spark, sf_dir, "events")
    lines = events.select(F.col("user_id").cast("string").alias("taskId"), F.col("event_id").alias("line_no"), F.col("event_type").alias("line"))
    return review.task_log(lines, str(events.agg(F.min("user_id")).first()[0]), 5, 10)


@query("""SELECT p_partkey, p_partkey % 4 <> 3 AS editable FROM part""")
def editable_sections(spark, sf_dir):
    """Sections whose items a reviewer may add and take out."""
    title = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('一、错误细节 ', p_brand) WHEN 1 THEN '证明题审查' WHEN 2 THEN '改进建议（可选）' ELSE p_brand END")
    return table(spark, sf_dir, "part").select("p_partkey", V.editable_section(title).alias("editable"))


@query(r"""SELECT doc_id, '/frac \(\frac{' || doc_id || '}\) \[ \sum x \] $$\beta$$ and $\alpha$ a/b' AS repaired, 'fi' || doc_id || '≠≮ A' AS plain,
'a\_b' || doc_id || '\par' || chr(10) || '$x$' AS body, '(' AS mark, 'a,' || doc_id AS first_row FROM documents""")
def formulas(spark, sf_dir):
    """Formulas with their slashes put right between their own marks; plain characters; LaTeX bodies; arrays in brackets."""
    key = F.col("doc_id").cast("string")
    made = F.concat(F.lit("/frac \\(/frac{"), key, F.lit("}\\) \\[ ／sum x \\] $$/beta$$ and $＼alpha$ a/b"))
    odd = F.concat(F.lit("ﬁ\u200b"), key, F.lit("=\u200d\u0338<\u0338 Ａ\x00"))
    body = F.concat(F.lit("a_b"), key, F.lit("\r\n$ x $ $$ $$"))
    array = F.concat(F.lit("\\left( \\begin{array}{cc} a & "), key, F.lit(" \\\\ c \\end{array} \\right]"))
    docs = table(spark, sf_dir, "documents").select("doc_id", made.alias("made"), odd.alias("odd"), body.alias("raw"), array.alias("array"))
    parsed = latex.matrix_of(F.col("array"))
    return docs.select("doc_id", latex.repaired_math_of(F.col("made")).alias("repaired"), latex.normal_characters_of(F.col("odd")).alias("plain"), latex.latex_body_of(F.col("raw")).alias("body"), parsed["left"].alias("mark"), F.array_join(parsed["rows"][0], ",").alias("first_row"))


@query("""SELECT doc_id, regexp_matches(made, '\\\\begin\\{(matrix|pmatrix|bmatrix|Bmatrix|vmatrix|Vmatrix|array|cases|aligned|smallmatrix)\\}') AS matrix FROM
(SELECT doc_id, text || ' \\begin{' || ['matrix', 'vmatrix', 'align', 'cases', 'aligned'][1 + doc_id % 5] || '}' AS made FROM documents)""")
def matrix_kinds(spark, sf_dir):
    """Which texts hold a matrix, each with an environment put behind it."""
    names = F.array(*map(F.lit, ("matrix", "vmatrix", "align", "cases", "aligned")))
    made = F.concat("text", F.lit(" \\begin{"), F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")), F.lit("}"))
    return table(spark, sf_dir, "documents").select("doc_id", T.has_matrix(made).alias("matrix"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'image' WHEN 3 THEN 'image' END AS kind,
CASE page_id % 5 WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/jpeg' WHEN 4 THEN 'application/pdf' ELSE 'image/jpeg' END AS mime FROM pages""")
def file_kinds(spark, sf_dir):
    """Kinds and types of files of every sort."""
    name = F.expr("CASE page_id % 5 WHEN 0 THEN 'a.txt' WHEN 1 THEN 'x/B.PNG' WHEN 2 THEN 'c.jpg' WHEN 3 THEN 'c.Jpeg' ELSE 'd.pdf' END")
    content = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("%PDF-1.4 "), F.coalesce("html", F.lit("")))).otherwise(F.coalesce("html", F.lit(""))).cast("binary")
    pages = table(spark, sf_dir, "pages").withColumns({"name": name, "content": content})
    return pages.select("page_id", media.quick_kind(F.col("name"), F.col("content")).alias("kind"), media.mime_type(F.col("name")).alias("mime"))


def _noise_pages(pages):
    """A grey PNG for each page: of noise that hardly shrinks, 64 pixels wide for even numbers and 20 for odd ones."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for n in part["page_id"]:
                side = 64 if n % 2 == 0 else 20
                noise = b"".join(hashlib.sha256(b"%d:%d" % (n, i)).digest() for i in range(side * side // 32 + 1))
                rows.append((f"s{n // 4}", int(n), media.png_bytes(media.np.frombuffer(noise[: side * side], "u1").reshape(side, side, 1)) if n % 7 else b"no image" * 400))
            yield pd.DataFrame(rows, columns=["student_id", "page_no", "content"])

    return pages.select("page_id").mapInPandas(run, "student_id string, page_no long, content binary")


@query("""SELECT 's' || page_id // 4 AS student_id, count(*) FILTER (page_id % 7 <> 0) AS pages, count(*) FILTER (page_id % 7 = 0) AS left_out,
coalesce(string_agg(CASE WHEN page_id % 2 = 0 THEN '32x32' ELSE '20x20' END, ',' ORDER BY page_id) FILTER (page_id % 7 <> 0), '') AS sizes FROM pages GROUP BY page_id // 4""")
def compressed_pages(spark, sf_dir):
    """Pages over the limit made smaller, those that can't be read left out and counted."""
    pages = _noise_pages(table(spark, sf_dir, "pages"))
    out = scoring.usable_pages(pages, limit=2000, compress=media.Shrinker(2000, (None, 32, 16)))
    # The size stands in the bytes 16 to 23 of a PNG.
    head = lambda uri: F.unbase64(F.substring_index(uri, ",", -1))
    side = lambda uri, at: F.conv(F.hex(F.substring(head(uri), at, 4)), 16, 10)
    sizes = F.array_join(F.transform("pages", lambda u: F.concat(side(u, 17), F.lit("x"), side(u, 21))), ",")
    return out.select("student_id", F.size("pages").cast("long").alias("pages"), F.col("left_out").cast("long").alias("left_out"), sizes.alias("sizes"))


