"""Queries on names and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import media
from gradeloom.functions import text as T
from gradeloom.functions import verdicts as V
from gradeloom.operators import decisions, ordered
from gradeloom.plans.registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

#: The class of white space as the SQL engine writes it.
WS = r"\t\n\x{0b}\f\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STRIP = lambda x: f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[\\/:*?"<>|]+', '_', 'g'), '[ \t]+', '_', 'g'), ''), 'unknown_student') AS safe FROM pages""")
def sanitize_ids(spark, sf_dir):
    """Addresses as file names."""
    return table(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("safe"))


@query(r"""SELECT safe, count(*) AS n FROM (SELECT DISTINCT source, regexp_replace(regexp_replace(source, '[0-9]$', ''), '^src$', 'src_') AS safe FROM documents) GROUP BY safe HAVING count(*) > 1""")
def id_collisions(spark, sf_dir):
    """Names that are one after cleaning."""
    safe = F.regexp_replace(F.regexp_replace("source", "[0-9]$", ""), "^src$", "src/")
    return decisions.id_collisions(table(spark, sf_dir, "documents"), "source", T.safe_name(safe))


@query(r"""SELECT source, row_number() OVER (ORDER BY regexp_extract(source, '^[^0-9]*'), regexp_extract(source, '[0-9]+')::INT) AS place FROM (SELECT DISTINCT source FROM documents)""")
def natural_order(spark, sf_dir):
    """Sources with their numbers by value. There are few sources, so they are put in order in one task."""
    from pyspark.sql import Window

    names = table(spark, sf_dir, "documents").select("source").distinct()
    return names.select("source", F.row_number().over(Window.orderBy(T.natural_key(F.col("source")), "source")).alias("place"))


@query(r"""WITH found AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)+(?:\s*\([0-9]+\))?') AS a FROM documents)
SELECT doc_id, q AS question, min(i)::INT AS pos FROM (SELECT doc_id, unnest(a) AS q, unnest(range(1, len(a) + 1)) AS i FROM found) GROUP BY doc_id, q""")
def question_ids(spark, sf_dir):
    """Dotted numbers in a text, each with the place at which it is first named."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"[0-9]\.[0-9]"))
    found = F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)+(?:\s*\([0-9]+\))?)"), F.lit(1))
    rows = docs.select("doc_id", T.question_ids(F.col("text")).alias("ids"), found.alias("all"))
    rows = rows.select("doc_id", F.explode("ids").alias("question"), "all")
    return rows.select("doc_id", "question", F.array_position("all", F.col("question")).cast("int").alias("pos"))


@query(r"""SELECT page_id, CASE WHEN starts_with(html, '%PDF') THEN 'pdf' WHEN regexp_matches(lower(url), '\.(jpg|jpeg|png)$') THEN 'image' END AS kind,
CASE WHEN regexp_matches(lower(url), '[^/]\.png$') THEN 'image/png' WHEN regexp_matches(lower(url), '[^/]\.pdf$') THEN 'application/pdf' ELSE 'image/jpeg' END AS mime, regexp_extract(lower(url), '[^/](\.[^./]+)$', 1) AS suffix FROM pages""")
def mime_kind(spark, sf_dir):
    """Kinds by first bytes, then by suffix; the type of a suffix."""
    pages = table(spark, sf_dir, "pages")
    content = F.col("html").cast("binary")
    return pages.select("page_id", media.quick_kind(F.col("url"), content).alias("kind"), media.mime_type(F.col("url")).alias("mime"), T.suffix_of(F.col("url")).alias("suffix"))


@query("""SELECT doc_id, md5('data:image/jpeg;base64,' || base64(encode(text))) AS uri_md5, (23 + 4 * ((strlen(text) + 2) // 3))::BIGINT AS uri_bytes,
strlen(text) > 7340032 AS needs_compression, 23 + 4 * ((strlen(text) + 2) // 3) > 10485760 AS too_long FROM documents""")
def data_uri(spark, sf_dir):
    """Contents as data addresses, with their size against the limits."""
    body = F.col("text").cast("binary")
    uri = media.data_uri(body, F.lit("image/jpeg"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(uri.cast("binary")).alias("uri_md5"), F.octet_length(uri).cast("long").alias("uri_bytes"),
        media.needs_compression(body).alias("needs_compression"), media.uri_too_long(uri).alias("too_long"))


@query(r"""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS html_md5,
md5(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', chr(1)), '{', '\{'), '}', '\}'), '#', '\#'), '$', '\$'), '%', '\%'), '&', '\&'), '_', '\_'), '~', '\textasciitilde{}'), '^', '\textasciicircum{}'), chr(1), '\textbackslash{}')) AS latex_md5
FROM documents""")
def escapes(spark, sf_dir):
    """Texts made safe for HTML and for LaTeX."""
    docs = table(spark, sf_dir, "documents")
    digest = lambda c: F.md5(c.cast("binary"))
    return docs.select("doc_id", digest(T.html_text(F.col("text"))).alias("html_md5"), digest(T.latex_text(F.col("text"))).alias("latex_md5"))


@query(rf"""SELECT c_custkey, regexp_replace({STRIP("c_mktsegment || '：: '")}, '[：:]+$', '') AS bare, c_name AS unquoted,
replace(replace(c_name || '\"', '\', '\\'), '"', '\"') AS escaped, regexp_replace(c_name, '[{WS}]+', ' ', 'g') AS collapsed,
split_part('K=' || c_name || '=x', '=', 1) AS env_key, c_name || '=x' AS env_value FROM customer""")
def small_text_functions(spark, sf_dir):
    """Colons, quotes, escapes and splits of names."""
    name = F.col("c_name")
    pair = F.concat(F.lit("K="), name, F.lit("=x"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", T.strip_colon(F.concat("c_mktsegment", F.lit("：: "))).alias("bare"), T.strip_quotes(F.concat(F.lit("'"), name, F.lit("'"))).alias("unquoted"),
        T.escape_quoted(F.concat(name, F.lit('\\"'))).alias("escaped"), T.collapse_space(F.concat(F.lit("\u3000 "), name, F.lit(" \t"))).alias("collapsed"),
        T.before_first(pair, "=").alias("env_key"), T.after_first(pair, "=").alias("env_value"))


@query(r"""SELECT doc_id, (1 + length(text) - length(replace(text, chr(10), '')))::INT AS n_lines, md5(replace(text, chr(10), chr(13) || chr(10))) AS windows_md5, md5(regexp_replace(replace(text, chr(10), chr(13) || chr(10)), '\r\n?', chr(10), 'g')) AS unix_md5 FROM documents""")
def line_breaks(spark, sf_dir):
    """Lines, and line breaks made one way."""
    docs = table(spark, sf_dir, "documents")
    windows = F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))
    digest = lambda c: F.md5(c.cast("binary"))
    return docs.select("doc_id", F.size(T.lines_of(F.col("text"))).alias("n_lines"), digest(windows).alias("windows_md5"), digest(T.unix_lines(windows)).alias("unix_md5"))


@query("""SELECT page_id, url_encode(url) AS coded, url AS plain FROM pages""")
def url_codes(spark, sf_dir):
    coded = T.url_part(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", coded.alias("coded"), T.url_text(coded).alias("plain"))


@query("""SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS stem FROM pages""")
def page_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.before_first(T.after_first(F.col("url"), "://"), "/").alias("stem"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, FALSE AS broken FROM events""")
def json_fields(spark, sf_dir):
    """Fields of JSON texts; what does not parse is marked and not an error."""
    typed = F.from_json("props", "k long", {"mode": "PERMISSIVE"})
    return table(spark, sf_dir, "events").select("event_id", typed["k"].alias("k"), F.expr("try_parse_json(props) IS NULL").alias("broken"))


@query("""SELECT user_id, event_type AS name, arg_max(value, event_id)::VARCHAR AS value FROM events WHERE event_type <> 'error' GROUP BY user_id, event_type""")
def env_parse(spark, sf_dir):
    """Settings files: comments and bad names are left out, quotes come off, the last of a name wins."""
    from gradeloom.sources.settings import parse_env_lines

    line = F.when(F.col("event_type") == "error", F.concat(F.lit("# "), "event_type", F.lit("=1"))).when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit('="'), F.col("value").cast("string"), F.lit('"'))).otherwise(
        F.concat(F.lit("  "), "event_type", F.lit(" = "), F.col("value").cast("string")))
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("line_no"), line.alias("line"))
    return parse_env_lines(rows, ["user_id"], "line_no", "line")


@query("""SELECT doc_id, pos, header AS section FROM (SELECT doc_id, pos, last_value(CASE WHEN pos % 4 = 0 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS header, last_value(CASE WHEN pos % 11 = 10 OR pos % 4 = 0 THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS mark
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10)))))::INT AS pos FROM documents)) WHERE mark % 11 <> 10""")
def section_carry(spark, sf_dir):
    """Each line's section: the last heading before it, none after a line that closes."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines_of(F.col("text"))).alias("pos", "line"))
    out = ordered.carry_forward(lines, ["doc_id"], ["pos"], F.when(F.col("pos") % 4 == 0, F.col("line")), "section", reset=F.col("pos") % 11 == 10)
    return out.where("section IS NOT NULL").select("doc_id", "pos", "section")


@query("""SELECT doc_id, session, string_agg(line, chr(10) ORDER BY pos) AS item FROM (SELECT doc_id, pos, line, sum(CASE WHEN pos % 3 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos)::INT AS session
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10)))))::INT AS pos FROM documents)) GROUP BY doc_id, session""")
def item_sessions(spark, sf_dir):
    """Lines gathered to items that start at some of them."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines_of(F.col("text"))).alias("pos", "line"))
    marked = ordered.sessions(lines, ["doc_id"], ["pos"], F.col("pos") % 3 == 1, "session")
    return ordered.joined_text(marked, ["doc_id", "session"], ["pos"], "line", "item", "\n")


@query("""SELECT lang, arg_min(doc_id, doc_id) AS first_id, md5(arg_min(text, doc_id)) AS text_md5 FROM documents GROUP BY lang""")
def first_of_each(spark, sf_dir):
    """The first document of each language."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.min("doc_id").alias("first_id"), F.md5(F.min_by("text", "doc_id").cast("binary")).alias("text_md5"))


@query("""SELECT b.doc_id FROM documents b JOIN documents a ON a.doc_id = b.doc_id - 7 WHERE md5(trim(a.text, chr(32) || chr(10) || chr(9))) <> md5(trim(b.text, chr(32) || chr(10) || chr(9)))""")
def change_detect(spark, sf_dir):
    """Documents whose text is not that of the one seven before; blanks around do not matter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.strip(F.col("text")), 256).alias("signature"))
    old = docs.select((F.col("doc_id") + 7).alias("doc_id"), "signature")
    new = docs.join(old.select("doc_id"), "doc_id", "left_semi")
    return ordered.changed(old, new, "doc_id", "signature").select("doc_id")


@query(r"""SELECT doc_id, regexp_matches(text, '\\begin\{(matrix|pmatrix|array|cases)') AS matrix FROM documents""")
def matrix_test(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_matrix(F.col("text")).alias("matrix"))


@query("""SELECT doc_id, '**姓名/学号：**' || doc_id || chr(10) || '**整体情况：**ok' || chr(10) || chr(10) || '## 错误细节' || chr(10) || chr(10) || '1. ' || source AS md FROM documents""")
def markdown_reports(spark, sf_dir):
    """Reports as markdown."""
    report = F.concat_ws("\n", F.lit("======"), F.concat(F.lit(" 姓名/学号: "), F.col("doc_id").cast("string")), F.lit("整体情况：ok"), F.lit("错误细节："), F.lit(""), F.concat(F.lit("1. "), "source"), F.lit("=========="))
    return table(spark, sf_dir, "documents").select("doc_id", T.markdown(report).alias("md"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, '{' || l_orderkey || '} of ' || l_partkey AS prompt FROM lineitem""")
def filled_prompts(spark, sf_dir):
    """Templates with their names filled in; other braces stay."""
    filled = T.fill(F.lit("{{a}} of {b}"), {"a": F.col("l_orderkey").cast("string"), "b": F.col("l_partkey").cast("string")})
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", filled.alias("prompt"))


def _orders_as_reports(spark, sf_dir):
    """Orders written as reports: lines with odd numbers are errors, the others go under proofs."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.concat(F.lit("第"), F.col("l_linenumber").cast("string"), F.lit("."), (F.col("l_suppkey") % 3).cast("string"), F.lit("题 part "), F.col("l_partkey").cast("string"), F.lit(" 用 "), F.col("l_quantity").cast("int").cast("string")).alias("item"))
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "item")
    gathered = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(place)).alias("all"))
    pick = lambda odd: F.transform(F.filter("all", lambda x: (x["l_linenumber"] % 2 == 1) == odd), lambda x: x["item"])
    section = lambda title, items: F.struct(F.lit(title).alias("title"), F.lit("").alias("raw_text"), items.alias("items"))
    sections = F.array(section(V.ERROR_SECTION, pick(True)), section(V.PROOF_SECTION, pick(False)), section(V.ADVICE_SECTION, F.array(F.lit("多练习"))))
    orders = table(spark, sf_dir, "orders").join(gathered, F.col("o_orderkey") == F.col("l_orderkey"))
    report = V.render_report(F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), sections, empty_item=False)
    return orders.select("o_orderkey", report.alias("report"))


_ITEM = "'第' || l_linenumber || '.' || (l_suppkey % 3) || '题 part ' || l_partkey || ' 用 ' || l_quantity::INT"


@query(f"""WITH i AS (SELECT l_orderkey, l_linenumber % 2 = 1 AS odd, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, {_ITEM} AS item,
l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem)
SELECT o_orderkey, o_orderkey::VARCHAR AS name, o_orderpriority AS overall, string_agg(item, '|' ORDER BY n) FILTER (odd) AS errors, string_agg(item, '|' ORDER BY n) FILTER (NOT odd) AS proofs,
coalesce(count(*) FILTER (odd), 0)::INT AS n_errors, '多练习' AS advice FROM orders JOIN i ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority""")
def verdict_roundtrip(spark, sf_dir):
    """Reports written from rows and parsed back."""
    parsed = V.parse_reports(_orders_as_reports(spark, sf_dir), "report", V.read_format(V.DEFAULT_FORMAT))
    items = lambda i: F.col("sections")[i]["items"]
    some = lambda a: F.when(F.size(a) > 0, F.array_join(a, "|"))
    return parsed.select("o_orderkey", F.col("student_name_or_id").alias("name"), "overall", some(items(0)).alias("errors"), some(items(1)).alias("proofs"), F.size(items(0)).alias("n_errors"), F.array_join(items(2), "|").alias("advice"))


@query(f"""WITH i AS (SELECT l_orderkey, l_linenumber || '.' || (l_suppkey % 3) AS question, {_ITEM} AS item, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_linenumber % 2 = 1)
SELECT l_orderkey AS o_orderkey, question, string_agg(item, '|' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS items FROM i GROUP BY l_orderkey, question""")
def items_by_question(spark, sf_dir):
    """Error items under the questions that they name."""
    parsed = V.parse_reports(_orders_as_reports(spark, sf_dir), "report", V.read_format(V.DEFAULT_FORMAT))
    rows = parsed.select("o_orderkey", F.explode("error_questions").alias("q"))
    return rows.select("o_orderkey", "q.question", F.array_join("q.items", "|").alias("items"))
