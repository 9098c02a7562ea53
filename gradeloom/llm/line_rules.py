"""Line-first quality rules, all in DataFrame expressions.

Every line of a text is judged by itself. A line that holds a word fails when it is

* navigation: at least three separators (`|`, `>` or `»` standing alone) and a quarter of its words are separators;
* symbol noise: at least three characters of `#*$%&|<>` and more than one in twelve of its characters;
* a stuck line: eight words or more of which under a third differ;
* boilerplate: it is short and has one of the fixed phrases of web pages;
* without closing punctuation although it has words enough for a sentence.

Failing lines are removed. A document is rejected when the lines it has left hold under `min_left` of
its word characters, or when it fails the rules on the whole text (too short, too repetitive).

Cases: a null text has no words and is rejected; an empty or blank one too. Ties and repeated rows are
judged row by row. Other columns are never read and stay as they are. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, WS_CLASS

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_LEFT = 0.5
#: Words from which on a line is held to be a sentence that needs closing punctuation.
SENTENCE_WORDS = 40
BOILERPLATE = (
    r"(?i)(?:cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|sign in|sign up|log in|"
    r"click here|read more|subscribe to|skip to content|back to top|enable javascript|share this)"
)
CLOSED = r"""[.!?:;,…。！？)\]"'»”’]$"""


def _bound(value: Column, use) -> Column:
    """use(value) with value evaluated once, also where use() puts it into a lambda."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of `window` words that the text holds at least twice.

    Window hashes are compared within the row, so nothing is shuffled; a text without a repeated
    window, the usual case, costs one hash set and no sort.
    """

    def covered(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        def marked(s: Column) -> Column:
            n = F.size(s)
            same = lambda j, k, x: F.get(s, k).getField("h") == x.getField("h")
            hit = F.transform(s, lambda x, j: F.when((j > 0) & same(j, F.greatest(j - 1, F.lit(0)), x) | (j < n - 1) & same(j, F.least(j + 1, n - 1), x), x.getField("i")))
            return F.sort_array(F.filter(hit, lambda x: x.isNotNull()))

        gaps = lambda starts: F.transform(starts, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(starts, j + 1) - x, F.lit(window))))
        return F.aggregate(_bound(_bound(order, marked), gaps), F.lit(0), lambda a, x: a + x)

    hashes = _bound(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (window - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, window))))
    count = _bound(hashes, lambda h: F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(count).cast("long")


def read_lines(text: Column) -> Column:
    """The lines of a text, each with its words and its number of symbols; everything else follows from these."""
    bare = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.struct(x.alias("line"), F.btrim(x, F.lit(WS_CHARS)).alias("core")))
    return F.transform(bare, lambda x: F.struct(
        x["line"].alias("line"), x["core"].alias("core"),
        F.when(x["core"] == "", F.array().cast("array<string>")).otherwise(F.split(x["core"], WS_CLASS)).alias("words"),
        F.length(F.regexp_replace(x["core"], r"[^#*$%&|<>]+", "")).alias("symbols"),
    ))


def line_passes(line: Column) -> Column:
    """The verdict on one line as read_lines gives it; lines without a word pass."""
    words, core, symbols = line["words"], line["core"], line["symbols"]
    n = F.size(words)
    bars = F.size(F.filter(words, lambda x: x.isin("|", ">", "»")))
    return (n == 0) | ~(
        (bars >= 3) & (bars * 4 >= n)
        | (symbols >= 3) & (symbols * 12 > F.length(core))
        | (n >= 8) & (F.size(F.array_distinct(words)) * 3 < n)
        | (n <= 12) & core.rlike(BOILERPLATE)
        | (n >= SENTENCE_WORDS) & ~core.rlike(CLOSED)
    )


def judge_documents(docs: DataFrame, text: str = "text", prefix: str = "", min_left: float = MIN_LEFT) -> DataFrame:
    """All columns of docs and, under `prefix`, the counts, the verdicts and the cleaned text.

    Columns of docs that have a result's name are replaced; a prefix keeps them.
    """
    p, own = (lambda x: f"{prefix}{x}"), (lambda x: f"__own_{x}")
    all_words = lambda lines: F.flatten(F.transform(lines, lambda x: x["words"]))
    out = docs.withColumn(own("lines"), read_lines(F.col(text)))
    out = out.withColumn(own("left"), F.filter(own("lines"), line_passes)).withColumn(own("words"), all_words(own("lines")))
    full = F.transform(F.filter(own("lines"), lambda x: x["core"] != ""), lambda x: x["line"])
    out = out.withColumns({
        p("clean_text"): F.array_join(F.transform(own("left"), lambda x: x["line"]), "\n"),
        p("n_words"): F.size(own("words")).cast("long"),
        p("word_chars"): F.length(F.array_join(own("words"), "")).cast("long"),
        p("n_symbols"): F.aggregate(own("lines"), F.lit(0), lambda a, x: a + x["symbols"]).cast("long"),
        p("n_dup_lines"): _bound(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        p("n_repeat_words"): repeat_words(F.col(own("words"))),
        p("left_chars"): F.length(F.array_join(all_words(own("left")), "")).cast("long"),
    })
    failed = (F.col(p("n_words")) < MIN_WORDS) | (F.col(p("n_repeat_words")) * 100 > F.col(p("n_words")) * MAX_REPEAT_PERCENT)
    out = out.withColumn(p("base_failed"), failed)
    kept = ~F.col(p("base_failed")) & (F.col(p("left_chars")) >= F.col(p("word_chars")) * min_left)
    return out.withColumn(p("kept"), kept).drop(own("words"), own("lines"), own("left"))


def clean_documents(docs: DataFrame, text: str = "text", min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that pass, with their failing lines removed, in the columns of docs."""
    q = "__rules_"
    out = judge_documents(docs, text, q, min_left).where(F.col(f"{q}kept"))
    return out.select(*(F.col(f"{q}clean_text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
