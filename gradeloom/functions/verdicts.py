"""Reports of a fixed template: parsing into nested columns, and writing.

A report is text with labelled lines. Which labels there are is read from a format text, so the sections are
a map and not fields. All of a report is handled within its row by cutting its lines at labels and numbers: nothing is
shuffled. Order matters and is kept: sections as the format has them, questions as first seen.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Words of the report format.
RULE = "========================================"
NAME_MARK = "{student_name}"
OVERALL_PREFIX = "整体情况"
ERROR_SECTION, PROOF_SECTION, ADVICE_SECTION = "错误细节", "证明题审查", "改进建议"
UNKNOWN_QUESTION = "未识别题号"
NEEDS_REVIEW = "需人工复核"
NAME_LABEL = "姓名/学号"
NOT_GRADED = "未进入有效判卷流程，本项待人工复核。"
#: Fixed value: the format of the default configuration.
DEFAULT_FORMAT = "\n".join([
    RULE,
    "姓名/学号：{student_name}",
    "整体情况：[全对 / 部分错误 / 错误较多]",
    "错误细节：",
    "1. [指出具体的计算或概念错误，第几题出错了]",
    "证明题审查：",
    "1. [针对证明题的专门评价，指出具体的逻辑漏洞，或赞扬其严谨性]",
    "改进建议：",
    "1. [具体的学习或复习建议]",
    RULE,
])

#: What numbers an item, at the start of a stripped line.
ITEM_MARK = rf"^(?:[-*][{T.SPACE}]*)?[0-9]+[.、)]"
SECTION_TYPE = "map<string,struct<raw_text:string,items:array<string>>>"
QUESTION_TYPE = "map<string,array<string>>"
PAYLOAD = f"student_name_or_id string, overall string, modules {SECTION_TYPE}"


@dataclass(frozen=True)
class ReportFormat:
    name_label: str | None
    overall_label: str | None
    sections: tuple[str, ...]

    def section_with(self, word: str) -> str | None:
        return next((s for s in self.sections if word in s), None)


#: Kinds of lines in a format text, the first that fits: rules, the name's, the overall's and a section's label.
_FORMAT_LINE = re.compile(rf"(?P<rule>=+)|(?P<name>.*?){re.escape(NAME_MARK)}.*|(?P<overall>{OVERALL_PREFIX}[^\[]*).*|(?P<section>.*[：:])")


def read_format(text: str) -> ReportFormat:
    """Labels of a format text: the name's, the overall's, and the sections', each section once."""
    found: dict[str, dict[str, None]] = {"rule": {}, "name": {}, "overall": {}, "section": {}}
    for m in filter(None, (_FORMAT_LINE.fullmatch(x.strip()) for x in text.splitlines())):
        label, labels = m[m.lastgroup].strip().rstrip("：:").strip(), found[m.lastgroup]
        if m.lastgroup != "section":
            labels.clear()  # the last one holds
        labels.setdefault(label)
    last = lambda kind: next(reversed(found[kind]), None)
    return ReportFormat(last("name"), last("overall"), tuple(found["section"]))


def editable_section(title: Column) -> Column:
    """Whether items may be added to a section and taken from it: errors, proofs and advice."""
    return F.coalesce(title.contains(ERROR_SECTION) | title.contains(PROOF_SECTION) | title.contains(ADVICE_SECTION), F.lit(False))


def _bound(value: Column, use) -> Column:
    """use(value) with value worked out once, also where use() puts it into a lambda."""
    return F.transform(F.array(value), use)[0]


def _stretches(values: Column, starts: Column, use) -> Column:
    """use(elements from one start up to the next) for each of the ascending places in starts; linear."""
    n = F.size(values)
    return F.transform(starts, lambda i, k: _bound(F.slice(values, i + 1, F.coalesce(F.get(starts, k + 1), n) - i), use))


def _places(values: Column, wanted) -> Column:
    """Places of the elements that are wanted."""
    return F.filter(F.transform(values, lambda x, i: F.when(wanted(x, i), i)), lambda i: i.isNotNull())


def tagged_lines(text: Column, fmt: ReportFormat) -> Column:
    """Array of (kind, section, line): kind is name, overall or body; lines outside any section are left out.

    The text is cut at its labels, so the work is in proportion to its lines.
    """
    line_type = "array<struct<kind:string,section:string,line:string>>"
    sections = F.array(*map(F.lit, fmt.sections)) if fmt.sections else F.array().cast("array<string>")

    # Each stage is a pass of its own, so that no expression is worked out twice for a line.
    bare = F.transform(T.lines_of(T.unix_lines(F.coalesce(text, F.lit("")), lone=False)), lambda x: F.struct(x.alias("raw"), T.strip(x).alias("bare")))
    bare = F.filter(bare, lambda x: F.btrim(x["bare"], F.lit("=")) != "")  # rules and blank lines
    bare = F.transform(bare, lambda x: F.struct(x["raw"].alias("raw"), x["bare"].alias("bare"), T.colon_at(x["bare"]).alias("at")))
    # A label ends before the first colon, so none is left to strip from it.
    split = F.transform(bare, lambda x: F.struct(
        x["raw"].alias("raw"), F.when(x["at"] > 1, T.strip(F.substring(x["bare"], F.lit(1), x["at"] - 1))).otherwise("").alias("label"), T.value_of(x["bare"], x["at"]).alias("value")))
    is_label = lambda x, label: (x["label"] == label) if label else F.lit(False)
    split = F.transform(split, lambda x: F.struct(
        x["raw"].alias("raw"), x["label"].alias("label"), x["value"].alias("value"),
        F.when(is_label(x, fmt.name_label), "name").when(is_label(x, fmt.overall_label), "overall").when(F.array_contains(sections, x["label"]), "body").alias("kind")))
    nothing, none = F.lit(None).cast("string"), F.array().cast(line_type)
    row = lambda kind, section, line: F.struct(kind.alias("kind"), section.alias("section"), line.alias("line"))

    def rows(stretch: Column) -> Column:
        head = stretch[0]
        body = F.transform(F.slice(stretch, 2, F.size(stretch)), lambda x: row(F.lit("body"), head["label"], x["raw"]))
        first = F.when(head["value"] != "", F.array(row(F.lit("body"), head["label"], head["value"]))).otherwise(none)
        return F.when(head["kind"] == "body", F.concat(first, body)).otherwise(F.array(row(head["kind"], nothing, head["value"])))

    return _bound(split, lambda s: F.flatten(_bound(_places(s, lambda x, i: x["kind"].isNotNull()), lambda at: _stretches(s, at, rows))))


def numbered_items(lines: Column) -> Column:
    """Items of numbered lines: a number starts one, other lines go on; lines before any number are one."""
    bare = F.filter(F.transform(lines, T.strip), lambda x: x != "")
    cut = F.transform(bare, lambda x: F.struct(x.alias("more"), F.regexp_replace(x, ITEM_MARK, "").alias("rest")))
    starts = lambda x, i: (i == 0) | (F.length(x["rest"]) < F.length(x["more"]))
    # An item's first line is what follows its number, if anything does.
    joined = lambda part: F.array_join(F.filter(F.transform(part, lambda x: T.strip(x["rest"])), lambda x: x != ""), "\n")
    found = _bound(cut, lambda c: _bound(_places(c, starts), lambda at: _stretches(c, at, joined)))
    return F.filter(F.transform(found, T.strip), lambda x: x != "")


def by_question(items: Column) -> Column:
    """(question, items) in the order in which questions are first named; an item stands under each of its own."""
    none = F.array(F.lit(UNKNOWN_QUESTION))

    def pairs(item: Column) -> Column:
        ids = _bound(T.question_ids(item), lambda x: F.when(F.size(x) == 0, none).otherwise(x))
        return F.transform(ids, lambda q: F.struct(q.alias("q"), item.alias("item")))

    # Sorted by question and place, cut where the question changes, and put back in the order of first places.
    placed = F.transform(F.flatten(F.transform(items, pairs)), lambda p, i: F.struct(p["q"].alias("q"), i.alias("i"), p["item"].alias("item")))
    group = lambda part: F.struct(part[0]["i"].alias("i"), part[0]["q"].alias("question"), F.transform(part, lambda p: p["item"]).alias("items"))
    groups = _bound(F.array_sort(placed), lambda ps: _bound(
        _places(ps, lambda x, i: (i == 0) | (F.get(ps, F.greatest(i - 1, F.lit(0)))["q"] != x["q"])), lambda at: _stretches(ps, at, group)))
    return F.transform(F.array_sort(groups), lambda g: F.struct(g["question"].alias("question"), g["items"].alias("items")))


def _last(tagged: Column, kind: str) -> Column:
    found = F.filter(tagged, lambda x: x["kind"] == kind)
    return F.coalesce(F.try_element_at(found, F.lit(-1))["line"], F.lit(""))


def parse_reports(frame: DataFrame, text: str, fmt: ReportFormat) -> DataFrame:
    """frame with student_name_or_id, overall, modules and the two maps by question of each text."""
    tagged = "__tagged"
    out = frame.withColumn(tagged, tagged_lines(F.col(text), fmt))
    lines_in = lambda s: F.transform(F.filter(F.col(tagged), lambda x: x["section"] == s), lambda x: x["line"])
    ordered = [
        F.struct(F.lit(i).alias("pos"), F.lit(s).alias("title"), T.strip(F.array_join(lines_in(s), "\n")).alias("raw_text"), numbered_items(lines_in(s)).alias("items"))
        for i, s in enumerate(fmt.sections)
    ]
    sections = F.array(*ordered) if ordered else F.array().cast("array<struct<pos:int,title:string,raw_text:string,items:array<string>>>")
    out = out.withColumn("sections", sections)
    modules = F.map_from_entries(F.transform("sections", lambda s: F.struct(s["title"], F.struct(s["raw_text"].alias("raw_text"), s["items"].alias("items")))))

    def questions(word: str) -> Column:
        title = fmt.section_with(word)
        items = F.col("sections")[fmt.sections.index(title)]["items"] if title else F.array().cast("array<string>")
        return by_question(items)

    return out.withColumns({
        "student_name_or_id": _last(F.col(tagged), "name"),
        "overall": _last(F.col(tagged), "overall"),
        "modules": modules,
        "error_questions": questions(ERROR_SECTION),
        "proof_questions": questions(PROOF_SECTION),
    }).withColumns({
        "error_details_by_question": F.map_from_entries("error_questions"),
        "proof_review_by_question": F.map_from_entries("proof_questions"),
    }).drop(tagged)


def render_report(name: Column, overall: Column, sections: Column, empty_item: bool = False) -> Column:
    """Text of a report; sections is an array of (title, raw_text, items).

    A section without items shows its raw text as the only one. One without either shows nothing, or
    an empty first item if that is wanted.
    """

    def section(s: Column) -> Column:
        items = F.filter(F.transform(F.coalesce(s["items"], F.array().cast("array<string>")), T.strip), lambda x: x != "")
        raw = T.strip(F.coalesce(s["raw_text"], F.lit("")))
        shown = F.when(F.size(items) > 0, T.numbered(items)).when(raw != "", F.concat(F.lit("1. "), raw))
        shown = shown.otherwise(F.lit("1. ")) if empty_item else shown
        return F.concat_ws("\n", F.concat(s["title"], F.lit("：")), shown)

    return F.concat(
        F.concat_ws("\n", F.lit(RULE), F.concat(F.lit(f"{NAME_LABEL}："), F.coalesce(name, F.lit(""))), F.concat(F.lit(f"{OVERALL_PREFIX}："), F.coalesce(overall, F.lit(""))), F.nullif(F.array_join(F.transform(sections, section), "\n"), F.lit("")), F.lit(RULE)),
        F.lit("\n"),
    )


def failure_report(name: Column, overall: Column, errors: Column, advice: Column) -> Column:
    """The report that stands for a grading that did not come about."""
    return F.concat_ws(
        "\n", F.lit(RULE), F.concat(F.lit(f"{NAME_LABEL}："), name), F.concat(F.lit(f"{OVERALL_PREFIX}："), overall),
        F.lit(f"{ERROR_SECTION}："), T.numbered(errors), F.lit(f"{PROOF_SECTION}："), F.lit(f"1. {NOT_GRADED}"),
        F.lit(f"{ADVICE_SECTION}："), T.numbered(advice), F.lit(f"{RULE}\n"),
    )


def enriched(frame: DataFrame, payload: str, text: str, fmt: ReportFormat) -> DataFrame:
    """Reports with a JSON payload: its own typed fields win, and the maps by question always come from the text."""
    typed = F.from_json(F.col(payload), PAYLOAD)
    parsed = parse_reports(frame, text, fmt).withColumn("__typed", typed)
    is_text = lambda field: F.get_json_object(F.col(payload), f"$.{field}").isNotNull()
    return parsed.withColumns({
        "student_name_or_id": F.when(is_text("student_name_or_id"), F.coalesce("__typed.student_name_or_id", "student_name_or_id")).otherwise(F.col("student_name_or_id")),
        "overall": F.when(is_text("overall"), F.coalesce("__typed.overall", "overall")).otherwise(F.col("overall")),
        "modules": F.coalesce("__typed.modules", "modules"),
    }).drop("__typed")


def normal_payload(payload: Column) -> Column:
    """A payload in one form: text fields stripped, blank items gone, titles in order; for comparison."""
    typed = F.from_json(payload, PAYLOAD)
    clean = lambda x: T.strip(F.coalesce(x, F.lit("")))
    entries = F.coalesce(F.map_entries(typed["modules"]), F.array().cast("array<struct<key:string,value:struct<raw_text:string,items:array<string>>>>"))
    modules = F.array_sort(F.transform(entries, lambda e: F.struct(
        e["key"].alias("title"), F.filter(F.transform(F.coalesce(e["value"]["items"], F.array().cast("array<string>")), clean), lambda x: x != "").alias("items"))))
    return F.struct(clean(typed["student_name_or_id"]).alias("name"), clean(typed["overall"]).alias("overall"), modules.alias("modules"))


def payload_signature(payload: Column) -> Column:
    """Equal for payloads that differ in nothing a reader would see."""
    return F.sha2(F.to_json(normal_payload(payload)), 256)


def export_text(rendered: Column, payload_text: Column, stored_payload_text: Column, stored_text: Column, skeleton: Column) -> Column:
    """The text to export: the first that is there; null if it is blank."""
    text = F.coalesce(rendered, payload_text, stored_payload_text, stored_text, skeleton)
    return F.nullif(T.strip(T.unix_lines(text)), F.lit(""))
