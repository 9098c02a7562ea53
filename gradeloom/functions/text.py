"""Text expressions. Each takes and returns columns and stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.strip() has it; neither trim() nor Java's \s covers all of it.
SPACE = r"\t\n\x0b\f\r\x1c-\x1f \x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same as characters, for trims, which need no pattern.
SPACE_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Breaks as str.splitlines() has them.
BREAK = r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029]"
#: The names that an identifier gets when nothing is left of it.
UNKNOWN_STUDENT, NEW_WEEK = "unknown_student", "new_week"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE_CHARS))


def collapse_space(text: Column) -> Column:
    """Words joined by one blank."""
    return strip(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def safe_name(name: Column, fallback: str = UNKNOWN_STUDENT) -> Column:
    """A name fit for a file: reserved characters, then white space, become underscores by runs."""
    marked = F.regexp_replace(strip(name), r'[\\/:*?"<>|]+', "_")
    out = F.regexp_replace(marked, rf"[{SPACE}]+", "_")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(fallback))


def strip_colon(text: Column) -> Column:
    return strip(F.rtrim(strip(text), F.lit("：:")))


def strip_quotes(text: Column) -> Column:
    """One pair of equal quotes around the text."""
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    wrapped = (F.length(text) >= 2) & (first == last) & first.isin('"', "'")
    return F.when(wrapped, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def escape_quoted(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def unix_lines(text: Column, lone: bool = True) -> Column:
    """Line feeds for line breaks; lone carriage returns too if wanted."""
    return F.regexp_replace(text, "\r\n?" if lone else "\r\n", "\n")


def lines_of(text: Column) -> Column:
    """Split at line feeds; empty lines at the end are kept."""
    return F.split(text, "\n", -1)


def split_lines(text: Column) -> Column:
    """Split at all breaks that end a line; no empty line after the last break."""
    parts = F.split(text, BREAK, -1)
    n = F.size(parts)
    last_empty = F.element_at(parts, -1) == ""
    return F.when(last_empty, F.slice(parts, 1, F.greatest(n - 1, F.lit(0)))).otherwise(parts)


def before_first(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def after_first(text: Column, mark: str) -> Column:
    """What follows the first mark; null if there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def colon_at(line: Column) -> Column:
    """Place of the first colon of either width, from 1 on; 0 without one."""
    wide, plain = F.instr(line, "："), F.instr(line, ":")
    return F.when(wide == 0, plain).when(plain == 0, wide).otherwise(F.least(wide, plain))


def label_of(line: Column, at: Column | None = None) -> Column:
    """The label before the first colon of either width; null without a label. at: the colon's place, if known."""
    at = colon_at(line) if at is None else at
    return F.nullif(strip(F.substring(line, F.lit(1), at - 1)), F.lit(""))


def value_of(line: Column, at: Column | None = None) -> Column:
    """What follows a label's colon, stripped; empty without a colon."""
    at = colon_at(line) if at is None else at
    return F.when(at > 0, strip(F.substring(line, at + 1, F.length(line)))).otherwise(F.lit(""))


def suffix_of(name: Column) -> Column:
    """The suffix with its dot, lower case; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def stem_of(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")


def numbered(items: Column) -> Column:
    """Lines `1. first`, `2. second` and so on."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def fill(template: Column, values: dict[str, Column]) -> Column:
    """{name} replaced by values; braces of unknown names stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


#: Characters that are commands in LaTeX, and what stands for them in text.
LATEX_TEXT = {
    "\\": "\\textbackslash{}",
    "{": "\\{",
    "}": "\\}",
    "#": "\\#",
    "$": "\\$",
    "%": "\\%",
    "&": "\\&",
    "_": "\\_",
    "~": "\\textasciitilde{}",
    "^": "\\textasciicircum{}",
}


def latex_text(text: Column) -> Column:
    """Text with LaTeX's own characters written out, each one once."""
    table = F.create_map(*(F.lit(x) for pair in LATEX_TEXT.items() for x in pair))
    cut = F.regexp_extract_all(text, F.lit(r"(?s)([\\{}#$%&_~^]|[^\\{}#$%&_~^]+)"), F.lit(1))
    return F.array_join(F.transform(cut, lambda x: F.coalesce(F.try_element_at(table, x), x)), "")


def html_text(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


#: Characters that are meant as a backslash, and a slash before a command's letters.
OTHER_BACKSLASHES = "[＼﹨∖]"
COMMAND_SLASH = r"(^|[\s{\[(,;:=<>+\-*])[/／]([A-Za-z]+)\b"


def command_slashes(text: Column) -> Column:
    """Wide and forward slashes before a command's letters become backslashes."""
    return F.regexp_replace(F.regexp_replace(text, OTHER_BACKSLASHES, r"\\"), COMMAND_SLASH, r"$1\\$2")


def quoted_pattern(text: Column) -> Column:
    """The text as a pattern that matches just it."""
    return F.regexp_replace(text, r"[.*+?^${}()|\[\]\\]", r"\\$0")


#: Labels of the report format that markdown sets apart.
MARKDOWN_FIELDS = ("姓名/学号", "整体情况")
MARKDOWN_SECTIONS = ("错误细节", "证明题审查", "改进建议")


def markdown(text: Column) -> Column:
    """A report as markdown, line by line: rules go, fields are bold and sections are headings with blank lines around.

    Blank lines before a field go, and of several others one stays.
    """
    joins = "\x01"  # what follows stands right under the line before

    def line(x: Column) -> Column:
        bare, at = strip(x), colon_at(x)
        label = F.when(at > 0, strip(F.substring(x, F.lit(1), at - 1)))
        field = F.concat(F.lit(f"{joins}**"), label, F.lit("：**"), F.ltrim(F.substring(x, at + 1, F.length(x)), F.lit(SPACE_CHARS)))
        title = strip(F.rtrim(bare, F.lit("：:")))
        return (
            F.when(x.rlike(rf"^[=*_-]{{6,}}[{SPACE}]*$"), "")
            .when(label.isin(*MARKDOWN_FIELDS), field)
            .when(title.isin(*MARKDOWN_SECTIONS), F.concat(F.lit("\n## "), title, F.lit("\n")))
            .otherwise(x)
        )

    whole = F.array_join(F.transform(lines_of(strip(unix_lines(F.coalesce(text, F.lit(""))))), line), "\n")
    whole = F.replace(F.regexp_replace(whole, f"[{SPACE}]*{joins}", f"\n{joins}"), F.lit(joins), F.lit(""))
    return strip(F.regexp_replace(whole, r"\n{3,}", "\n\n"))


def cell_text(text: Column) -> Column:
    """A matrix cell: runs of dots become an ellipsis, nothing becomes a blank."""
    core = strip(text)
    return F.when(core.isin("...", r"\cdots", r"\ldots", r"\dots"), F.lit("…")).when(core == "", F.lit(" ")).otherwise(core)


def url_part(text: Column) -> Column:
    """Percent encoding of all but letters, digits and -._~; blanks are %20."""
    out = F.url_encode(text)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def url_text(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def attachment_name(header: Column) -> Column:
    """The file name of a Content-Disposition header: the encoded form first, then the plain one."""
    coded = F.regexp_extract(header, r"(?i)filename\*=UTF-8''([^;]+)", 1)
    plain = F.regexp_extract(header, r'(?i)filename="?([^";]+)"?', 1)
    return F.coalesce(F.nullif(F.try_url_decode(coded), F.lit("")), F.nullif(plain, F.lit("")))


def natural_key(name: Column) -> Column:
    """A string whose order is the natural one: runs of digits by value, other characters in lower case.

    A number is written as the count of its digits and the digits. A name that starts with a digit
    sorts before one that doesn't.
    """
    parts = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def one(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.when(part.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(F.lower(part))

    return F.array_join(F.transform(parts, one), "\x01")


def last_lines(lines: Column, n: int) -> Column:
    """The last n elements, or all if there are fewer."""
    return F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n)


def question_ids(text: Column) -> Column:
    """Numbers of questions like 1.2 or 3.1(2): those called by name first, each one once."""
    number = r"[0-9]+(?:\.[0-9]+)+(?:\s*\([0-9]+\))?"
    called = F.regexp_extract_all(text, F.lit(rf"第\s*({number})\s*题"), F.lit(1))
    any_ = F.regexp_extract_all(text, F.lit(rf"({number})"), F.lit(1))
    found = F.array_distinct(F.transform(F.concat(called, any_), collapse_space))
    return F.when(F.contains(text, F.lit(".")), found).otherwise(F.array().cast("array<string>"))


#: Environments that are matrices.
MATRIX_NAMES = ("matrix", "pmatrix", "bmatrix", "Bmatrix", "vmatrix", "Vmatrix", "array", "cases", "aligned", "smallmatrix")


def has_matrix(text: Column) -> Column:
    """Whether a matrix-like environment begins in the text."""
    return text.rlike(r"\\begin\{(?:" + "|".join(MATRIX_NAMES) + r")\}")
