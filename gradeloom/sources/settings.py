"""Settings and configuration: lines of NAME=value, JSON objects, subjects and assignments."""

from __future__ import annotations

import contextlib
import json
import os
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.operators.ordered import latest

#: Names of settings, and the fields that a subject has to have.
ENV_NAME = r"^[A-Za-z_][A-Za-z0-9_]*$"
SUBJECT_FIELDS = ("subject_id", "subject_name", "model", "base_url", "api_key_env", "prompt_template", "grading_requirements", "output_format")
ENGINES, DEFAULT_ENGINE = ("latex", "katex"), "katex"
ANSWER_FILES = ("answer.tex", "Lec1.tex")

SUBJECT_SCHEMA = ", ".join(f"{f} string" for f in SUBJECT_FIELDS)
ASSIGNMENT_SCHEMA = "assignment_id string, week_name string, week_dir string, answer_key string, raw_submissions_dir string, processed_images_dir string, results_dir string, preprocess_summary string, grading_summary string, subject_config string"


#: A line NAME=value with one pair of quotes around the value or none: name, quote, quoted value, bare value. Comments and
#: other names don't fit. Columns and the driver read lines by it alike.
ENV_LINE = rf"""^[{T.SPACE}]*([A-Za-z_][A-Za-z0-9_]*)[{T.SPACE}]*=[{T.SPACE}]*(?:(["'])(.*)\2|(.*?))[{T.SPACE}]*$"""


def parse_env_lines(rows: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    """name and value of lines NAME=value; the last line of a name wins within keys."""
    part = lambda i: F.regexp_extract(line, ENV_LINE, i)
    rows = rows.where(F.col(line).rlike(ENV_LINE))
    rows = rows.withColumn("name", part(1)).withColumn("value", F.when(part(2) != "", part(3)).otherwise(part(4)))
    return latest(rows, [*keys, "name"], [F.desc(order)]).select(*keys, "name", "value")


def env_of(text: str) -> dict[str, str]:
    """The same for one small file on the driver; its values are secrets and never become rows."""
    found = filter(None, (re.match(ENV_LINE, x) for x in text.splitlines()))
    return {m[1]: m[3] if m[2] else m[4] for m in found}


def env_text(values: dict[str, str]) -> str:
    """A settings file with its names in order and its values quoted."""
    escape = str.maketrans({"\\": "\\\\", '"': '\\"'})
    return "".join(f'{name}="{value.translate(escape)}"\n' for name, value in sorted(values.items()))


def resolve_key(name: str, local: dict[str, str]) -> tuple[str | None, str]:
    """A key and where it is from: the process's environment goes before the file."""
    places = (("process_env", os.environ), ("local_env", local)) if name else ()
    held = ((values.get(name, "").strip(), place) for place, values in places)
    return next(((key, place) for key, place in held if key), (None, "missing" if name else "missing_env_name"))


@dataclass(frozen=True)
class LocalConfig:
    """Keys and options of one installation, in two small files. Each change reads, changes and replaces a whole file."""

    keys_file: Path
    options_file: Path

    def _replace(self, path: Path, text: str) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        fresh = path.with_name(f"{path.name}.new")
        fresh.write_text(text, encoding="utf-8")
        fresh.replace(path)

    def keys(self) -> dict[str, str]:
        return env_of(self.keys_file.read_text(encoding="utf-8")) if self.keys_file.is_file() else {}

    def options(self) -> dict:
        return settings_of(self.options_file.read_text(encoding="utf-8")) if self.options_file.is_file() else {}

    def set_key(self, name: str, value: str) -> None:
        name, value = name.strip(), value.strip()
        if not re.fullmatch(ENV_NAME, name) or not value:
            raise ValueError("a key needs a name of letters, digits and underscores, and a value")
        self._replace(self.keys_file, env_text(self.keys() | {name: value}))

    def set_engine(self, engine: str) -> None:
        if export_engine({"export_engine": engine}) != engine.strip().lower():
            raise ValueError(f"no such engine: {engine}")
        self._replace(self.options_file, json.dumps(self.options() | {"export_engine": engine.strip().lower()}, ensure_ascii=False, indent=2) + "\n")


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects, one a file, with the name of the file they are from."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", T.stem_of(F.col("_metadata.file_path")))


def read_subjects(spark: SparkSession, path: str) -> DataFrame:
    from gradeloom.operators.decisions import first_missing

    return read_objects(spark, path, SUBJECT_SCHEMA).withColumn("missing", first_missing(list(SUBJECT_FIELDS)))


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    return read_objects(spark, path, ASSIGNMENT_SCHEMA)


def settings_of(text: str | None) -> dict:
    """A settings object; anything else counts as empty."""
    with contextlib.suppress(ValueError):
        if isinstance(found := json.loads(text or "null"), dict):
            return found
    return {}


def export_engine(settings: dict) -> str:
    """The engine that the settings name, if it is one."""
    return next((e for e in ENGINES if e == str(settings.get("export_engine") or "").strip().lower()), DEFAULT_ENGINE)


@dataclass(frozen=True)
class Workspace:
    """Folders of one week."""

    root: Path
    week: str

    def _at(self, *parts: str) -> Path:
        inside = (self.root / safe_week(self.week)).resolve()
        if not inside.is_relative_to(self.root.resolve()):
            raise ValueError("a week lies outside of the workspace")
        return inside.joinpath(*parts)

    raw = property(lambda self: self._at("raw_submissions"))
    pages = property(lambda self: self._at("processed_images"))
    results = property(lambda self: self._at("results"))
    answer = property(lambda self: next((p for f in ANSWER_FILES if (p := self._at(f)).exists()), self._at(ANSWER_FILES[0])))

    def config(self) -> dict:
        return {
            "assignment_id": safe_week(self.week), "week_name": self.week, "week_dir": str(self._at()), "answer_key": str(self.answer), "raw_submissions_dir": str(self.raw), "processed_images_dir": str(self.pages),
            "results_dir": str(self.results), "preprocess_summary": str(self._at("preprocess_summary.txt")), "grading_summary": str(self._at("grading_summary.txt")),
        }

    def create(self, force: bool = False, dry_run: bool = False) -> list[str]:
        """Make what is missing; with force the configuration is written anew. Returns what was (to be) made."""
        made = [str(p) for p in (self.raw, self.pages, self.results) if not p.exists()]
        files = {self._at("assignment.json"): json.dumps(self.config(), ensure_ascii=False, indent=2) + "\n", self._at(ANSWER_FILES[0]): ""}
        fresh = [p for p in files if not p.exists() or (force and p.suffix == ".json")]
        if not dry_run:
            for p in (self.raw, self.pages, self.results):
                p.mkdir(parents=True, exist_ok=True)
            for p in fresh:
                p.write_text(files[p], encoding="utf-8")
        return made + [str(p) for p in fresh]


def safe_week(name: str) -> str:
    """A week's name fit for a folder."""
    name = re.sub(r"\s+", "_", re.sub(r'[\\/:*?"<>|]+', "_", name.strip()))
    return name if name.strip("._") else T.NEW_WEEK


def choose_assignment(found: list[str], assignment: str | None = None, week: str | None = None) -> str:
    """An assignment by its own name, else by its week's, else the only one there is."""
    if assignment:
        return assignment
    if week:
        named = [f for f in found if Path(f).stem == safe_week(week)]
        return named[0] if named else week
    if len(found) == 1:
        return found[0]
    raise ValueError("no assignment" if not found else "several assignments: name one")
