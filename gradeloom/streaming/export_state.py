"""The state of exports: queued, rendering, ready and the rest, as a keyed machine.

`advance` is the whole of its rules. The stream keeps a record a student with it, and the batch twin folds
it over ordered events; both give the same records.

Events: request (urgent or not), start, finish (with text, or with an error), and source (a new time of the
source, null when it is gone).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENT_SCHEMA = "student_id string, seq long, kind string, at double, urgent boolean, text string, error string"
STATE_SCHEMA = "status string, error string, text string, source_at double, cached_at double, rendering_at double, needs_rerun boolean, urgent boolean, updated_at double"
OUT_SCHEMA = "student_id string, seq long, status string, error string, ready boolean, urgent boolean"
#: Times closer than this are the same.
CLOSE = 1e-6


@dataclass
class Record:
    status: str = "missing"
    error: str = ""
    text: str = ""
    source_at: float | None = None
    cached_at: float = 0.0
    rendering_at: float | None = None
    needs_rerun: bool = False
    urgent: bool = False
    updated_at: float = 0.0


def shown(r: Record) -> str:
    """The status that is reported. Unless work goes on it follows from the cache, so an error shows as stale."""
    if r.status in ("queued", "rendering"):
        return r.status
    if r.source_at is None:
        return "missing"
    return "ready" if r.text.strip() and r.cached_at >= r.source_at - CLOSE else "stale"


def advance(r: Record, kind: str, at: float, urgent: bool = False, text: str | None = None, error: str | None = None) -> Record:
    r.updated_at = at
    if kind == "source":
        r.source_at = at
    elif kind == "gone":
        r.source_at = None
    elif kind == "request":
        r.error = ""
        if r.source_at is None:
            r.status = "missing"
        elif r.status == "rendering":
            r.needs_rerun = True
        else:
            r.urgent = urgent or (r.status == "queued" and r.urgent)
            r.status = "queued"
    elif kind == "start" and r.status == "queued":
        r.status, r.error, r.urgent, r.rendering_at = "rendering", "", False, r.source_at
    elif kind == "finish" and r.status == "rendering":
        good = error is None
        newer = good and (r.source_at or 0.0) > (r.rendering_at or 0.0) + CLOSE
        if r.needs_rerun or newer:
            r.status, r.error, r.urgent = "queued", "", True
        elif good:
            r.status, r.error, r.text, r.cached_at = "ready", "", text or "", r.rendering_at or 0.0
        else:
            r.status, r.error, r.text = "error", error, ""
        r.needs_rerun, r.rendering_at = False, None
    return r


def _apply(student: str, record: Record, events: pd.DataFrame) -> Iterator[tuple]:
    none = lambda x: None if x is None or x != x else x
    for e in events.sort_values("seq").itertuples(index=False):
        advance(record, e.kind, float(none(e.at) or 0.0), bool(none(e.urgent) or False), none(e.text), none(e.error))
        status = shown(record)
        yield student, int(e.seq), status, record.error, status == "ready", record.urgent


class ExportProcessor(StatefulProcessor):
    """One record a student in the state store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", STATE_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in STATE_SCHEMA.split(", ")]
        held = self.record.get() if self.record.exists() else None
        record = Record(**dict(zip(names, held, strict=True))) if held is not None else Record()
        order = {f: getattr(Record(), f) for f in names}
        out = list(_apply(key[0], record, pd.concat(list(rows))))
        values = asdict(record)
        self.record.update(tuple(values[f] for f in order))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def export_stream(events: DataFrame) -> DataFrame:
    """Reports of a stream of events; needs the RocksDB state store."""
    return events.groupBy("student_id").transformWithStateInPandas(ExportProcessor(), OUT_SCHEMA, "Update", "None")


def export_batch(events: DataFrame) -> DataFrame:
    """The same reports from all events at once."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_apply(key[0], Record(), rows)), columns=[c.split()[0] for c in OUT_SCHEMA.split(", ")])

    return events.groupBy("student_id").applyInPandas(run, OUT_SCHEMA)
