"""Autosave: what is written of edited notes, and when, from a log of events; in batch and as a stream with timers.

A note is dirty from its first change on. A write is due when it has been quiet for the debounce, or at once when something
flushes it (leaving the note or the editor). What was changed outside meanwhile makes the write a conflict to be resolved. A
write that succeeded leaves the note clean only if nothing was typed since; one that failed is due again later.

Events: note_id, ts, seq (their order, and a change's revision), kind, relpath, text, trigger, revision. Kinds: change,
moved (relpath), external, drop, flush (trigger), saved and failed (the revision written).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..registry import query
from ..session import table

DEBOUNCE = 750_000
JOB = "note_id string, relpath string, text string, trigger string, conflict boolean, revision long, at timestamp"
EVENT = "at long, seq long, kind string, relpath string, text string, trigger string, revision long"
_NAMES = [x.split()[0] for x in EVENT.split(", ")]
_COLUMNS = [x.split()[0] for x in JOB.split(", ")]


@dataclass(frozen=True)
class Dirty:
    """A note's buffer: the time of its last change in microseconds, its revision, and the one that was last given out."""

    relpath: str | None
    text: str | None
    last: int
    revision: int
    conflict: bool
    given: int


def _due(note: Dirty | None, upto: int, debounce: int) -> bool:
    return note is not None and note.given != note.revision and note.last + debounce <= upto


def step(note: Dirty | None, event: tuple, debounce: int = DEBOUNCE) -> tuple[Dirty | None, list[tuple]]:
    """(state, writes) after one event; a write: relpath, text, trigger, conflict, revision, at."""
    at, seq, kind, relpath, text, trigger, revision = event
    out: list[tuple] = []
    if _due(note, at, debounce):
        note, job = give(note, "debounce", note.last + debounce)
        out.append(job)
    if kind == "change":
        return (replace(note, relpath=relpath, text=text, last=at, revision=seq) if note else Dirty(relpath, text, at, seq, False, -1)), out
    if note is None or kind == "drop":
        return None, out
    if kind == "moved":
        return replace(note, relpath=relpath), out
    if kind == "external":
        return replace(note, conflict=True), out
    if kind == "saved":
        return (None if note.revision == revision else replace(note, conflict=False)), out
    if kind == "failed":
        return replace(note, last=at, given=-1), out
    if kind == "flush" and note.given != note.revision:
        note, job = give(note, trigger, at)
        out.append(job)
    return note, out


def give(note: Dirty, trigger: str, at: int) -> tuple[Dirty, tuple]:
    return replace(note, given=note.revision), (note.relpath, note.text, trigger, note.conflict, note.revision, at)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """rows: note_id, then a write."""
    d = pd.DataFrame(rows, columns=_COLUMNS)
    d["at"] = pd.to_datetime(d["at"].astype("int64"), unit="us")
    return d


def _log(events: DataFrame) -> DataFrame:
    """Events with their time in microseconds."""
    more = {"relpath": "string", "text": "string", "trigger": "string", "revision": "long"}
    return events.select("note_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("seq").cast("long").alias("seq"), "kind", *((F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in more.items()))


def writes(events: DataFrame, debounce: int = DEBOUNCE) -> DataFrame:
    """The writes of a finished log, in no order: note_id, relpath, text, trigger, conflict, revision, at. Events stream
    through in order of note and time, so no note's log is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, note = None, None

        def last() -> list[tuple]:
            return [(name, *give(note, "debounce", note.last + debounce)[1])] if note is not None and note.given != note.revision else []

        for b in batches:
            rows = []
            for n, *event in b[["note_id", *_NAMES]].astype(object).where(b[["note_id", *_NAMES]].notna(), None).itertuples(index=False):
                if n != name:
                    rows += last()
                    name, note = n, None
                note, out = step(note, _event(event), debounce)
                rows += [(n, *w) for w in out]
            yield _frame(rows)
        yield _frame(last())

    return _log(events).drop("ts").repartition("note_id").sortWithinPartitions("note_id", "at", "seq").mapInPandas(run, JOB)


def _event(values) -> tuple:
    at, seq, kind, relpath, text, trigger, revision = values
    return int(at), int(seq), kind, relpath, text, trigger, None if revision is None else int(revision)


class Autosave(StatefulProcessor):
    """Holds events until the watermark has passed them, so that they count in their order; timers say when a write is due."""

    def __init__(self, debounce: int):
        self.debounce = debounce

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.note = handle.getValueState("note", "relpath string, text string, last long, revision long, conflict boolean, given long")
        self.waiting = handle.getListState("waiting", EVENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for b in rows:
            b = b[_NAMES].astype(object)
            new += [_event(e) for e in b.where(b.notna(), None).itertuples(index=False)]
        self.waiting.appendList(new)
        # timers are in whole milliseconds; an event counts once the watermark is past it
        self.handle.registerTimer(max(min(e[0] for e in new) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield _frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        upto = mark * 1000
        held = sorted(map(_event, self.waiting.get()) if self.waiting.exists() else [])
        ready, later = [e for e in held if e[0] < upto], [e for e in held if e[0] >= upto]
        note, rows = Dirty(*self.note.get()) if self.note.exists() else None, []
        for e in ready:
            note, out = step(note, e, self.debounce)
            rows += [(key[0], *w) for w in out]
        if _due(note, upto - 1, self.debounce):
            note, job = give(note, "debounce", note.last + self.debounce)
            rows.append((key[0], *job))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if note is None:
            self.note.clear()
        else:
            self.note.update((note.relpath, note.text, note.last, note.revision, note.conflict, note.given))
        times = [e[0] for e in later[:1]] + ([note.last + self.debounce] if note is not None and note.given != note.revision else [])
        if times:
            self.handle.registerTimer(max(min(times) // 1000 + 1, mark + 1))
        yield _frame(rows)

    def close(self) -> None:
        pass


def write_stream(events: DataFrame, debounce: int = DEBOUNCE, delay: str = "10 seconds") -> DataFrame:
    """The same over a stream, by note; events may come ``delay`` late. The session's state store must be the one that
    keeps timers (RocksDB)."""
    return _log(events).withWatermark("ts", delay).groupBy("note_id").transformWithStateInPandas(statefulProcessor=Autosave(debounce), outputStructType=JOB, outputMode="Append", timeMode="EventTime")


def editor_log(spark, sf_dir) -> DataFrame:
    """The events table as a log of an editor: users as notes, ten thousand times as dense."""
    e = table(spark, sf_dir, "events")
    kind = F.expr("case event_type when 'click' then 'change' when 'purchase' then 'change' when 'view' then 'flush' when 'signup' then 'external' else 'moved' end")
    ts = F.expr("timestamp_micros(cast(unix_micros(cast(ts as timestamp)) / 10000 as bigint))")
    return e.select(F.col("user_id").cast("string").alias("note_id"), ts.alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat("event_type", F.lit(".md")).alias("relpath"), F.col("value").cast("string").alias("text"), F.lit("noteSwitch").alias("trigger"))


@query("j7_autosave")
def autosaved(spark, sf_dir):
    return writes(editor_log(spark, sf_dir))
