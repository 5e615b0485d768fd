"""Where results and rows come from and go to besides tables: reports, corpora, streams of files, importers."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.notes import is_note


class Importer(Protocol):
    """Something that brings notes from elsewhere: a name, whether it can read a path, and its notes."""

    name: str

    def can_read(self, path: str) -> bool: ...

    def notes(self, spark: SparkSession, path: str) -> DataFrame:
        """relpath, text, created, tags."""
        ...


def importer_for(path: str, importers: Iterable[Importer]) -> Importer:
    """The first importer that can read a path; none is a ValueError."""
    for i in importers:
        if i.can_read(path):
            return i
    raise ValueError(f"no importer reads {path!r}")


def markdown_table(metrics: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; numbers to three places, ``most`` rows at most."""
    rows = metrics.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    said = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(metrics.columns) + " |", "|" + "---|" * len(metrics.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(said, r)) + " |" for r in rows)]) + "\n"


def failures(evaluated: DataFrame) -> DataFrame:
    """query_id, category, text, wanted, found: questions whose wanted note isn't first, worst rank first."""
    return evaluated.where("rank is null or rank > 1").select("query_id", "category", "text", "wanted", "found", "rank").orderBy(F.desc_nulls_first("rank"), "query_id")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the rows of each table, one row a table."""
    return reduce(DataFrame.union, (t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()))


def catalog(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(name, n) of the tables and views that the session's catalog lists."""
    names = [t.name for t in spark.catalog.listTables(database)]
    if not names:
        return spark.createDataFrame([], "name string, n long")
    return row_counts({n: spark.table(f"{database}.{n}" if database and not spark.catalog.getTable(n).isTemporary else n) for n in names})


def write_json(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


def corpus(golden: DataFrame, distractors: DataFrame) -> DataFrame:
    """relpath, text, golden of a corpus to search: golden notes win over distractors at the same path."""
    rest = distractors.join(golden.select("relpath"), "relpath", "left_anti")
    return golden.select("relpath", "text", F.lit(True).alias("golden")).union(rest.select("relpath", "text", F.lit(False).alias("golden")))


def file_changes(spark: SparkSession, root: str, each_seconds: str = "500 milliseconds"):
    """A stream of new and rewritten notes under a root (relpath, mtime, size, content) as a writer that fires twice a
    second: ``.foreachBatch(...).start()`` on it. Removals don't show in a file source: a reconcile against a full listing
    in the batch finds them."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").schema("path string, modificationTime timestamp, length bigint, content binary").load(root)
    name = root.rstrip("/").split("/")[-1]
    rows = files.select(F.substring_index("path", f"/{name}/", -1).alias("relpath"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    return rows.where(is_note(F.col("relpath"))).writeStream.trigger(processingTime=each_seconds)


class Progress(StreamingQueryListener):
    """Counts what streams have done: batches and rows by query name, and the last error."""

    def __init__(self) -> None:
        self.batches: dict[str, int] = {}
        self.rows: dict[str, int] = {}
        self.error: str | None = None

    def onQueryStarted(self, event) -> None:
        self.batches.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        self.batches[name] = self.batches.get(name, 0) + 1
        self.rows[name] = self.rows.get(name, 0) + max(0, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.error = event.exception or self.error
