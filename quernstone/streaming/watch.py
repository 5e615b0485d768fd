"""A watched folder of notes: a stream of events (path, overflow), of which each batch is reconciled with what was known.

A batch that names notes looks at these only: their files, the known rows at their paths, and the known rows of the ids that the
files bear, so that a note is found again wherever it was. An overflow, a path that is no note (a folder), or more paths than
``most`` make it a full listing. Known rows are kept in buckets by folder and by id, of which a batch rewrites
those that it touches.

A batch first writes its changes, then applies them. Done again after that, it takes the written ones, so each change is told
once, and applying twice is the same.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..derived import Inverted, folder, written
from ..functions.notes import is_note
from ..operators.joins import reconcile
from ..plans.plans import _ancestors, _folder
from ..sources import markdown

KNOWN = ("relpath", "id", "content_hash")


def events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of events from JSON lines: path (below the root), overflow."""
    return spark.readStream.schema("path string, overflow boolean").json(path)


def implied(paths: Column) -> Column:
    """All folders that a note's path lies in."""
    return _ancestors(_folder(paths))


class Watch:
    """What is known of a folder, and the changes that batches have told."""

    def __init__(self, spark: SparkSession, root: str, uri: str | None = None, buckets: int = 16, most: int = 10_000):
        self.spark, self.root, self.most, self.uri = spark, root, most, uri or folder(spark, "watch")
        none = spark.createDataFrame([], "folder string, relpath string, id string, content_hash string")
        self.by_folder = Inverted.build(none, "folder", "by_folder", buckets, f"{self.uri}/by_folder")
        self.by_id = Inverted.build(none.select("id", "relpath", "content_hash"), "id", "by_id", buckets, f"{self.uri}/by_id")

    def known(self) -> DataFrame:
        return self.by_folder.rows().select(*KNOWN)

    def _at(self, paths: DataFrame) -> DataFrame:
        """The known rows at these paths (relpath)."""
        folders = paths.select(_folder(F.col("relpath")).alias("folder")).distinct()
        return self.by_folder.rows(folders).join(paths.select("relpath"), "relpath", "left_semi").select(*KNOWN)

    def _there(self, paths: DataFrame) -> list[str]:
        """Those of these paths (``most`` at most, by whoever asks) that have a file."""
        return sorted(r.relpath for r in markdown.listing(self.spark, self.root).select("relpath").join(paths.select("relpath"), "relpath", "left_semi").collect())

    def _files(self, paths: list[str] | None) -> DataFrame:
        if paths is not None and not paths:
            return self.spark.createDataFrame([], "relpath string, id string, content_hash string")
        return written(markdown.notes(self.spark, self.root, paths).select(*KNOWN), "files")

    def _scoped(self, paths: DataFrame) -> DataFrame:
        disk = self._files(self._there(paths))
        known = written(self._at(paths).union(self.by_id.rows(disk.select("id")).select(*KNOWN)).distinct(), "known")
        # notes of the same id elsewhere: where their files are still there, nothing has happened to them
        elsewhere = known.join(paths, "relpath", "left_anti")
        still = [] if elsewhere.isEmpty() else self._there(elsewhere)
        there = known.where(F.col("relpath").isin(still)) if still else known.limit(0)
        every = disk.union(there.join(paths, "relpath", "left_anti"))
        new = disk.select(_folder(F.col("relpath")).alias("relpath")).where("relpath <> ''").distinct()
        have = self.by_folder.rows(new).select(F.col("folder").alias("relpath")).distinct()
        return self._told(every, known).unionByName(new.join(have, "relpath", "left_anti").select(F.lit("folderAdded").alias("change"), "relpath"), allowMissingColumns=True)

    def _full(self) -> DataFrame:
        disk, known = self._files(None), written(self.known(), "known")
        folders = lambda d: d.select(F.explode(implied(F.col("relpath"))).alias("relpath")).distinct()
        here, before = folders(disk), folders(known)
        told = self._told(disk, known)
        for a, b, change in ((here, before, "folderAdded"), (before, here, "folderRemoved")):
            told = told.unionByName(a.join(b, "relpath", "left_anti").select(F.lit(change).alias("change"), "relpath"), allowMissingColumns=True)
        return told

    @staticmethod
    def _told(disk: DataFrame, known: DataFrame) -> DataFrame:
        """change, relpath, from_path, id, content_hash: as reconcile() tells them; a moved or modified note keeps its id, a
        copy gets one of its own."""
        d = disk.select("relpath", F.col("id").alias("disk_id"), F.col("content_hash").alias("new_hash"))
        k = known.select(F.col("relpath").alias("old_path"), F.col("id").alias("old_id"))
        c = reconcile(disk, known).join(d, "relpath", "left").withColumn("old_path", F.coalesce("from_path", F.when(F.col("change") != "added", F.col("relpath")))).join(k, "old_path", "left")
        taken = known.select(F.col("id").alias("disk_id"), F.lit(True).alias("taken")).distinct()
        c = c.join(taken, "disk_id", "left")
        fresh = F.when(F.col("taken"), markdown.derived_id(F.col("relpath"))).otherwise(F.col("disk_id"))
        return c.select("change", "relpath", "from_path", F.coalesce("old_id", fresh).alias("id"), F.col("new_hash").alias("content_hash"))

    def _apply(self, changes: DataFrame) -> None:
        notes_ = changes.where(~F.col("change").startswith("folder"))
        gone = notes_.select(F.coalesce("from_path", "relpath").alias("relpath")).union(notes_.select("relpath")).distinct()
        new = notes_.where("change <> 'removed'").select(*KNOWN)
        old = written(self._at(gone), "old")
        folders = gone.select(_folder(F.col("relpath")).alias("folder"))
        kept = self.by_folder.pruned(folders).join(gone, "relpath", "left_anti").select("folder", *KNOWN)
        ids = old.select("id").union(new.select("id")).distinct()
        held = self.by_id.pruned(ids).join(gone, "relpath", "left_anti").select("id", "relpath", "content_hash")
        touched = self.by_id.touched(ids)
        # by id first: it is looked up by what the other one still has
        self.by_id.replace(touched, held.union(new.select("id", "relpath", "content_hash")))
        self.by_folder.replace(self.by_folder.touched(folders), kept.union(new.select(_folder(F.col("relpath")).alias("folder"), *KNOWN)))

    def batch(self, rows: DataFrame, number: int) -> DataFrame:
        """Reconciles one batch of events and gives its changes: change (added, modified, moved, removed, folderAdded,
        folderRemoved), relpath, from_path, id, content_hash."""
        out = f"{self.uri}/changes/batch={number}"
        try:
            changes = self.spark.read.parquet(out)
        except AnalysisException:
            named = rows.where("path is not null and path <> ''").select(F.col("path").alias("relpath")).distinct()
            what = named.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(~is_note(F.col("relpath"))), F.lit(False)).alias("folders")).first()
            lost = rows.where("overflow").limit(1).count() > 0
            found = self._full() if lost or what.folders or what.n > self.most else self._scoped(written(named, "scope"))
            found.write.mode("overwrite").parquet(out)
            changes = self.spark.read.schema(found.schema).parquet(out)
        self._apply(changes)
        return changes

    def start(self, stream: DataFrame, checkpoint: str, once: bool = True):
        """A running query over a stream of events."""
        trigger = {"availableNow": True} if once else {"processingTime": "500 milliseconds"}
        return stream.writeStream.foreachBatch(lambda b, n: (self.batch(b, n), None)[1]).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def changes(self) -> DataFrame:
        """All changes told so far, with their batch."""
        return self.spark.read.parquet(f"{self.uri}/changes")
