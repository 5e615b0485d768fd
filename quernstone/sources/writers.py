"""Notes written as Markdown files under an output root, and folders of files moved aside; input roots stay as they are.

Tasks write their own rows: a file under a temporary name, then moved into place, so that a task that is lost or runs
twice leaves whole files only. The root must be a folder that every executor sees.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..derived import numbered
from ..functions import notes as N

TRASH = ".trash"


def place(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(part, path)


def free_names(new: DataFrame, taken: DataFrame) -> DataFrame:
    """relpath for each row of new (folder_path, title): Title.md, or the first free Title 2.md, Title 3.md, ...; rows that
    ask for one name get theirs in the order of their ids. taken: relpath (in any case)."""
    n = numbered(new.withColumn("stem", N.safe_title("title")).withColumn("base", F.lower("stem")), ["folder_path", "base"], ["id"], "nth")
    at = lambda k: F.concat(F.when(F.col("folder_path") == "", "").otherwise(F.concat("folder_path", F.lit("/"))), N.numbered(F.col("stem"), k), F.lit(".md"))
    # numbers that are taken: those of the library's files of this name
    t = taken.select(F.regexp_replace("relpath", "/?[^/]*$", "").alias("folder_path"), F.regexp_replace(F.regexp_extract("relpath", "[^/]*$", 0), r"\.md$", "").alias("file"))
    t = t.select("folder_path", F.lower(F.regexp_replace("file", r" \d+$", "")).alias("base"), F.coalesce(F.nullif(F.regexp_extract("file", r" (\d+)$", 1), F.lit("")).cast("int"), F.lit(1)).alias("number")).union(
        t.select("folder_path", F.lower("file"), F.lit(1)))
    # of the taken numbers in order the k-th has number - k free ones before it: a new one goes past those with fewer than its turn
    held = numbered(t.distinct(), ["folder_path", "base"], ["number"], "k").withColumn("gap", F.col("number") - F.col("k"))
    held = held.groupBy("folder_path", "base", "gap").agg(F.count("*").alias("run"))
    upto = Window.partitionBy("folder_path", "base").orderBy("gap")
    runs = held.select("folder_path", "base", "gap", F.sum("run").over(upto).alias("passed"))
    steps = n.select("folder_path", "base", "nth").distinct().join(runs, ["folder_path", "base"]).where("gap < nth").groupBy("folder_path", "base", "nth").agg(F.max("passed").alias("passed"))
    n = n.join(steps, ["folder_path", "base", "nth"], "left")
    return n.withColumn("relpath", at((F.col("nth") + F.coalesce("passed", F.lit(0))).cast("int"))).drop("stem", "nth", "base", "passed")


def save(notes: DataFrame, root: str) -> int:
    """Writes relpath and text of each row; returns how many. Unsafe paths are refused before anything is written."""
    if bad := notes.where(N.unsafe(F.col("relpath")) | ~N.is_note(F.col("relpath"))).limit(1).collect():
        raise ValueError(f"not a note's path: {bad[0].relpath!r}")

    def write(rows) -> None:
        for r in rows:
            place(f"{root}/{r.relpath}", r.text)

    notes.select("relpath", "text").foreachPartition(write)
    return notes.count()


def move(moves: DataFrame, root: str) -> None:
    """Renames from_path to relpath; a file that already stands there stays, and the move fails."""

    def run(rows) -> None:
        for r in rows:
            to = f"{root}/{r.relpath}"
            os.makedirs(os.path.dirname(to), exist_ok=True)
            if os.path.exists(f"{root}/{r.from_path}"):  # else an earlier attempt has moved it
                os.link(f"{root}/{r.from_path}", to)
                os.unlink(f"{root}/{r.from_path}")

    moves.select("relpath", "from_path").foreachPartition(run)


def delete(paths: DataFrame, root: str) -> None:
    """Moves notes to the trash under the root, where they keep their paths."""
    move(paths.select(F.concat(F.lit(f"{TRASH}/"), "relpath").alias("relpath"), F.col("relpath").alias("from_path")), root)


def conflict_copies(changed: DataFrame, taken: DataFrame) -> DataFrame:
    """(note_id, relpath, text, kind) to write where a note was edited here and elsewhere.

    changed: id, relpath, folder_path, title, mine, theirs (null: deleted elsewhere), theirs_at. Ours goes to the note's
    path; a different text from elsewhere gets a new note beside it, named by the minute it was written."""
    c = changed.where(~F.col("mine").eqNullSafe(F.col("theirs")))
    ours = c.select("id", "relpath", F.col("mine").alias("text"), F.lit("saved").alias("kind"))
    stamp = F.date_format("theirs_at", "yyyy-MM-dd HHmm")
    copies = c.where("theirs is not null").select("id", "folder_path", F.concat("title", F.lit(" (external edit "), stamp, F.lit(")")).alias("title"), "theirs")
    copies = free_names(copies, taken).select("id", "relpath", F.col("theirs").alias("text"), F.lit("copy").alias("kind"))
    return ours.union(copies)


def settled(mtime: Column, now: Column, seconds: int = 2) -> Column:
    """Whether a file is old enough for its time to be trusted: one written within the window may change again within it."""
    return F.unix_micros(mtime.cast("timestamp")) <= F.unix_micros(now.cast("timestamp")) - seconds * 1_000_000
