"""Plan repair: an ordered fold over each plan's actions, every step on what the last one left.

1. drop: folders that nothing is filed into, and repeats of one.
2. clamp: folders that are too deep keep their last levels; a move isn't clamped onto a note that is there.
3. collide: a note to create where one is becomes an addition to it, its tags follow at the end; a segment for a new note
   goes to the one that is there.
4. copy: a segment that its note doesn't hold word for word is added where it was to go; the note keeps its text.
5. insert: folders that are needed and missing come first.
6. preconditions are those of the notes that the repaired plan names.

Steps 1 to 5 need, besides the plan, only which of the paths and folders in its reach exist, and the texts of notes that it
takes segments from. Excluded notes are no targets. A plan without anything to repair stays as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..derived import written
from ..functions import notes as N
from .plans import DEPTH, MOST_ACTIONS, _ancestors, _folder, texts_at

FIELDS = ("action", "note", "id", "path", "folder", "title", "text", "segment", "segmentHash", "to", "tags")
ROWS = "plan_id string, action_index int, action string, note string, id string, path string, folder string, title string, text string, segment string, segmentHash string, `to` string, tags array<string>, known boolean, finding string"
FOLDED = pa.schema([("plan_id", pa.string()), ("action_index", pa.int32()), *((c, pa.list_(pa.string()) if c == "tags" else pa.string()) for c in FIELDS), ("known", pa.bool_()), ("finding", pa.string())])
#: Plans that are folded together.
TOGETHER = 256
DROPPED, DEEP, COLLISION, MERGE, MISSING = "droppedUnusedFolder", "repairedFolderDepth", "repairedCollision", "repairedMerge", "repairedMissingFolder"


def _parent(path: str) -> str:
    return path.rpartition("/")[0]


def _key(folder: str | None) -> str:
    return "/".join(p for p in (folder or "").split("/") if p and p != ".")


def _lineage(folder: str) -> list[str]:
    parts = _key(folder).split("/")
    return ["/".join(parts[:k]) for k in range(1, len(parts) + 1) if parts[0]]


def _new_note(a: dict) -> bool:
    return a["action"] == "createNote" or a["action"] == "moveSegment" and not a["to"]


def filed_into(a: dict) -> str | None:
    """The folder that an action files something into."""
    if _new_note(a):
        return a["folder"] or "" if a["path"] is None else _parent(a["path"])
    return a["folder"] if a["action"] == "moveNote" and a["path"] is None else _parent(a["path"]) if a["action"] == "moveNote" else None


def target(a: dict) -> str | None:
    """The path that a new note gets."""
    return a["path"] if a["path"] is not None else f"{_key(a['folder'])}/{a['title']}.md".lstrip("/") if a["title"] else None


def _sound(folder: str) -> bool:
    """Whether a folder's parts may all be names as they stand."""
    return not re.search("^[/~]|[\\x00\n\r]", folder) and all(p != ".." and N.clean_title(p) == p for p in _key(folder).split("/"))


def _inside(path: str, excluded: tuple[str, ...]) -> bool:
    return any(path == x or path.startswith(f"{x}/") for x in excluded)


def drop(actions: list[dict]) -> tuple[list[dict], list[tuple]]:
    used = {x for a in actions if (f := filed_into(a)) for x in _lineage(f)}
    kept, found, made = [], [], set()
    for a in actions:
        if a["action"] == "createFolder":
            folder = _key(a["folder"])
            if folder not in used or folder in made:
                found.append((-1, DROPPED))
                continue
            made.add(folder)
        kept.append(a)
    return kept, found


def clamp(actions: list[dict], taken: set[str], excluded: tuple[str, ...]) -> tuple[list[dict], list[tuple]]:
    out, found = [], []
    for k, a in enumerate(actions):
        deep = a["folder"] if a["action"] == "createFolder" else filed_into(a)
        parts = _key(deep).split("/")
        shallow = "/".join(parts[-DEPTH:])
        if deep and len(parts) > DEPTH and _sound(deep) and not _inside(shallow, excluded):
            moves = a["action"] == "moveNote"
            name = (a["path"] if a["path"] is not None else a["note"] or "").rpartition("/")[2]
            if not moves or a["note"] and f"{shallow}/{name}" not in taken:
                a = a | ({"path": f"{shallow}/{name}"} if a["path"] is not None else {"folder": shallow})
                found.append((k, DEEP))
        out.append(a)
    return out, found


def collide(actions: list[dict], taken: set[str], excluded: tuple[str, ...]) -> tuple[list[dict], list[dict], list[tuple]]:
    out, trailing, found = [], [], []
    for k, a in enumerate(actions):
        at = target(a) if _new_note(a) else None
        if at is not None and at in taken and not _inside(at, excluded):
            found.append((k, COLLISION))
            if a["tags"]:
                trailing.append(blank("tagNote") | {"note": at, "tags": a["tags"]})
            if a["action"] == "createNote":
                a = blank("appendToNote") | {"note": at, "text": a["text"]}
            else:
                a = a | {"to": at, "path": None, "folder": None, "title": None, "tags": None}
        out.append(a)
    return out, trailing, found


def copy(actions: list[dict], bodies: dict[str, str], excluded: tuple[str, ...]) -> tuple[list[dict], list[tuple]]:
    out, found = [], []
    for k, a in enumerate(actions):
        body = bodies.get(a["note"]) if a["action"] == "moveSegment" and a["segment"] else None
        if body is not None and a["segment"] not in body and not (a["to"] and _inside(a["to"], excluded)):
            found.append((k, MERGE))
            a = (blank("appendToNote") | {"note": a["to"]} if a["to"] else blank("createNote") | {c: a[c] for c in ("path", "folder", "title", "tags")}) | {"text": a["segment"]}
        out.append(a)
    return out, found


def insert(actions: list[dict], folders: set[str], excluded: tuple[str, ...]) -> tuple[list[dict], list[tuple]]:
    made, first, found = {_key(a["folder"]) for a in actions if a["action"] == "createFolder"}, [], []
    for k, a in enumerate(actions):
        folder = filed_into(a)
        if folder and folder not in folders and folder not in made and not _inside(folder, excluded) and _sound(folder) and len(folder.split("/")) <= DEPTH:
            made.add(folder)
            first.append(blank("createFolder") | {"folder": folder})
            found.append((k, MISSING))
    return first + actions, found


def blank(action: str) -> dict:
    return dict.fromkeys(FIELDS) | {"action": action, "known": True}


def fold(actions: list[dict], taken: set[str], folders: set[str], bodies: dict[str, str], excluded: tuple[str, ...] = ()) -> tuple[list[dict], list[tuple]]:
    """(actions, findings) of one plan after all steps; findings: (place, kind), places before folders came first."""
    now, dropped = drop(actions)
    now, deep = clamp(now, taken, excluded)
    now, trailing, met = collide(now, taken, excluded)
    now, copied = copy(now, bodies, excluded)
    now, missing = insert(now, folders, excluded)
    return now + trailing, [*dropped, *deep, *sorted([*met, *copied]), *missing]


def _reach(a: DataFrame) -> DataFrame:
    """(plan_id, relpath) of the paths that a plan may take, as they are and clamped, and of notes it takes segments from."""
    cut = lambda f: F.array_join(F.slice(F.split(f, "/"), F.greatest(F.size(F.split(f, "/")) - DEPTH + 1, F.lit(1)), F.lit(DEPTH)), "/")
    at = lambda f, n: F.when(F.coalesce(f, F.lit("")) == "", n).otherwise(F.concat(f, F.lit("/"), n))
    clean = lambda c: F.array_join(F.filter(F.split(c, "/"), lambda p: (p != "") & (p != ".")), "/")
    name = F.regexp_replace(F.coalesce("path", "note"), "^.*/", "")
    folder = F.coalesce(F.when(F.col("path").isNotNull(), _folder(F.col("path"))), F.col("folder"), F.lit(""))
    file = F.when(F.col("action") == "moveNote", name).otherwise(F.coalesce(F.when(F.col("path").isNotNull(), name), F.concat("title", F.lit(".md"))))
    paths = F.array("path", "note", "to", at(clean(folder), file), at(cut(clean(folder)), file))
    return a.select("plan_id", F.explode(F.array_distinct(paths)).alias("relpath")).where("relpath is not null").distinct()


def _folded(batches: Iterator[pa.RecordBatch], excluded: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The rows of ROWS of plans, a plan a row: its actions in order, and what is there in its reach."""
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            out = []
            for r in batch.slice(at, TOGETHER).to_pylist():
                rows = [{c: x[c] for c in (*FIELDS, "known")} for x in r["actions"]]
                now, found = fold(rows, set(r["taken"] or ()), set(r["folders"] or ()), {x["relpath"]: x["body"] for x in r["bodies"] or ()}, excluded)
                out += [{"plan_id": r["plan_id"], "action_index": k, **x} for k, x in enumerate(now)]
                out += [{"plan_id": r["plan_id"], "action_index": k, "finding": what} for k, what in found]
            yield pa.RecordBatch.from_pylist(out, FOLDED)


def _plans(small: DataFrame, notes: DataFrame) -> DataFrame:
    """plan_id, actions, taken, folders, bodies: a row a plan. Only the texts of notes that a plan takes segments from go
    with it. notes: relpath, and body if there is one."""
    reach = _reach(small)
    there = reach.join(notes.select("relpath"), "relpath").select("plan_id", "relpath", F.lit(True).alias("note"), F.lit(None).cast("string").alias("body"))
    have = notes.select(F.explode(_ancestors(_folder(F.col("relpath")))).alias("relpath")).distinct()
    folders = reach.select("plan_id", _folder(F.col("relpath")).alias("relpath")).distinct().join(have, "relpath").select("plan_id", "relpath", F.lit(False).alias("note"), F.lit(None).cast("string").alias("body"))
    state = there.union(folders)
    if "body" in notes.columns:
        source = small.where("action = 'moveSegment' and segment <> ''").select("plan_id", F.col("note").alias("relpath")).distinct()
        state = state.union(source.join(texts_at(source, notes).where("body is not null"), "relpath").select("plan_id", "relpath", F.lit(True).alias("note"), "body"))
    state = state.groupBy(F.col("plan_id").alias("of_plan")).agg(
        F.collect_set(F.when(F.col("note"), F.col("relpath"))).alias("taken"), F.collect_set(F.when(~F.col("note"), F.col("relpath"))).alias("folders"),
        F.collect_list(F.when(F.col("body").isNotNull(), F.struct("relpath", "body"))).alias("bodies"))
    each = small.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("action_index", *FIELDS, "known"))).alias("actions"))
    return each.join(state, F.col("plan_id").eqNullSafe(F.col("of_plan")), "left").drop("of_plan")


def repair(actions: DataFrame, notes: DataFrame, excluded: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(actions, findings) of plans after the repairs: plan_id, action_index, severity, kind of a finding. Plans that
    can't be read, or of more actions than a plan may have, are left as they are. notes: relpath, body."""
    a = actions.withColumn("n", F.count("*").over(_by_plan()))
    small = written(a.where((F.col("n") <= MOST_ACTIONS) & (F.col("action_index") >= 0)).drop("n"), "plans")
    rest = a.where((F.col("n") > MOST_ACTIONS) | (F.col("action_index") < 0)).drop("n")
    both = written(_plans(small, notes).mapInArrow(partial(_folded, excluded=excluded), ROWS), "repaired")
    findings = both.where("finding is not null").select("plan_id", "action_index", F.lit("warning").alias("severity"), F.col("finding").alias("kind"))
    return both.where("finding is null").select(*actions.columns).unionByName(rest.select(*actions.columns)), findings


def _by_plan():
    from pyspark.sql import Window

    return Window.partitionBy("plan_id")


def preconditions(actions: DataFrame, notes: DataFrame) -> DataFrame:
    """(plan_id, preconditions): the hash by path of each note that a plan names. notes: relpath, content_hash."""
    named = actions.select("plan_id", F.explode(F.array_distinct(F.array("note", F.when(F.col("action") == "moveSegment", F.col("to"))))).alias("relpath")).where("relpath is not null").distinct()
    held = named.join(notes.select("relpath", "content_hash"), "relpath").groupBy("plan_id").agg(F.map_from_entries(F.collect_list(F.struct("relpath", "content_hash"))).alias("p"))
    return actions.select("plan_id").distinct().join(held, "plan_id", "left").select("plan_id", F.coalesce("p", F.create_map().cast("map<string,string>")).alias("preconditions"))
