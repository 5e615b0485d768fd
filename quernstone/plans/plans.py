"""Edit plans as data: decode, validate, repair, apply with compare-and-swap, recover, undo.

A plan is a row (plan_id, summary, actions JSON, preconditions map by path); actions become rows. What needs only an
action and the notes are joins and windows; what must follow one plan's actions in order (the paths that they leave
taken) runs per plan. A plan of more than MOST_ACTIONS actions is invalid as a whole and changes nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..derived import apart, sent, written
from ..functions import notes as N
from ..functions.text import line_diff, patched

KINDS = ("createNote", "appendToNote", "moveNote", "retitleNote", "createFolder", "moveSegment", "tagNote")
MOST_ACTIONS = 50
DEPTH = 2
ACTION = "struct<action: string, note: string, id: string, path: string, folder: string, title: string, text: string, segment: string, segmentHash: string, to: string, tags: array<string>>"


def decode(plans: DataFrame) -> DataFrame:
    """(plan_id, action_index, action, …, known): one row an action; an unreadable list is one row with no
    action, an unknown action keeps its name.

    note: the path of a note (id: its id); createNote makes path (or title in folder), moveNote moves to path or to
    folder, moveSegment takes segment from note to the note ``to`` or to a new path; createFolder makes folder."""
    rows = plans.select("plan_id", F.posexplode_outer(F.from_json("actions", f"array<{ACTION}>")).alias("action_index", "a"))
    return rows.select("plan_id", F.coalesce("action_index", F.lit(-1)).alias("action_index"), "a.*", F.coalesce(F.col("a.action").isin(*KINDS), F.lit(False)).alias("known"))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.md$", "")


def _ancestors(folder: Column) -> Column:
    parts = F.split(folder, "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")), lambda p: p != "")


def _taken(actions: list[dict], paths: list[str]) -> list[int]:
    """Which actions of one plan land on a path that is taken when their turn comes; the plan's own moves and
    new names count."""
    occupied, now, found = set(paths), {}, []
    for r in sorted(actions, key=lambda r: r["action_index"]):
        if r["makes"]:
            if r["target"] in occupied:
                found.append(r["action_index"])
            occupied.add(r["target"])
        else:
            at = now.get(r["note"], r["note"])
            folder, _, name = at.rpartition("/")
            target = f"{r['target']}/{name}".lstrip("/") if r["action"] == "moveNote" else f"{folder}/{r['target']}.md".lstrip("/")
            if target != at and target in occupied:
                found.append(r["action_index"])
            elif target != at:
                occupied.discard(at)
                occupied.add(target)
                now[r["note"]] = target
    return found


#: Plans that are followed together.
TOGETHER = 256


def _followed(steps: DataFrame, state: DataFrame, of_actions: tuple[str, ...], of_state: tuple[str, ...], follow: Callable[[dict], list[dict]], schema: pa.Schema, types: str) -> DataFrame:
    """What follow() says of each plan: its plan_id, and its actions and state as lists. A plan is a row and batches of plans are
    followed together, so that small plans don't cost a group each. state: of_plan and what is there for it."""
    each = steps.groupBy("plan_id").agg(F.collect_list(F.struct(*of_actions)).alias("actions"))
    there = state.groupBy("of_plan").agg(F.collect_list(F.struct(*of_state)).alias("state"))
    plans = each.join(there, F.col("plan_id").eqNullSafe(F.col("of_plan")), "left").select(F.col("plan_id").cast("string").alias("plan_id"), "actions", "state")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                yield pa.RecordBatch.from_pylist([x for r in batch.slice(at, TOGETHER).to_pylist() for x in follow(r)], schema)

    return plans.mapInArrow(rows, types)


def _collided(plan: dict) -> list[dict]:
    return [{"plan_id": plan["plan_id"], "action_index": k} for k in _taken(plan["actions"], [x["relpath"] for x in plan["state"] or ()])]


def collisions(a: DataFrame, notes: DataFrame) -> DataFrame:
    """(plan_id, action_index) of the actions that would take a taken path. Only paths that a plan may touch go to it."""
    makes = F.col("action").isin("createNote") | ((F.col("action") == "moveSegment") & F.col("to").isNull())
    target = F.when(makes, F.col("path")).when(F.col("action") == "moveNote", F.col("folder")).when(F.col("action") == "retitleNote", F.col("title"))
    steps = a.where(target.isNotNull() & (makes | F.col("note").isNotNull())).select("plan_id", "action_index", "action", "note", target.alias("target"), makes.alias("makes"))
    # paths of the library that the plan names, or that a move or new name may reach, by their file names and folders
    plain = steps.where("makes").select("plan_id", F.col("target").alias("relpath")).union(steps.where("not makes").select("plan_id", F.col("note").alias("relpath")))
    names = steps.where("not makes").select("plan_id", F.when(F.col("action") == "retitleNote", F.col("target")).otherwise(_name(F.col("note"))).alias("name")).distinct()
    folders = steps.where("not makes").select("plan_id", F.explode(F.array(F.when(F.col("action") == "moveNote", F.col("target")).otherwise(_folder(F.col("note"))), _folder(F.col("note")))).alias("folder")).distinct()
    reach = names.join(folders, "plan_id").select("plan_id", F.when(F.col("folder") == "", F.concat("name", F.lit(".md"))).otherwise(F.concat("folder", F.lit("/"), "name", F.lit(".md"))).alias("relpath"))
    state = plain.union(reach).distinct().join(notes.select("relpath"), "relpath").select(F.col("plan_id").alias("of_plan"), "relpath")
    return _followed(steps, state, ("action_index", "action", "note", "target", "makes"), ("relpath",), _collided, pa.schema([("plan_id", pa.string()), ("action_index", pa.int32())]), "plan_id string, action_index int")


#: Bytes of texts up to which they are sent to every task.
SENT = 16 << 20


def texts_at(paths: DataFrame, notes: DataFrame) -> DataFrame:
    """(relpath, body) of the notes at these paths (relpath): which of them are there is found by their paths alone, and
    only the texts of those are moved."""
    there = written(paths.select("relpath").distinct().join(notes.select("relpath"), "relpath", "left_semi"), "there")
    held = written(notes.select("relpath", "body").join(sent(there), "relpath", "left_semi"), "bodies")
    size = held.agg(F.sum(F.octet_length("body") + F.octet_length("relpath"))).first()[0] or 0
    return F.broadcast(held) if size <= SENT else apart(held)


def issues(actions: DataFrame, notes: DataFrame, plans: DataFrame | None = None, excluded: tuple[str, ...] = (), session: DataFrame | None = None) -> DataFrame:
    """(plan_id, action_index, severity, kind): what is wrong, the 26 kinds that validation itself finds. Findings on a
    whole plan have index -1.

    notes: relpath, body (null: not loaded), content_hash, and id, title, tags where there are; plans: plan_id,
    preconditions; session: plan_id, session_text."""
    n = notes.select(F.col("relpath").alias("note"), *(F.col(c) if c in notes.columns else F.lit(None).cast(t).alias(c) for c, t in (("content_hash", "string"), ("tags", "array<string>"))), F.lit(True).alias("found")).withColumnRenamed("tags", "n_tags")
    every = actions.withColumn("size", F.count("*").over(Window.partitionBy("plan_id")))
    whole = every.groupBy("plan_id").agg(F.max("size").alias("size"), F.max("action_index").alias("last")).select("plan_id", F.when(F.col("last") < 0, "nothingToDo").when(F.col("size") > MOST_ACTIONS, "tooManyActions").alias("kind"), "last").where("kind is not null")
    out = [whole.select("plan_id", F.lit(-1).alias("action_index"), F.when(F.col("kind") == "nothingToDo", "warning").otherwise("error").alias("severity"), "kind")]
    a = actions.where("action_index >= 0")
    if "id" in notes.columns:
        by_id = notes.select(F.col("id").cast("string").alias("id"), F.col("relpath").alias("by_id"))
        a = a.join(by_id, "id", "left")
    else:
        a = a.withColumn("by_id", F.lit(None).cast("string"))
    a = a.withColumn("contradictory", F.coalesce((F.col("by_id") != F.col("note")) & F.col("note").isNotNull(), F.lit(False))).withColumn("note", F.coalesce("by_id", "note"))
    a = a.join(n, "note", "left")
    # only segments are looked for in texts
    cut = (F.col("action") == "moveSegment") & (F.col("segment") != "")
    if "body" in notes.columns:
        bodies = texts_at(a.where(cut).select(F.col("note").alias("relpath")), notes)
        a = a.join(bodies.withColumnRenamed("relpath", "of_body"), cut & (F.col("note") == F.col("of_body")), "left").drop("of_body")
    else:
        a = a.withColumn("body", F.lit(None).cast("string"))
    a = a.withColumn("home", F.when(F.col("action").isin("createFolder", "moveNote") & F.col("folder").isNotNull(), F.col("folder")).when(F.col("path").isNotNull(), _folder(F.col("path"))))
    have = notes.select(F.explode(_ancestors(_folder(F.col("relpath")))).alias("home")).distinct().withColumn("home_exists", F.lit(True))
    planned = a.where("action = 'createFolder'").select("plan_id", F.explode(_ancestors(F.col("folder"))).alias("home")).distinct().withColumn("home_planned", F.lit(True))
    a = a.join(have, "home", "left").join(planned, ["plan_id", "home"], "left")
    a = a.join(plans.select("plan_id", "preconditions"), "plan_id", "left") if plans is not None else a.withColumn("preconditions", F.lit(None).cast("map<string,string>"))
    a = a.join(session.select("plan_id", "session_text"), "plan_id", "left") if session is not None else a.withColumn("session_text", F.lit(None).cast("string"))
    same = Window.partitionBy("plan_id", *(F.col(c) for c in ("action", "note", "path", "folder", "title", "text", "segment", "to")), F.array_join("tags", "\x1f")).orderBy("action_index")
    before = Window.partitionBy("plan_id", "action", "note").orderBy("action_index").rowsBetween(Window.unboundedPreceding, -1)
    made = Window.partitionBy("plan_id", "path", F.col("action").isin("createNote", "moveSegment") & F.col("to").isNull()).orderBy("action_index")
    once = Window.partitionBy("plan_id", "note").orderBy("action_index")
    a = a.withColumn("again", F.row_number().over(same) > 1).withColumn("earlier_folder", F.first("folder", True).over(before)).withColumn("earlier_title", F.first("title", True).over(before)).withColumn("made", F.row_number().over(made)).withColumn("nth", F.row_number().over(once))
    a = a.join(collisions(a.select(*actions.columns), notes).withColumn("taken", F.lit(True)), ["plan_id", "action_index"], "left")
    act = lambda *k: F.col("action").isin(*k)
    refers = act("appendToNote", "moveNote", "retitleNote", "moveSegment", "tagNote")
    inside = lambda c: F.coalesce(F.lit(False) if not excluded else F.greatest(*(((c == x) | c.startswith(x + "/")).cast("int") for x in (*excluded, excluded[0]))) == 1, F.lit(False))
    empty = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")) == ""
    bad_home = F.coalesce(N.unsafe(F.col("home")), F.lit(False))
    too_deep = ~bad_home & (N.depth(F.col("home")) > DEPTH)
    shut = ~bad_home & ~too_deep & inside(F.col("home"))
    odd_part = ~bad_home & ~too_deep & ~shut & F.coalesce(F.exists(F.split("home", "/"), lambda p: (p != "") & (p.rlike(r"[:\\\\]|^[ .]|[ .]$|  "))), F.lit(False))
    title = F.coalesce(F.when(act("retitleNote"), F.col("title")).when(act("createNote") | (act("moveSegment") & F.col("to").isNull()), F.coalesce("title", _name(F.col("path")))), F.lit(None))
    needs_title = act("retitleNote", "createNote") | (act("moveSegment") & F.col("to").isNull())
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    expected = F.try_element_at("preconditions", F.col("note"))
    checks = [
        ("warning", "unreadableAction", ~F.col("known")),
        ("warning", "duplicateAction", F.col("known") & F.col("again")),
        ("error", "unsafePath", bad_home | odd_part | (refers & F.coalesce(N.unsafe(F.col("note")), F.lit(False)))),
        ("error", "folderTooDeep", too_deep),
        ("error", "excludedTarget", shut),
        ("error", "unknownFolder", F.col("known") & ~act("createFolder") & ~bad_home & ~too_deep & ~shut & ~odd_part & (F.col("home") != "") & F.col("home_exists").isNull() & F.col("home_planned").isNull()),
        ("error", "unsafeTitle", needs_title & (empty(title) | (title != N.safe_title(F.coalesce(title, F.lit("")))))),
        ("error", "titleCollision", F.coalesce("taken", F.lit(False))),
        ("error", "duplicateAction", (act("createNote") | (act("moveSegment") & F.col("to").isNull())) & F.col("path").isNotNull() & (F.col("made") > 1)),
        ("error", "emptyReference", refers & F.col("note").isNull() & F.col("id").isNull()),
        ("error", "contradictoryReference", refers & F.col("contradictory")),
        ("error", "unknownNote", refers & (F.col("note").isNotNull() | F.col("id").isNotNull()) & F.col("found").isNull() & ~inside(F.col("note")) & ~F.coalesce(N.unsafe(F.col("note")), F.lit(False))),
        ("error", "excludedSource", refers & inside(F.col("note"))),
        ("warning", "emptyContent", act("createNote") & empty(F.col("text"))),
        ("error", "emptyContent", act("appendToNote") & empty(F.col("text"))),
        ("error", "contentNotFromSession", act("createNote", "appendToNote") & F.col("session_text").isNotNull() & ~empty(F.col("text")) & N.label_only(F.col("text"), F.col("session_text"))),
        ("error", "invalidTag", F.exists(tags, lambda t: empty(t))),
        ("warning", "folderExists", act("createFolder") & F.coalesce("home_exists", F.lit(False))),
        ("warning", "noOp", (act("moveNote") & F.col("found").isNotNull() & (_folder(F.col("note")) == F.col("home"))) | (act("retitleNote") & F.col("found").isNotNull() & (_name(F.col("note")) == F.col("title")))
            | (act("tagNote") & ((F.size(tags) == 0) | (F.size(F.array_except(tags, F.coalesce(F.col("n_tags") if "n_tags" in a.columns else F.array().cast("array<string>"), F.array().cast("array<string>")))) == 0))) | (act("moveSegment") & (F.col("to") == F.col("note")))),
        ("error", "contradictoryAction", (act("moveNote") & F.col("earlier_folder").isNotNull() & (F.col("earlier_folder") != F.col("folder"))) | (act("retitleNote") & F.col("earlier_title").isNotNull() & (F.col("earlier_title") != F.col("title")))),
        ("error", "emptySegment", act("moveSegment") & (F.coalesce("segment", F.lit("")) == "")),
        ("error", "segmentHashMismatch", act("moveSegment") & (F.coalesce("segment", F.lit("")) != "") & F.col("segmentHash").isNotNull() & (F.lower("segmentHash") != F.sha2("segment", 256))),
        ("warning", "segmentUnverified", act("moveSegment") & (F.coalesce("segment", F.lit("")) != "") & F.col("found").isNotNull() & F.col("body").isNull()),
        ("error", "segmentNotFound", act("moveSegment") & (F.coalesce("segment", F.lit("")) != "") & F.col("body").isNotNull() & ~F.contains("body", "segment")),
        ("error", "missingPrecondition", F.lit(plans is not None) & refers & F.col("found").isNotNull() & (F.col("nth") == 1) & expected.isNull()),
        ("error", "stalePrecondition", F.lit(plans is not None) & refers & F.col("found").isNotNull() & (F.col("nth") == 1) & expected.isNotNull() & (expected != F.col("content_hash"))),
    ]
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(k).alias("kind"))) for s, k, c in checks)), lambda x: x.isNotNull())
    out.append(a.select("plan_id", "action_index", F.explode(found).alias("i")).select("plan_id", "action_index", "i.severity", "i.kind"))
    return out[0].union(out[1])


def valid(actions: DataFrame, found: DataFrame) -> DataFrame:
    """The plans without errors."""
    return actions.select("plan_id").distinct().join(found.where("severity = 'error'").select("plan_id"), "plan_id", "left_anti")


OUTCOME = "plan_id string, status string, relpath string, before string, after string"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


PHASES = {k: i for i, k in enumerate(("createFolder", "createNote", "appendToNote", "moveSegment", "tagNote", "retitleNote", "moveNote"))}


def _append(content: str, body: str) -> str:
    head, new = body.rstrip(), content.strip()
    return (f"{new}\n" if new else "") if not head else f"{head}\n\n---\n\n{new}\n"


def _cut(segment: str, body: str) -> str:
    at = body.index(segment)
    head, tail = body[:at].rstrip(), body[at + len(segment) :].lstrip()
    return "\n\n".join(x for x in (head, tail) if x) + ("\n" if head and not tail else "")


def _apply(plan: dict) -> list[dict]:
    """One plan on the notes that it names: all of it, or none. Actions go by phases (folders, new notes, additions,
    segments, tags, titles, moves), in their order within one; paths are those of before the plan."""
    actions = plan["actions"]
    notes = {x["relpath"]: x["body"] or "" for x in plan["state"] or ()}
    first, now, want = dict(notes), {}, json.loads(actions[0]["preconditions"] or "{}")
    done: list[dict] = []
    row = lambda status, *more: dict(zip(("plan_id", "status", "relpath", "before", "after"), (plan["plan_id"], status, *more), strict=False))
    fail = lambda why: [row(why)]
    if len(actions) > MOST_ACTIONS or any(r["action"] not in KINDS for r in actions):
        return fail("invalid")
    if any(p not in notes or _hash(notes[p]) != h for p, h in want.items()):
        return fail("conflict")
    for r in sorted(actions, key=lambda r: (PHASES[r["action"]], r["action_index"])):
        at = now.get(r["note"], r["note"])
        if r["action"] not in ("createNote", "createFolder") and at not in notes:
            return fail("failed")
        if r["action"] == "createNote":
            if not r["path"] or r["path"] in notes:
                return fail("conflict")
            notes[r["path"]] = (r["text"] or "").strip() + "\n" if (r["text"] or "").strip() else ""
        elif r["action"] == "createFolder":
            done.append(row("folder", r["folder"]))
        elif r["action"] == "appendToNote":
            notes[at] = _append(r["text"] or "", notes[at])
        elif r["action"] == "moveSegment":
            target = now.get(r["to"], r["to"]) or r["path"]
            if not r["segment"] or r["segment"] not in notes[at] or target == at or not target:
                return fail("conflict" if target else "failed")
            notes[at] = _cut(r["segment"], notes[at])
            notes[target] = _append(r["segment"], notes.get(target, ""))
            if not notes[at].strip():
                del notes[at]
        elif r["action"] == "tagNote":
            done.append(row("tagged", at, None, ",".join(r["tags"] or [])))
        else:
            folder, _, name = at.rpartition("/")
            target = f"{folder}/{r['title']}.md".lstrip("/") if r["action"] == "retitleNote" else r["path"] or f"{r['folder'] or ''}/{name}".lstrip("/")
            if target != at:
                if target in notes:
                    return fail("conflict")
                notes[target] = notes.pop(at)
                now[r["note"]] = target
    changed = [row("applied", p, first.get(p), notes.get(p)) for p in sorted({*first, *notes}) if first.get(p) != notes.get(p)]
    return changed + done or [row("applied")]


def _reachable() -> list[Column]:
    """Paths that a move or a new title leads to."""
    folder, name = _folder(F.col("note")), F.regexp_replace("note", "^.*/", "")
    at = lambda f, n: F.when(F.coalesce(f, F.lit("")) == "", n).otherwise(F.concat(f, F.lit("/"), n))
    return [F.when(F.col("action") == "retitleNote", at(folder, F.concat("title", F.lit(".md")))), F.when((F.col("action") == "moveNote") & F.col("path").isNull(), at(F.col("folder"), name))]


def apply(actions: DataFrame, plans: DataFrame, notes: DataFrame, excluded: tuple[str, ...] = (), session: DataFrame | None = None) -> DataFrame:
    """Images before and after of each note that a plan changes; a plan whose preconditions (hashes by path)
    no longer hold changes nothing and is a conflict. Plans are validated first: one with an error, other than about its
    preconditions, which the notes' own texts decide, is invalid and changes nothing."""
    good = written(valid(actions, issues(actions, notes, None, excluded, session)), "valid")
    refused = actions.select("plan_id").distinct().join(good, "plan_id", "left_anti").select("plan_id", F.lit("invalid").alias("status"), *(F.lit(None).cast("string").alias(c) for c in ("relpath", "before", "after")))
    a = actions.join(good, "plan_id", "left_semi").join(plans.select("plan_id", F.to_json("preconditions").alias("preconditions")), "plan_id")
    named = a.select("plan_id", F.explode(F.array_distinct(F.concat(F.array("note", "path", "to", *_reachable()), F.coalesce(F.map_keys(F.from_json("preconditions", "map<string,string>")), F.array().cast("array<string>"))))).alias("relpath")).where("relpath is not null").distinct()
    named = written(named, "named")
    state = named.join(texts_at(named, notes), "relpath").select(F.col("plan_id").alias("of_plan"), "relpath", "body")
    of_actions = ("action_index", "action", "note", "path", "folder", "title", "text", "segment", "to", "tags", "preconditions")
    return _followed(a, state, of_actions, ("relpath", "body"), _apply, pa.schema([(c, pa.string()) for c in ("plan_id", "status", "relpath", "before", "after")]), OUTCOME).union(refused)


def recovered(images: DataFrame, disk: DataFrame) -> DataFrame:
    """(event_id, relpath, outcome, text): what a run that broke off leaves to do. An event all of whose notes already
    are as it wanted goes forward and leaves nothing; else its notes go back, newest first: new ones to the trash, others
    to their texts before. Where a note is neither as before nor as after, the event has failed and nothing is written.

    images: event_id, relpath, before, after (null: no such note); disk: relpath, body."""
    now = images.join(disk.select("relpath", F.col("body").alias("current"), F.lit(True).alias("there")), "relpath", "left")
    is_after = F.col("after").eqNullSafe(F.col("current"))
    is_before = F.col("before").eqNullSafe(F.col("current"))
    state = now.groupBy("event_id").agg(F.bool_and(is_after).alias("forward"), F.bool_and(is_after | is_before).alias("known"))
    step = F.when(F.col("forward"), "done").when(~F.col("known"), "failed").when(is_before, "kept").when(F.col("before").isNull(), "trashed").otherwise("rewritten")
    return now.join(state, "event_id").select("event_id", "relpath", step.alias("outcome"), F.when(step == "rewritten", F.col("before")).alias("text"))


def undone(before: str | None, after: str | None, current: str | None) -> tuple[str, str | None]:
    """(outcome, text) of taking one change back on a note that may have moved on."""
    if before is None:
        return ("trashed", None) if current == after else ("conflict", current)
    if current is None:
        return ("recreated", before) if after is None else ("conflict", None)
    if current == after:
        return "restored", before
    text = patched(current, line_diff(before, after or ""), reverse=True)
    return ("conflict", current) if text is None else ("patched", text)


def undo(images: DataFrame) -> DataFrame:
    """images (plan_id, relpath, before, after, current) with the outcome and the text of each note's undo."""

    def rows(batches):
        for b in batches:
            out = [undone(*x) for x in b[["before", "after", "current"]].where(b.notna(), None).itertuples(index=False)]
            yield b[["plan_id", "relpath"]].assign(outcome=[o for o, _ in out], text=[t for _, t in out])

    return images.mapInPandas(rows, "plan_id string, relpath string, outcome string, text string")
