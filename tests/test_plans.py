"""Every kind of finding, application by phases, recovery and undo, against exact expected rows."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from quernstone.operators import organise
from quernstone.plans import plans as P
from quernstone.plans.repair import preconditions, repair

NOTES = [("a.md", "1", "alpha body\nkeep this", ["t"]), ("box/b.md", "2", "beta", []), ("box/c.md", "3", None, []), ("secret/s.md", "4", "hidden", [])]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def library(spark):
    return spark.createDataFrame([(p, i, b, t, sha(b or "")) for p, i, b, t in NOTES], "relpath string, id string, body string, tags array<string>, content_hash string")


def plans(spark, rows):
    return spark.createDataFrame([(k, "s", json.dumps(a) if not isinstance(a, str) else a, pre) for k, a, pre in rows], "plan_id string, summary string, actions string, preconditions map<string,string>")


def act(action, **more):
    return {"action": action, **more}


OK = {p: sha(b or "") for p, _, b, _ in NOTES}
CASES = {
    "nothingToDo": ([], {(-1, "warning")}),
    "tooManyActions": ([act("createFolder", folder=f"f{k}") for k in range(51)], {(-1, "error")}),
    "unreadableAction": ([act("explode")], {(0, "warning")}),
    "duplicateAction": ([act("appendToNote", note="a.md", text="alpha body text of some length here")] * 2, {(1, "warning")}),
    "unsafePath": ([act("createNote", path="../x.md", title="x", text="alpha body of some length it has")], {(0, "error")}),
    "folderTooDeep": ([act("createFolder", folder="a/b/c")], {(0, "error")}),
    "excludedTarget": ([act("createFolder", folder="secret/in")], {(0, "error")}),
    "unknownFolder": ([act("moveNote", note="a.md", folder="nowhere")], {(0, "error")}),
    "unsafeTitle": ([act("retitleNote", note="a.md", title="a/b")], {(0, "error")}),
    "titleCollision": ([act("retitleNote", note="box/b.md", title="c")], {(0, "error")}),
    "emptyReference": ([act("tagNote", tags=["x"])], {(0, "error")}),
    "contradictoryReference": ([act("tagNote", note="a.md", id="2", tags=["x"])], {(0, "error")}),
    "unknownNote": ([act("tagNote", note="zzz.md", tags=["x"])], {(0, "error")}),
    "excludedSource": ([act("tagNote", note="secret/s.md", tags=["x"])], {(0, "error")}),
    "emptyContent": ([act("createNote", path="box/new.md", text=" "), act("appendToNote", note="a.md", text="")], {(0, "warning"), (1, "error")}),
    "contentNotFromSession": ([act("appendToNote", note="a.md", text="# Made up:")], {(0, "error")}),
    "invalidTag": ([act("tagNote", note="a.md", tags=["x", " "])], {(0, "error")}),
    "folderExists": ([act("createFolder", folder="box")], {(0, "warning")}),
    "noOp": ([act("moveNote", note="box/b.md", folder="box"), act("tagNote", note="a.md", tags=["t"])], {(0, "warning"), (1, "warning")}),
    "contradictoryAction": ([act("moveNote", note="a.md", folder="box"), act("moveNote", note="a.md", folder="")], {(1, "error")}),
    "emptySegment": ([act("moveSegment", note="a.md", segment="", to="box/b.md")], {(0, "error")}),
    "segmentHashMismatch": ([act("moveSegment", note="a.md", segment="keep this", segmentHash="00", to="box/b.md")], {(0, "error")}),
    "segmentUnverified": ([act("moveSegment", note="box/c.md", segment="x", to="box/b.md")], {(0, "warning")}),
    "segmentNotFound": ([act("moveSegment", note="a.md", segment="not there", to="box/b.md")], {(0, "error")}),
    "missingPrecondition": ([act("appendToNote", note="a.md", text="alpha body of some length it has")], {(0, "error")}),
    "stalePrecondition": ([act("appendToNote", note="a.md", text="alpha body of some length it has")], {(0, "error")}),
}


def test_every_kind_of_issue(spark):
    pre = {"missingPrecondition": {}, "stalePrecondition": {"a.md": "old"}}
    p = plans(spark, [(k, a, pre.get(k, OK)) for k, (a, _) in CASES.items()])
    session = p.select("plan_id", F.lit("alpha body of some length").alias("session_text"))
    found = {}
    for r in P.issues(P.decode(p), library(spark), p, ("secret",), session).collect():
        found.setdefault((r.plan_id, r.kind), set()).add((r.action_index, r.severity))
    assert len(CASES) == 26
    for kind, (_, want) in CASES.items():
        assert found.get((kind, kind)) == want, (kind, {k: v for k, v in found.items() if k[0] == kind})
    # a clean plan has no findings but its own kind
    assert {k for k in found if k[0] == "folderExists"} == {("folderExists", "folderExists")}


def test_collisions_follow_the_plan(spark):
    """A move makes room and takes a place."""
    p = plans(spark, [("1", [act("moveNote", note="box/b.md", folder=""), act("createNote", path="box/b.md", text="new"), act("createNote", path="b.md", text="new")], OK)])
    assert [(r.plan_id, r.action_index) for r in P.collisions(P.decode(p), library(spark)).collect()] == [("1", 2)]


def applied(spark, actions, pre=None):
    p = plans(spark, [("1", actions, pre or {})])
    return {(r.status, r.relpath): (r.before, r.after) for r in P.apply(P.decode(p), p, library(spark)).collect()}


def test_application(spark):
    got = applied(spark, [
        act("retitleNote", note="a.md", title="z"), act("moveNote", note="box/b.md", folder=""), act("appendToNote", note="a.md", text=" more "),
        act("moveSegment", note="a.md", segment="keep this", to="box/b.md"), act("createFolder", folder="new"), act("createNote", path="new/n.md", text="hello"), act("tagNote", note="a.md", tags=["x"])], OK)
    assert got[("applied", "a.md")] == ("alpha body\nkeep this", None)
    assert got[("applied", "z.md")] == (None, "alpha body\n\n---\n\nmore\n")
    assert got[("applied", "b.md")] == (None, "beta\n\n---\n\nkeep this\n") and got[("applied", "box/b.md")] == ("beta", None)
    assert got[("applied", "new/n.md")] == (None, "hello\n") and ("folder", "new") in got and got[("tagged", "a.md")][1] == "x"
    assert applied(spark, [act("appendToNote", note="a.md", text="x")], {"a.md": "old"}) == {("conflict", None): (None, None)}
    assert applied(spark, [act("explode")]) == {("invalid", None): (None, None)}
    many = [act("appendToNote", note="a.md", text="x")] * 5000
    assert applied(spark, many) == {("invalid", None): (None, None)}
    assert applied(spark, [act("moveSegment", note="box/b.md", segment="beta", to="a.md")])[("applied", "box/b.md")] == ("beta", None)
    # what validation refuses changes nothing
    assert applied(spark, [act("createNote", path="nowhere/n.md", text="x")]) == applied(spark, [act("retitleNote", note="a.md", title="a/b")]) == {("invalid", None): (None, None)}


REPAIRS = {
    # step 1
    "unused": ([act("createFolder", folder="empty"), act("appendToNote", note="a.md", text="x")], [("appendToNote", "a.md")], [(-1, "droppedUnusedFolder")]),
    "twice": ([act("createFolder", folder="new"), act("createFolder", folder="new/"), act("createNote", path="new/n.md", text="x")], [("createFolder", "new"), ("createNote", "new/n.md")], [(-1, "droppedUnusedFolder")]),
    "ancestor": ([act("createFolder", folder="new"), act("createFolder", folder="new/in"), act("createNote", path="new/in/n.md", text="x")], [("createFolder", "new"), ("createFolder", "new/in"), ("createNote", "new/in/n.md")], []),
    # step 2
    "deep": ([act("createNote", path="x/y/box/in/n.md", text="x"), act("createNote", folder="p/q/r", title="t", text="x")], [("createFolder", "box/in"), ("createFolder", "q/r"), ("createNote", "box/in/n.md"), ("createNote", "q/r")], [(0, "repairedFolderDepth"), (0, "repairedMissingFolder"), (1, "repairedFolderDepth"), (1, "repairedMissingFolder")]),
    "deep_odd": ([act("createNote", path="x/ y/box/in/n.md", text="x")], [("createNote", "x/ y/box/in/n.md")], []),
    "deep_excluded": ([act("moveNote", note="a.md", folder="x/y/secret/in")], [("moveNote", "x/y/secret/in")], []),
    # step 3
    "collision": ([act("createNote", path="box/b.md", text="more", tags=["t"]), act("tagNote", note="a.md", tags=["u"])], [("appendToNote", "box/b.md"), ("tagNote", "a.md"), ("tagNote", "box/b.md")], [(0, "repairedCollision")]),
    "collision_by_title": ([act("createNote", folder="box", title="b", text="more")], [("appendToNote", "box/b.md")], [(0, "repairedCollision")]),
    "collision_excluded": ([act("createNote", path="secret/s.md", text="more")], [("createNote", "secret/s.md")], []),
    "collision_segment": ([act("moveSegment", note="a.md", segment="keep this", path="box/b.md")], [("moveSegment", "box/b.md")], [(0, "repairedCollision")]),
    # steps see the last one's paths: clamped onto a note that is there, so added to it
    "deep_then_collision": ([act("createNote", path="w/x/deep/box/b.md", text="x"), act("createNote", path="x/y/z/box.md", text="x")], [("createFolder", "deep/box"), ("createFolder", "y/z"), ("createNote", "deep/box/b.md"), ("createNote", "y/z/box.md")], [(0, "repairedFolderDepth"), (0, "repairedMissingFolder"), (1, "repairedFolderDepth"), (1, "repairedMissingFolder")]),
    # step 4
    "merge": ([act("moveSegment", note="a.md", segment="not there", to="box/b.md")], [("appendToNote", "box/b.md")], [(0, "repairedMerge")]),
    "merge_new": ([act("moveSegment", note="a.md", segment="not there", path="new/n.md")], [("createFolder", "new"), ("createNote", "new/n.md")], [(0, "repairedMerge"), (0, "repairedMissingFolder")]),
    "merge_collision": ([act("moveSegment", note="a.md", segment="not there", path="box/b.md", tags=["t"])], [("appendToNote", "box/b.md"), ("tagNote", "box/b.md")], [(0, "repairedCollision"), (0, "repairedMerge")]),
    "merge_unknown": ([act("moveSegment", note="box/c.md", segment="not there", to="box/b.md")], [("moveSegment", "box/b.md")], []),
    # step 5
    "missing": ([act("appendToNote", note="a.md", text="x"), act("moveNote", note="a.md", folder="new"), act("createNote", path="new/n.md", text="x")], [("createFolder", "new"), ("appendToNote", "a.md"), ("moveNote", "new"), ("createNote", "new/n.md")], [(1, "repairedMissingFolder")]),
    "missing_excluded": ([act("createNote", path="secret/in/n.md", text="x")], [("createNote", "secret/in/n.md")], []),
    "nothing": ([act("appendToNote", note="a.md", text="x"), act("explode")], [("appendToNote", "a.md"), ("explode", None)], []),
}


def test_repairs(spark):
    """Each step and each kind of finding, steps in their order."""
    p = plans(spark, [(k, a, {}) for k, (a, _, _) in REPAIRS.items()] + [("many", [act("createNote", path=f"x/y/z/{k}.md", text="x") for k in range(5000)], {}), ("unreadable", "no json", {})])
    actions, findings = repair(P.decode(p), library(spark), ("secret",))
    got, found = {}, {}
    for r in actions.orderBy("plan_id", "action_index").collect():
        got.setdefault(r.plan_id, []).append((r.action, {"createFolder": r.folder, "createNote": r.path or r.folder, "moveNote": r.folder, "moveSegment": r.to or r.path}.get(r.action, r.note)))
    for r in findings.collect():
        found.setdefault(r.plan_id, []).append((r.action_index, r.kind))
        assert r.severity == "warning"
    for k, (_, want, kinds) in REPAIRS.items():
        assert got[k] == want and sorted(found.get(k, [])) == sorted(kinds), k
    assert len(got["many"]) == 5000 and got["unreadable"] == [(None, None)] and not {"many", "unreadable"} & set(found)
    assert {k for f in found.values() for _, k in f} == {"droppedUnusedFolder", "repairedFolderDepth", "repairedCollision", "repairedMerge", "repairedMissingFolder"}
    assert {r.plan_id: r.preconditions for r in preconditions(actions, library(spark)).where("plan_id in ('collision', 'merge', 'deep')").collect()} == {"collision": {"box/b.md": OK["box/b.md"], "a.md": OK["a.md"]}, "merge": {"box/b.md": OK["box/b.md"]}, "deep": {}}


def test_repair_removes_errors_only(spark):
    """Random plans: repair never leaves an error of a kind that it mends, nor adds one of another kind, and nothing is lost."""
    rng = random.Random(11)
    paths = ["a.md", "box/b.md", "new/n.md", "p/q/r/deep.md", "secret/s.md", "secret/x.md", "box/in/k.md"]
    one = lambda: rng.choice([
        lambda: act("createNote", path=rng.choice(paths), text=f"text {rng.random()}", tags=rng.choice([[], ["t"]])), lambda: act("createFolder", folder=rng.choice(["new", "p/q/r", "box", "q/r"])),
        lambda: act("appendToNote", note=rng.choice(["a.md", "box/b.md"]), text=f"text {rng.random()}"), lambda: act("moveSegment", note="a.md", segment=rng.choice(["keep this", "gone"]), **rng.choice([{"to": "box/b.md"}, {"path": rng.choice(paths)}])),
        lambda: act("moveNote", note="box/b.md", folder=rng.choice(["", "new", "x/y/z"]))])()
    p = plans(spark, [(str(k), [one() for _ in range(rng.randrange(1, 9))], {}) for k in range(60)])
    before = P.decode(p)
    after, findings = repair(before, library(spark), ("secret",))
    errors = lambda a: {(r.plan_id, r.kind) for r in P.issues(a, library(spark), None, ("secret",)).where("severity = 'error'").collect()}
    was, now = errors(before), errors(after)
    assert len(was) > len(now) and {k for _, k in now - was} <= {"emptyReference", "duplicateAction", "titleCollision", "contradictoryAction"}
    again, rest = repair(after, library(spark), ("secret",))
    assert rest.count() == 0
    texts = lambda a: sorted((r.plan_id, t) for r in a.collect() for t in (r.text, r.segment) if t)
    assert texts(after) == texts(before) and findings.count() > 20


def test_recovery(spark):
    images = [("done", "a.md", "x", "alpha"), ("back", "b.md", "old", "new"), ("back", "n.md", None, "made"), ("back", "k.md", "same", "other"), ("lost", "c.md", "1", "2")]
    disk = [("a.md", "alpha"), ("b.md", "new"), ("n.md", "made"), ("k.md", "same"), ("c.md", "3")]
    got = P.recovered(spark.createDataFrame(images, "event_id string, relpath string, before string, after string"), spark.createDataFrame(disk, "relpath string, body string"))
    assert {(r.event_id, r.relpath): (r.outcome, r.text) for r in got.collect()} == {
        ("done", "a.md"): ("done", None), ("back", "b.md"): ("rewritten", "old"), ("back", "n.md"): ("trashed", None), ("back", "k.md"): ("kept", None), ("lost", "c.md"): ("failed", None)}


def test_organised_plans(spark):
    p = plans(spark, [("good", [act("createNote", path="box/n.md", text="some text that is long")], {}), ("bad", [act("tagNote", tags=["x"])], {})])
    found, out = organise.organised(p, library(spark))
    assert {(r.plan_id, r.status, r.relpath) for r in out.collect()} == {("good", "applied", "box/n.md"), ("bad", "rejected", None)}
    assert {r.plan_id for r in found.where("severity = 'error'").collect()} == {"bad"}


def test_queue(spark):
    from datetime import datetime

    t = [datetime(2024, 1, d) for d in range(1, 6)]
    pending = spark.createDataFrame([(1, t[0], [10, 11]), (2, t[1], [11, 12]), (3, t[2], [13]), (4, t[3], [99])], "session_id long, ended_at timestamp, note_ids array<long>")
    running = spark.createDataFrame([(9, [99])], "session_id long, note_ids array<long>")
    assert [r[0] for r in organise.next_in_queue(pending, running, 3).collect()] == [1, 3]
    edits = spark.createDataFrame([(12, t[4]), (13, t[0])], "note_id long, ts timestamp")
    assert {r.session_id: (r.status, r.dirty) for r in organise.superseded(pending, edits).collect()} == {1: ("due", None), 2: ("superseded", [12]), 3: ("due", None), 4: ("due", None)}
