"""A watched folder: add, modify, move, remove arrive once each, by events, after an overflow, and when a batch is done again."""

import json

from pyspark.sql import functions as F

from quernstone.sources import markdown
from quernstone.streaming.watch import Watch, events


def rows(df):
    return sorted((r.change, r.relpath, r.from_path) for r in df.collect())


def named(spark, *paths, overflow=False):
    return spark.createDataFrame([(p, False) for p in paths] + ([(None, True)] if overflow else []), "path string, overflow boolean")


def put(root, path, text):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(text)


def right(spark, watch, root):
    """What is known is what is there."""
    disk = {(r.relpath, r.content_hash) for r in markdown.notes(spark, str(root)).collect()}
    known = watch.known().collect()
    assert {(r.relpath, r.content_hash) for r in known} == disk and len({r.id for r in known}) == len(known)
    assert {(r.id, r.relpath) for r in watch.by_id.rows().collect()} == {(r.id, r.relpath) for r in known}


def test_each_change_is_told_once(spark, tmp_path):
    root = tmp_path / "notes"
    put(root, "a.md", "---\nid: ida\n---\none")
    put(root, "box/b.md", "two")
    put(root, "box/c [1].md", "three")
    watch = Watch(spark, str(root), f"file://{tmp_path}/state")
    assert rows(watch.batch(named(spark, overflow=True), 0)) == [("added", "a.md", None), ("added", "box/b.md", None), ("added", "box/c [1].md", None), ("folderAdded", "box", None)]
    right(spark, watch, root)
    # nothing happened, whatever is named
    assert rows(watch.batch(named(spark, "a.md", "box/b.md", "never.md"), 1)) == []
    # add, modify, move by id and by content, remove, in a batch of events
    put(root, "new/d.md", "four")
    put(root, "box/c [1].md", "three more")
    (root / "far").mkdir()
    (root / "a.md").rename(root / "far/a2.md")
    batch = named(spark, "new/d.md", "box/c [1].md", "far/a2.md", "a.md", "new/d.md")
    want = [("added", "new/d.md", None), ("folderAdded", "far", None), ("folderAdded", "new", None), ("modified", "box/c [1].md", None), ("moved", "far/a2.md", "a.md")]
    assert rows(watch.batch(batch, 2)) == want
    assert {r.relpath: r.id for r in watch.known().collect()}["far/a2.md"] == "ida"
    right(spark, watch, root)
    # the same batch again, after it was applied
    assert rows(watch.batch(batch, 2)) == want
    right(spark, watch, root)
    # only the new place of a moved note is named: its id says where it was; a copy is a note of its own
    (root / "far/a2.md").rename(root / "a3.md")
    put(root, "copy.md", (root / "a3.md").read_text())
    (root / "box/b.md").unlink()
    assert rows(watch.batch(named(spark, "a3.md", "box/b.md"), 3)) == [("moved", "a3.md", "far/a2.md"), ("removed", "box/b.md", None)]
    assert rows(watch.batch(named(spark, "copy.md"), 4)) == [("added", "copy.md", None)]
    right(spark, watch, root)
    # a folder's event, and an overflow, look at all
    put(root, "deep/er/e.md", "five")
    (root / "new/d.md").rename(root / "box/d.md")
    assert rows(watch.batch(named(spark, "deep"), 5)) == [("added", "deep/er/e.md", None), ("folderAdded", "deep", None), ("folderAdded", "deep/er", None), ("folderRemoved", "new", None), ("moved", "box/d.md", "new/d.md")]
    (root / "deep/er/e.md").unlink()
    assert rows(watch.batch(named(spark, overflow=True), 6)) == [("folderRemoved", "deep", None), ("folderRemoved", "deep/er", None), ("removed", "deep/er/e.md", None)]
    right(spark, watch, root)
    # more paths than are looked at one by one
    watch.most = 1
    put(root, "x.md", "x")
    assert rows(watch.batch(named(spark, "a3.md", "copy.md"), 7)) == [("added", "x.md", None)]
    assert watch.changes().where("change = 'added'").groupBy("relpath").agg(F.count("*").alias("n")).where("n > 1").count() == 0


def test_stream(spark, tmp_path):
    root = tmp_path / "notes"
    put(root, "a.md", "one")
    watch = Watch(spark, str(root), f"file://{tmp_path}/state")
    (tmp_path / "log").mkdir()

    def say(k, *lines):
        (tmp_path / "log" / f"{k}.json").write_text("\n".join(json.dumps(x) for x in lines))
        watch.start(events(spark, f"{tmp_path}/log"), f"{tmp_path}/check").awaitTermination(120)

    say(0, {"path": None, "overflow": True})
    put(root, "b.md", "two")
    (root / "a.md").unlink()
    say(1, {"path": "b.md", "overflow": False}, {"path": "a.md", "overflow": False})
    assert [(r.batch, r.change, r.relpath) for r in watch.changes().orderBy("batch", "change").collect()] == [(0, "added", "a.md"), (1, "added", "b.md"), (1, "removed", "a.md")]
    right(spark, watch, root)
