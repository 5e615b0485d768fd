"""Autosave: each rule by exact rows, and the stream against the batch on a shuffled log."""

import random

from pyspark.sql import functions as F

from quernstone.streaming import autosave as A

SCHEMA = "note_id string, ms long, seq long, kind string, relpath string, text string, trigger string, revision long"


def log(spark, rows):
    """rows: note, milliseconds, kind, and what else there is."""
    full = [(n, ms, k, kind, more.get("relpath", "a.md"), more.get("text", f"t{k}"), more.get("trigger"), more.get("revision")) for k, (n, ms, kind, more) in enumerate(rows, 1)]
    return spark.createDataFrame(full, SCHEMA).withColumn("ts", F.timestamp_millis(F.col("ms") + 1_000_000)).drop("ms")


def jobs(df):
    return sorted((r.note_id, r.ms, r.relpath, r.text, r.trigger, r.conflict, r.revision) for r in df.withColumn("ms", F.unix_millis("at") - 1_000_000).collect())


CASES = {
    "burst": ([("change", 0, {}), ("change", 500, {}), ("change", 1000, {})], [(1750, "a.md", "t3", "debounce", False, 3)]),
    "two bursts": ([("change", 0, {}), ("change", 751, {})], [(750, "a.md", "t1", "debounce", False, 1), (1501, "a.md", "t2", "debounce", False, 2)]),
    "at the deadline": ([("change", 0, {}), ("change", 750, {})], [(750, "a.md", "t1", "debounce", False, 1), (1500, "a.md", "t2", "debounce", False, 2)]),
    "saved": ([("change", 0, {}), ("saved", 800, {"revision": 1}), ("flush", 900, {"trigger": "terminate"})], [(750, "a.md", "t1", "debounce", False, 1)]),
    "typed meanwhile": ([("change", 0, {}), ("change", 760, {}), ("external", 765, {}), ("saved", 770, {"revision": 1})], [(750, "a.md", "t1", "debounce", False, 1), (1510, "a.md", "t2", "debounce", False, 2)]),
    "failed": ([("change", 0, {}), ("failed", 900, {"revision": 1}), ("saved", 2000, {"revision": 1})], [(750, "a.md", "t1", "debounce", False, 1), (1650, "a.md", "t1", "debounce", False, 1)]),
    "flush": ([("change", 0, {}), ("flush", 100, {"trigger": "noteSwitch"}), ("flush", 200, {"trigger": "terminate"})], [(100, "a.md", "t1", "noteSwitch", False, 1)]),
    "conflict": ([("change", 0, {}), ("external", 10, {})], [(750, "a.md", "t1", "debounce", True, 1)]),
    "clean external": ([("external", 0, {}), ("change", 10, {})], [(760, "a.md", "t2", "debounce", False, 2)]),
    "moved": ([("change", 0, {}), ("moved", 10, {"relpath": "b.md"})], [(750, "b.md", "t1", "debounce", False, 1)]),
    "dropped": ([("change", 0, {}), ("drop", 10, {})], []),
    "nothing": ([("flush", 0, {"trigger": "resign"}), ("moved", 1, {}), ("saved", 2, {"revision": 9})], []),
}


def test_rules(spark):
    for name, (events, want) in CASES.items():
        assert jobs(A.writes(log(spark, [("n", ms, kind, more) for kind, ms, more in events]))) == sorted(("n", *w) for w in want), name
    assert A.writes(log(spark, [("n", 0, "drop", {})]).limit(0)).count() == 0


def test_stream_is_batch(spark, tmp_path):
    """A log of many notes, its rows shuffled over files within the delay."""
    rng = random.Random(5)
    rows, at = [], 0
    for _ in range(400):
        at += rng.choice([0, 40, 200, 700, 751])
        n = f"n{rng.randrange(6)}"
        kind = rng.choice(["change"] * 5 + ["flush", "external", "moved", "drop", "saved", "failed"])
        rows.append((n, at, kind, {"relpath": f"{n}.md", "trigger": "resign", "revision": rng.randrange(1, 400)}))
    events = log(spark, rows)
    want = jobs(A.writes(events))
    moved = sorted(events.collect(), key=lambda r: r.ts.timestamp() + rng.uniform(0, 9))
    far = log(spark, [("end", at + 10**6, "drop", {})]).collect()
    for k in range(0, len(moved), 40):
        spark.createDataFrame(moved[k : k + 40], events.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k:05d}")
    spark.createDataFrame(far, events.schema).coalesce(1).write.parquet(f"{tmp_path}/in/99999")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = A.write_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(240)
    finally:
        spark.conf.set(name, before)
    assert jobs(spark.read.parquet(f"{tmp_path}/out")) == want and len(want) > 100
