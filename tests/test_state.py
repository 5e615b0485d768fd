"""Sources, stores and streams."""

from pyspark.sql import functions as F

from quernstone.sources import markdown
from quernstone.streaming import sessions as S

LOG = [
    ("u", "a", "edit", 0), ("u", "b", "edit", 100), ("u", None, "scroll", 150), ("u", "a", "edit", 700), ("u", None, "resign", 710), ("u", "c", "edit", 735), ("u", None, "terminate", 800),
    ("v", None, "scroll", 5), ("v", "a", "edit", 10), ("v", None, "close", 20), ("v", "b", "edit", 60), ("w", "z", "edit", 5000),
]
WANT = {("u", 0, 330, "idle", ("a", "b")), ("u", 700, 800, "terminated", ("a", "c")), ("v", 10, 50, "left", ("a",)), ("v", 60, 240, "idle", ("b",)), ("w", 5000, 5180, "idle", ("z",))}


def log(spark):
    return spark.createDataFrame(LOG, "user string, note_id string, kind string, s long").select("user", "note_id", "kind", F.timestamp_seconds(F.col("s") + 1000).alias("ts"))


def rows(df):
    return {(r.user, r.a, r.b, r.reason, tuple(r.note_ids)) for r in df.selectExpr("user", "unix_seconds(started_at) - 1000 a", "unix_seconds(ended_at) - 1000 b", "reason", "note_ids").collect()}


def test_sessions(spark):
    assert rows(S.sessions(log(spark))) == WANT


def test_stream_is_batch(spark, tmp_path):
    log(spark).unionByName(spark.createDataFrame([("end", "n", "edit", 100_000)], "user string, note_id string, kind string, s long").select("user", "note_id", "kind", F.timestamp_seconds(F.col("s") + 1000).alias("ts"))).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = S.session_stream(spark.readStream.schema(log(spark).schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == WANT


def test_markdown_folder(spark, tmp_path):
    root = tmp_path / "notes"
    (root / "sub" / "_assets").mkdir(parents=True)
    (root / "a.md").write_text("---\nid: fixed\ntags: [x]\n---\n# A\n")
    (root / "sub" / "b.md").write_text("plain")
    (root / "sub" / "_assets" / "c.md").write_text("no")
    (root / "d.txt").write_text("no")
    found = {r.relpath: r for r in markdown.notes(spark, str(root)).collect()}
    assert set(found) == {"a.md", "sub/b.md"}
    assert found["a.md"].id == "fixed" and found["a.md"].body == "# A\n" and found["sub/b.md"].folder_path == "sub"
    before = spark.createDataFrame(markdown.listing(spark, str(root)).drop("content").collect())
    (root / "a.md").write_text("changed, and longer")
    assert [r.relpath for r in markdown.changed(spark, str(root), before).collect()] == ["a.md"]


def test_outcomes(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"at":"2024-01-02T00:00:00Z","query":"b","found":true,"seconds":1.0}\nnot json\n{"at":"2024-01-01T00:00:00Z","query":"a","found":false,"seconds":2.0}\n')
    assert [r.query for r in markdown.outcomes(spark, f"{tmp_path}/log.jsonl").collect()] == ["a", "b"]


def test_reconcile_stream(spark, tmp_path):
    known = [("a.md", "1", "x"), ("b.md", "2", "y")]
    spark.createDataFrame(known, "relpath string, id string, content_hash string").write.parquet(f"{tmp_path}/known")
    spark.createDataFrame([("a.md", "1", "z"), ("c.md", "2", "y")], "relpath string, id string, content_hash string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("relpath string, id string, content_hash string").parquet(f"{tmp_path}/in")
    S.reconcile_stream(spark, stream, f"{tmp_path}/known", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert {(r.change, r.relpath, r.from_path) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("modified", "a.md", None), ("moved", "c.md", "b.md")}
