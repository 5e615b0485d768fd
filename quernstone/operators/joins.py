"""Joins between stored and derived state: staleness, existence, reconciliation, moves, multiset matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..corpus import NOTES_SQL, notes
from ..derived import numbered
from ..registry import query
from ..session import table


def stale(notes_: DataFrame, indexed: DataFrame) -> DataFrame:
    """Notes without an index row, or whose index row has another hash."""
    i = indexed.select("id", F.col("content_hash").alias("indexed_hash"))
    return notes_.join(i, "id", "left").where("indexed_hash is null or indexed_hash <> content_hash").drop("indexed_hash")


def reconcile(disk: DataFrame, known: DataFrame) -> DataFrame:
    """Changes by path between two listings (relpath, id, content_hash): added, removed, modified, moved.

    An added file whose id a removed row has is that row, moved; else removed and added rows of one hash
    pair off in path order, each once. Where the old path still exists, the file is a copy and so added.
    """
    d = disk.select("relpath", F.col("id").alias("new_id"), F.col("content_hash").alias("new_hash"))
    k = known.select("relpath", F.col("id").alias("old_id"), F.col("content_hash").alias("old_hash"))
    both = d.join(k, "relpath", "full_outer").withColumn(
        "change", F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "modified")
    ).where("change is not null")
    added, removed = both.where("change = 'added'"), both.where("change = 'removed'")
    by_id = added.select("relpath", F.col("new_id").alias("id")).join(removed.select(F.col("relpath").alias("from_path"), F.col("old_id").alias("id")), "id").select("relpath", "from_path")
    # any number of files may have one hash, as empty ones do
    a = numbered(added.join(by_id, "relpath", "left_anti").select("relpath", F.col("new_hash").alias("hash")), ["hash"], ["relpath"], "n")
    r = removed.join(by_id.select(F.col("from_path").alias("relpath")), "relpath", "left_anti").select(F.col("relpath").alias("from_path"), F.col("old_hash").alias("hash"))
    r = numbered(r, ["hash"], ["from_path"], "n")
    moves = by_id.union(a.join(r, ["hash", "n"]).select("relpath", "from_path"))
    gone = moves.select(F.col("from_path").alias("relpath"))
    rest = both.select("change", "relpath").join(moves.select("relpath").union(gone), "relpath", "left_anti").select("change", "relpath", F.lit(None).cast("string").alias("from_path"))
    return rest.union(moves.select(F.lit("moved").alias("change"), "relpath", "from_path"))


def multiset_match(fresh: DataFrame, existing: DataFrame, keys: list[str], fresh_order: str, existing_order: str) -> DataFrame:
    """Pairs equal rows off, each existing row at most once, in order."""
    f = fresh.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(fresh_order)))
    e = existing.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(existing_order)))
    return f.join(e, [*keys, "n"], "left").drop("n")


INDEXED_SQL = "indexed AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'old' ELSE content_hash END AS content_hash FROM notes WHERE id % 5 <> 0)"


def indexed(spark, sf_dir):
    """A made-up earlier index: a fifth of the notes missing, a seventh out of date."""
    return notes(spark, sf_dir).where("id % 5 <> 0").select("id", F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"))


@query("c1_chunks_under_folder", "SELECT l.quality, count(*) AS n FROM documents d JOIN labels l USING (doc_id) WHERE d.source = 'src1' GROUP BY 1")
def chunks_under_folder(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source = 'src1'").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality").agg(F.count("*").alias("n"))


@query("c2_vectors_of_model", "SELECT v.vec_id, d.lang, v.label FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id WHERE len(v.embedding) = 64")
def vectors_of_model(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").where("size(embedding) = 64").select("vec_id", "label")
    return v.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), F.col("vec_id") == F.col("doc_id")).select("vec_id", "lang", "label")


@query("c5_first_later", "SELECT user_id, event_id, later FROM (SELECT user_id, event_id, event_type, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM events) WHERE event_type = 'error'")
def first_later(spark, sf_dir):
    """For each error, the user's first purchase after it: on its day, else the first of the next day that has one. A task
    holds a day of a user, and then a row for each day."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", F.to_date("ts").alias("day"))
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    w = Window.partitionBy("user_id", "day").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    here = e.withColumn("same_day", F.last(bought, ignorenulls=True).over(w)).where("event_type = 'error'")
    days = e.groupBy("user_id", "day").agg(F.min(F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id")))["event_id"].alias("first"))
    after = Window.partitionBy("user_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("next", F.last("first", ignorenulls=True).over(after)).select("user_id", "day", "next")
    return here.join(days, ["user_id", "day"]).select("user_id", "event_id", F.coalesce("same_day", "next").alias("later"))


@query("c6_stale_text", f"WITH {NOTES_SQL}, {INDEXED_SQL} SELECT n.id, n.mtime FROM notes n LEFT JOIN indexed i USING (id) WHERE i.content_hash IS NULL OR i.content_hash <> n.content_hash ORDER BY n.mtime DESC, n.id")
def stale_text(spark, sf_dir):
    return stale(notes(spark, sf_dir).select("id", "mtime", "content_hash"), indexed(spark, sf_dir)).select("id", "mtime").orderBy(F.desc("mtime"), "id")


@query("c8_not_exists_two_keys", f"WITH {NOTES_SQL}, {INDEXED_SQL} SELECT n.id FROM notes n WHERE NOT EXISTS (SELECT 1 FROM indexed i WHERE i.id = n.id AND i.content_hash = n.content_hash)")
def not_exists_two_keys(spark, sf_dir):
    return notes(spark, sf_dir).select("id", "content_hash").join(indexed(spark, sf_dir), ["id", "content_hash"], "left_anti").select("id")


@query("c9_without_vector", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings v WHERE v.vec_id = d.doc_id)")
def without_vector(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left_anti")


@query("c10_has_vector", "SELECT doc_id, doc_id IN (SELECT vec_id FROM embeddings) AS has_vector FROM documents")
def has_vector(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("held")).distinct()
    return table(spark, sf_dir, "documents").select("doc_id").join(v, "doc_id", "left").select("doc_id", F.col("held").isNotNull().alias("has_vector"))


@query("c11_in_and_not_in", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase')")
def in_and_not_in(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return e.join(e.where("event_type = 'signup'").select("user_id"), "user_id", "left_semi").join(e.where("event_type = 'purchase'").select("event_id"), "event_id", "left_anti").select("event_id")


@query("c12_counts_of_children", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders")
def counts_of_children(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))


KNOWN_SQL = """known AS (SELECT CASE WHEN id % 6 = 0 THEN 'old/' || relpath ELSE relpath END AS relpath, CASE WHEN id % 12 = 0 THEN -id - 1 ELSE id END AS id,
  CASE WHEN id % 11 = 0 THEN 'old' ELSE content_hash END AS content_hash FROM notes WHERE id % 10 <> 3)"""


def known_listing(spark, sf_dir):
    """A made-up earlier listing: some files elsewhere, with and without their ids, some changed, some missing."""
    return notes(spark, sf_dir).where("id % 10 <> 3").selectExpr(
        "case when id % 6 = 0 then 'old/' || relpath else relpath end as relpath", "case when id % 12 = 0 then -id - 1 else id end as id", "case when id % 11 = 0 then 'old' else content_hash end as content_hash"
    )


@query("c14_c15_reconcile", f"""WITH {NOTES_SQL}, {KNOWN_SQL}, b AS (SELECT coalesce(n.relpath, k.relpath) AS relpath, n.id AS new_id, k.id AS old_id, n.content_hash AS nh, k.content_hash AS kh FROM notes n FULL JOIN known k ON n.relpath = k.relpath),
  a AS (SELECT * FROM b WHERE kh IS NULL), r AS (SELECT * FROM b WHERE nh IS NULL),
  by_id AS (SELECT a.relpath, r.relpath AS from_path FROM a JOIN r ON a.new_id = r.old_id),
  a2 AS (SELECT relpath, nh, row_number() OVER (PARTITION BY nh ORDER BY relpath) AS n FROM a WHERE relpath NOT IN (SELECT relpath FROM by_id)),
  r2 AS (SELECT relpath, kh, row_number() OVER (PARTITION BY kh ORDER BY relpath) AS n FROM r WHERE relpath NOT IN (SELECT from_path FROM by_id)),
  m AS (SELECT * FROM by_id UNION ALL SELECT a2.relpath, r2.relpath FROM a2 JOIN r2 ON a2.nh = r2.kh AND a2.n = r2.n)
  SELECT 'moved' AS change, relpath, from_path FROM m UNION ALL
  SELECT CASE WHEN kh IS NULL THEN 'added' WHEN nh IS NULL THEN 'removed' ELSE 'modified' END, relpath, NULL FROM b
  WHERE nh IS DISTINCT FROM kh AND relpath NOT IN (SELECT relpath FROM m) AND relpath NOT IN (SELECT from_path FROM m)""")
def reconciled(spark, sf_dir):
    return reconcile(notes(spark, sf_dir), known_listing(spark, sf_dir))


@query("c16_reuse_chunks", """WITH f AS (SELECT conv_id, turn, sha256(text) AS h, row_number() OVER (PARTITION BY conv_id, sha256(text) ORDER BY turn) AS n FROM conversations),
  e AS (SELECT conv_id, turn AS old_turn, sha256(text) AS h, row_number() OVER (PARTITION BY conv_id, sha256(text) ORDER BY turn) AS n FROM conversations WHERE turn % 3 <> 1)
  SELECT f.conv_id, f.turn, e.old_turn FROM f LEFT JOIN e USING (conv_id, h, n)""")
def reuse_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("h"))
    old = c.where("turn % 3 <> 1").withColumnRenamed("turn", "old_turn")
    return multiset_match(c, old, ["conv_id", "h"], "turn", "old_turn").select("conv_id", "turn", "old_turn")


@query("c22_plan_references", f"WITH {NOTES_SQL}, refs AS (SELECT event_id, user_id AS ref_id, CASE WHEN event_id % 2 = 0 THEN 'src1/en/000000000001.md' END AS ref_path FROM events WHERE event_type = 'signup') SELECT r.event_id, coalesce(a.id, b.id) AS note_id, coalesce(a.id <> b.id, false) AS contradicts FROM refs r LEFT JOIN notes a ON a.id = r.ref_id LEFT JOIN notes b ON b.relpath = r.ref_path")
def plan_references(spark, sf_dir):
    """References resolved by id first, by path second; both, and different, is a contradiction."""
    refs = table(spark, sf_dir, "events").where("event_type = 'signup'").selectExpr("event_id", "user_id as ref_id", "case when event_id % 2 = 0 then 'src1/en/000000000001.md' end as ref_path")
    n = notes(spark, sf_dir)
    a, b = n.select(F.col("id").alias("a")), n.select(F.col("id").alias("b"), "relpath")
    return refs.join(a, F.col("ref_id") == F.col("a"), "left").join(b, F.col("ref_path") == F.col("relpath"), "left").select("event_id", F.coalesce("a", "b").alias("note_id"), F.coalesce(F.col("a") != F.col("b"), F.lit(False)).alias("contradicts"))


@query("c23_cascade", "SELECT l.l_orderkey, l.l_linenumber FROM lineitem l WHERE l.l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0)")
def cascade(spark, sf_dir):
    """Children whose parents survive."""
    kept = table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(kept, "l_orderkey", "left_semi")
