"""Incremental maintenance of derived tables: upserts, retention, event journal, model switches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..corpus import NOTES_SQL, notes
from ..registry import query
from ..session import table
from .aggregates import LEDGER_SQL, ledger


def upsert(old: DataFrame, new: DataFrame, key: str, unique: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """new replaces old by key; an old row under another key that holds a new row's ``unique`` value goes;
    columns in ``keep`` stay as they were where new has null."""
    was = old.select(key, *(F.col(c).alias(f"_old_{c}") for c in keep))
    fresh = new.join(was, key, "left").select(*(F.coalesce(c, f"_old_{c}").alias(c) if c in keep else F.col(c) for c in old.columns))
    rest = old.join(new.select(key), key, "left_anti")
    if unique:
        rest = rest.join(new.select(unique), unique, "left_anti").select(*old.columns)
    return rest.select(*old.columns).unionByName(fresh)


@query("k1_upsert", f"WITH {NOTES_SQL}, old AS (SELECT id, relpath, title, CASE WHEN id % 2 = 0 THEN mtime END AS last_opened FROM notes WHERE id % 4 <> 0), new AS (SELECT id, CASE WHEN id % 3 = 0 THEN relpath ELSE 'new/' || relpath END AS relpath, reverse(title) AS title, NULL AS last_opened FROM notes WHERE id % 5 = 0) SELECT id, relpath, title, last_opened FROM old WHERE id NOT IN (SELECT id FROM new) AND relpath NOT IN (SELECT relpath FROM new) UNION ALL SELECT n.id, n.relpath, n.title, o.last_opened FROM new n LEFT JOIN old o USING (id)")
def upserted(spark, sf_dir):
    n = notes(spark, sf_dir)
    old = n.where("id % 4 <> 0").selectExpr("id", "relpath", "title", "case when id % 2 = 0 then mtime end as last_opened")
    new = n.where("id % 5 = 0").selectExpr("id", "case when id % 3 = 0 then relpath else 'new/' || relpath end as relpath", "reverse(title) as title", "cast(null as timestamp_ntz) as last_opened")
    return upsert(old, new, "id", "relpath", ("last_opened",))


@query("k6_incremental_index", f"WITH {NOTES_SQL}, f AS (SELECT id, sha256(substr(body, 1 + 500 * i, 500)) AS h, i FROM (SELECT id, body, unnest(range(0, CAST(ceil(len(body) / 500.0) AS BIGINT))) AS i FROM notes)), e AS (SELECT id, h, i FROM f WHERE id % 3 <> 0 AND i % 4 <> 1), fn AS (SELECT *, row_number() OVER (PARTITION BY id, h ORDER BY i) AS n FROM f), en AS (SELECT *, row_number() OVER (PARTITION BY id, h ORDER BY i) AS n FROM e) SELECT fn.id, count(*) AS chunks, count(en.id) AS reused, count(*) - count(en.id) AS novel FROM fn LEFT JOIN en ON fn.id = en.id AND fn.h = en.h AND fn.n = en.n GROUP BY 1")
def incremental_index(spark, sf_dir):
    """Chunks of 500 characters against a made-up earlier index: what is reused by hash and what is new."""
    from .joins import multiset_match

    n = notes(spark, sf_dir).select("id", "body", F.explode(F.expr("sequence(0, int(ceil(length(body) / 500.0)) - 1)")).alias("i")).where("i >= 0")
    f = n.select("id", F.sha2(F.expr("substring(body, 1 + 500 * i, 500)"), 256).alias("h"), "i")
    old = f.where("id % 3 <> 0 and i % 4 <> 1").withColumnRenamed("i", "old")
    m = multiset_match(f, old, ["id", "h"], "i", "old")
    return m.groupBy("id").agg(F.count("*").alias("chunks"), F.count("old").alias("reused"), (F.count("*") - F.count("old")).alias("novel"))


@query("k7_model_switch", "SELECT vec_id, label = 0 AS dirty FROM embeddings")
def model_switch(spark, sf_dir):
    """After a change of model, every vector of another model is to be made anew; chunks stay."""
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") == 0).alias("dirty"))


@query("k10_retention", """WITH e AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN NULL ELSE props END AS session_text FROM events),
  keep AS (SELECT event_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 10)
  SELECT event_id, session_text, ts < TIMESTAMP '2024-01-20' AND event_type NOT IN ('error', 'signup') AND event_id NOT IN (SELECT event_id FROM keep) AS images_dropped FROM e""")
def retention(spark, sf_dir):
    """Old session texts go; so do images of old events that are not in progress nor among the newest ten
    that can be undone."""
    e = table(spark, sf_dir, "events")
    keep = e.where("event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", F.lit(True).alias("kept"))
    old = F.expr("ts < timestamp_ntz'2024-01-20'")
    return e.join(F.broadcast(keep), "event_id", "left").select("event_id", F.when(~old, F.col("props")).alias("session_text"), (old & ~F.col("event_type").isin("error", "signup") & F.col("kept").isNull()).alias("images_dropped"))


@query("k11_latest_state", "SELECT user_id, max_by(event_type, (ts, event_id)) AS status, count(*) AS changes FROM events GROUP BY 1")
def latest_state(spark, sf_dir):
    """The journal only grows; a subject's state is its last event."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("changes"))


@query("j13_provider_health", "SELECT user_id, CASE WHEN last = 'error' THEN 'failing' ELSE 'connected' END AS health, fails FROM (SELECT user_id, max_by(event_type, (ts, event_id)) AS last, count(*) FILTER (event_type = 'error' AND (ts, event_id) > coalesce(ok, (TIMESTAMP '1970-01-01', 0))) AS fails FROM (SELECT *, max(CASE WHEN event_type <> 'error' THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS ok FROM events) GROUP BY 1)")
def provider_health(spark, sf_dir):
    """Last event wins; failures since the last success are counted."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    g = e.groupBy("user_id").agg(F.max_by("event_type", "at").alias("last"), F.max(F.when(F.col("event_type") != "error", F.col("at"))).alias("ok"))
    since = e.where("event_type = 'error'").join(g.select("user_id", "ok"), "user_id").where("ok is null or at > ok").groupBy("user_id").agg(F.count("*").alias("fails"))
    g = g.join(since, "user_id", "left").fillna(0, ["fails"])
    return g.select("user_id", F.when(F.col("last") == "error", "failing").otherwise("connected").alias("health"), "fails")


@query("k16_pruned_ledger", f"WITH {LEDGER_SQL} SELECT event_id, purpose FROM ledger WHERE ts >= TIMESTAMP '2024-01-15'")
def pruned_ledger(spark, sf_dir):
    return ledger(spark, sf_dir).where("ts >= timestamp_ntz'2024-01-15'").select("event_id", "purpose")


def retry_delay(attempt: Column, told: Column, random: Column, base: float = 1.0, factor: float = 2.0, most: float = 60.0, jitter: float = 0.25) -> Column:
    """Seconds before an attempt is made again: what the server told, between 0 and ``most``, as it stands; else base times
    factor to the power of the attempts before, ``most`` at most, of which the share ``jitter`` is drawn by ``random`` (0
    to 1). An attempt below one counts as the first."""
    grown = F.least(base * F.pow(F.lit(factor), F.greatest(attempt - 1, F.lit(0))), F.lit(most))
    return F.when(told.isNotNull() & ~F.isnan(told), F.least(F.greatest(told, F.lit(0.0)), F.lit(most))).otherwise(grown * (1 - jitter) + grown * jitter * random)


@query("h26_retry_delays", "SELECT event_id, CASE WHEN event_type = 'error' THEN least(greatest(value, 0), 60.0) ELSE least(power(2.0, greatest(k - 1, 0)), 60.0) * 0.75 + least(power(2.0, greatest(k - 1, 0)), 60.0) * 0.25 * ((event_id % 101) / 100.0) END AS delay FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def retry_delays(spark, sf_dir):
    """Errors bear what the server told; the others wait longer each time, a quarter of it by a draw."""
    e = table(spark, sf_dir, "events")
    told = F.when(F.col("event_type") == "error", F.col("value"))
    return e.select("event_id", retry_delay(F.get_json_object("props", "$.k").cast("long"), told, (F.col("event_id") % 101) / 100.0).alias("delay"))


@query("j8_h26_retry_queue", "SELECT event_id, k AS attempts, least(60.0 * power(2, greatest(k - 1, 0)), 3600.0) AS delay, ts + to_microseconds(CAST(1000000 * least(60.0 * power(2, greatest(k - 1, 0)), 3600.0) AS BIGINT)) AS next_attempt_at FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type = 'error' AND k < 8")
def retry_queue(spark, sf_dir):
    """Doubling delays from a minute to an hour; after eight attempts a row leaves the queue."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("attempts", F.get_json_object("props", "$.k").cast("long")).where("attempts < 8")
    delay = F.least(60.0 * F.pow(F.lit(2.0), F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(3600.0))
    return e.select("event_id", "attempts", delay.alias("delay"), F.expr("ts + make_dt_interval(0, 0, 0, least(60.0D * power(2, greatest(attempts - 1, 0)), 3600D))").alias("next_attempt_at"))


def with_changes(known: DataFrame, disk: DataFrame, changes: DataFrame) -> DataFrame:
    """The known listing after a batch of changes (change, relpath, from_path), written as one version: what was removed,
    moved away or modified goes, what was added, modified or moved here comes from the disk; a moved note keeps its id."""
    gone = changes.select(F.coalesce("from_path", "relpath").alias("relpath")).distinct()
    here = changes.where("change <> 'removed'").join(disk.withColumnRenamed("id", "new_id"), "relpath").join(known.select(F.col("relpath").alias("from_path"), F.col("id").alias("old_id")), "from_path", "left")
    return known.join(gone, "relpath", "left_anti").select("relpath", "id", "content_hash").union(here.select("relpath", F.coalesce("old_id", "new_id"), "content_hash"))


@query("k3_change_batch", f"WITH {NOTES_SQL} SELECT relpath, content_hash FROM notes")
def change_batch(spark, sf_dir):
    """The changes between an earlier listing and the notes, applied to it: the notes."""
    from .joins import known_listing, reconcile

    disk, known = notes(spark, sf_dir).select("relpath", "id", "content_hash"), known_listing(spark, sf_dir)
    return with_changes(known, disk, reconcile(disk, known)).select("relpath", "content_hash")


@query("k5_postings_upkeep", r"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY term".replace("\\\\", "\\"))
def postings_upkeep(spark, sf_dir):
    """Of an earlier index only the changed notes' postings are made anew; a seventh had other texts, a ninth none."""
    from .search import postings

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = postings(d.where("doc_id % 9 <> 4").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.lit("other words")).otherwise(F.col("text"))), "doc_id", "text")
    dirty = d.where("doc_id % 7 = 0 or doc_id % 9 = 4")
    now = old.join(dirty.select("doc_id"), "doc_id", "left_anti").union(postings(dirty, "doc_id", "text"))
    return now.groupBy("term").agg(F.count("*").alias("df"))


@query("k8_purged", f"WITH {NOTES_SQL} SELECT folder_path, count(*) AS n FROM notes WHERE NOT (folder_path = 'src1' OR starts_with(folder_path, 'src1/')) AND id % 5 <> 0 GROUP BY 1")
def purged(spark, sf_dir):
    """Rows of excluded folders and of notes that are gone leave every derived table."""
    n = notes(spark, sf_dir).select("id", "folder_path")
    live = n.where("id % 5 <> 0 and not (folder_path = 'src1' or startswith(folder_path, 'src1/'))").select("id")
    return n.join(live, "id", "left_semi").groupBy("folder_path").agg(F.count("*").alias("n"))


@query("k15_opened_and_removed", f"WITH {NOTES_SQL}, o AS (SELECT user_id AS id, max(ts) AS opened FROM events WHERE event_type = 'click' GROUP BY 1) SELECT id, greatest(opened, mtime) AS touched FROM notes LEFT JOIN o USING (id) WHERE NOT (folder_path = 'src2/en' OR starts_with(folder_path, 'src2/en/'))")
def opened_and_removed(spark, sf_dir):
    """Opening a note leaves its time of opening; removing a folder removes all below it."""
    o = table(spark, sf_dir, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("opened"))
    n = notes(spark, sf_dir).where("not (folder_path = 'src2/en' or startswith(folder_path, 'src2/en/'))")
    return n.join(o, "id", "left").select("id", F.greatest("opened", "mtime").alias("touched"))


@query("a20_rebuilt", f"WITH {NOTES_SQL}, old AS (SELECT id, mtime AS last_opened FROM notes WHERE id % 3 = 0) SELECT id, relpath, content_hash, last_opened FROM notes LEFT JOIN old USING (id)")
def rebuilt(spark, sf_dir):
    """All derived rows made anew; only what can't be derived, the times of opening, is carried over by id."""
    n = notes(spark, sf_dir)
    old = n.where("id % 3 = 0").select("id", F.col("mtime").alias("last_opened"))
    return n.select("id", "relpath", "content_hash").join(old, "id", "left")


@query("c3_c13_hydrated", f"WITH {NOTES_SQL}, r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) SELECT user_id, CAST(rank AS INTEGER) AS rank, title, relpath FROM r JOIN notes ON id = event_id WHERE rank <= 3")
def hydrated(spark, sf_dir):
    """Ranked and cut first, joined to notes after, so that only winners are looked up."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    top = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.row_number().over(w).alias("rank")).where("rank <= 3")
    return top.join(notes(spark, sf_dir).select("id", "title", "relpath"), "id").select("user_id", "rank", "title", "relpath")
