"""Projections, filters, orders, pages and set operations over notes and the activity log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..corpus import NOTES_SQL, NOW, notes
from ..registry import query
from ..session import table


def in_subtree(folder: Column, prefix: str) -> Column:
    """The folder itself or one below it; % and _ have no special meaning."""
    return (folder == prefix) | folder.startswith(prefix + "/")


def excluded(folder: Column, folders: list[str]) -> Column:
    """Whether one of the folders, slashes at the ends ignored, is the folder or above it."""
    clean = sorted({f.strip("/") for f in folders})
    return F.exists(F.array(*map(F.lit, clean)).cast("array<string>"), lambda e: (folder == e) | folder.startswith(F.concat(e, F.lit("/"))))


def half_open(ts: Column, start: Column, end: Column) -> Column:
    """start <= ts < end, where an end before the start counts as the start."""
    return (ts >= start) & (ts < F.greatest(start, end))


def keyset_page(rows: DataFrame, ts: str, key: str, before: tuple | None, size: int) -> DataFrame:
    """The newest rows before a cursor, by (ts, key) descending."""
    if before:
        at = F.lit(before[0]).cast(rows.schema[ts].dataType)
        rows = rows.where((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) < before[1])))
    return rows.orderBy(F.desc(ts), F.desc(key)).limit(size)


def implied_folders(rows: DataFrame, folder: str = "folder_path") -> DataFrame:
    """All ancestors of all folders, themselves included, the root not."""
    parts = F.split(folder, "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    path = rows.select(folder).distinct().select(F.explode(paths).alias("path")).where("path != ''").distinct()
    return path.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).alias("parent_path"), F.size(F.split("path", "/")).alias("depth"))


@query("b1_notes_by_path", f"WITH {NOTES_SQL} SELECT id, relpath, title FROM notes ORDER BY relpath")
def notes_by_path(spark, sf_dir):
    return notes(spark, sf_dir).select("id", "relpath", "title").orderBy("relpath")


@query("b2_point_lookup", f"WITH {NOTES_SQL} SELECT id, relpath, content_hash FROM notes WHERE id = 7 OR relpath = 'src1/en/000000000001.md'")
def point_lookup(spark, sf_dir):
    return notes(spark, sf_dir).where("id = 7 or relpath = 'src1/en/000000000001.md'").select("id", "relpath", "content_hash")


@query("b3_in_list", "SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def in_list(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(wanted, "doc_id", "left_semi")


@query("b4_folder_by_title", f"WITH {NOTES_SQL} SELECT id, title FROM notes WHERE folder_path = 'src1/en' ORDER BY title, id")
def folder_by_title(spark, sf_dir):
    return notes(spark, sf_dir).where("folder_path = 'src1/en'").select("id", "title").orderBy("title", "id")


@query("b5_folder_subtree", f"WITH {NOTES_SQL} SELECT id, folder_path FROM notes WHERE folder_path = 'src1' OR starts_with(folder_path, 'src1/')")
def folder_subtree(spark, sf_dir):
    return notes(spark, sf_dir).where(in_subtree(F.col("folder_path"), "src1")).select("id", "folder_path")


@query("b6_exclusion", f"WITH {NOTES_SQL} SELECT id, folder_path FROM notes WHERE NOT (folder_path = 'src0' OR starts_with(folder_path, 'src0/') OR folder_path = 'src1/en' OR starts_with(folder_path, 'src1/en/'))")
def exclusion(spark, sf_dir):
    return notes(spark, sf_dir).where(~excluded(F.col("folder_path"), ["/src1/en", "src0/", "src0"])).select("id", "folder_path")


@query("b7_admission_gate", f"WITH {NOTES_SQL} SELECT v.vec_id FROM embeddings v WHERE v.vec_id IN (SELECT id FROM notes WHERE mtime >= TIMESTAMP '2024-01-03' AND mtime < TIMESTAMP '2024-01-20' AND starts_with(folder_path, 'src') AND NOT starts_with(folder_path, 'src0/'))")
def admission_gate(spark, sf_dir):
    open_ = notes(spark, sf_dir).where(half_open(F.col("mtime"), F.lit("2024-01-03").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")) & F.col("folder_path").startswith("src") & ~excluded(F.col("folder_path"), ["src0"]))
    return table(spark, sf_dir, "embeddings").select("vec_id").join(open_, F.col("vec_id") == F.col("id"), "left_semi")


@query("b9_keyset_page", "SELECT event_id, ts, event_type FROM events WHERE ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id < 500) ORDER BY ts DESC, event_id DESC LIMIT 50")
def page(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return keyset_page(rows, "ts", "event_id", ("2024-01-20 00:00:00", 500), 50)


@query("b10_undoable", "SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase' AND value > 10 ORDER BY ts DESC, event_id DESC LIMIT 10")
def undoable(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'purchase' and value > 10").select("event_id", "user_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(10)


@query("b12_vector_filter", "SELECT vec_id, label, len(embedding) AS dim FROM embeddings WHERE len(embedding) = 64 AND label IS NOT NULL")
def vector_filter(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("size(embedding) = 64 and label is not null").select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))


@query("b13_implied_folders", f"WITH {NOTES_SQL}, f AS (SELECT DISTINCT folder_path AS path FROM notes UNION SELECT DISTINCT split_part(folder_path, '/', 1) FROM notes) SELECT path, split_part(path, '/', -1) AS name, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) END AS parent_path, CAST(len(string_split(path, '/')) AS INTEGER) AS depth FROM f")
def folders(spark, sf_dir):
    return implied_folders(notes(spark, sf_dir))


@query("b17_due", f"SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) IS NULL OR ts + to_seconds(60 * CAST(json_extract(props, '$.k') AS BIGINT)) <= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def due(spark, sf_dir):
    """Queue rows whose next attempt is unset or has come."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.where(F.col("k").isNull() | F.expr(f"ts + make_dt_interval(0, 0, k) <= timestamp_ntz'{NOW}' - interval 7 days")).select("event_id")


@query("b16_leaks", "SELECT b.item_id, count(*) AS n FROM benchmark b, documents d WHERE contains(d.text, b.text) GROUP BY b.item_id")
def leaks(spark, sf_dir):
    """Documents that hold a whole benchmark passage."""
    from .search import containing, passages

    met = containing(table(spark, sf_dir, "documents").select("doc_id", "text"), passages(spark, sf_dir))
    return met.groupBy(F.col("query_id").alias("item_id")).agg(F.count("*").alias("n"))


@query("f6_recents", f"WITH {NOTES_SQL}, opened AS (SELECT user_id AS id, max(ts) AS last_opened FROM events GROUP BY 1) SELECT id, relpath, greatest(coalesce(last_opened, TIMESTAMP '1970-01-01'), mtime) AS touched FROM notes LEFT JOIN opened USING (id) ORDER BY touched DESC, relpath LIMIT 20")
def recents(spark, sf_dir):
    opened = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last_opened"))
    touched = F.greatest(F.coalesce(F.col("last_opened"), F.expr("timestamp_ntz'1970-01-01'")), F.col("mtime"))
    return notes(spark, sf_dir).join(opened, "id", "left").select("id", "relpath", touched.alias("touched")).orderBy(F.desc("touched"), "relpath").limit(20)


@query("f9_natural_order", "SELECT DISTINCT source, lower(regexp_extract(source, '^[^0-9]*')) || lpad(regexp_extract(source, '[0-9]+'), 12, '0') AS sort_key FROM documents ORDER BY sort_key")
def natural_order(spark, sf_dir):
    """Digit runs compare as numbers: each is padded to twelve places."""
    key = F.concat(F.lower(F.regexp_extract("source", "^[^0-9]*", 0)), F.lpad(F.regexp_extract("source", "[0-9]+", 0), 12, "0"))
    return table(spark, sf_dir, "documents").select("source").distinct().withColumn("sort_key", key).orderBy("sort_key")


@query("g1_stale_union", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION SELECT doc_id FROM labels WHERE quality = 0")
def stale_union(spark, sf_dir):
    d, v = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings")
    return d.join(v, F.col("doc_id") == F.col("vec_id"), "left_anti").union(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")).distinct()


@query("g2_differences", "(SELECT 'added' AS change, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) UNION ALL (SELECT 'removed', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents))")
def differences(spark, sf_dir):
    a, b = (table(spark, sf_dir, t).select("doc_id") for t in ("documents", "labels"))
    return a.subtract(b).select(F.lit("added").alias("change"), "doc_id").union(b.subtract(a).select(F.lit("removed"), "doc_id"))


@query("g4_word_overlap", r"WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS a FROM conversations) SELECT x.conv_id, x.turn, len(list_intersect(x.a, y.a)) AS common, len(x.a) - len(list_intersect(x.a, y.a)) AS only_here, len(x.a) + len(y.a) - len(list_intersect(x.a, y.a)) AS in_either FROM w x JOIN w y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1")
def word_overlap(spark, sf_dir):
    """Word sets of each turn and the next of its conversation."""
    from ..corpus import terms

    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(terms("text")).alias("a"))
    y = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    size = lambda c: F.size(c).cast("long")
    return w.join(y, ["conv_id", "turn"]).select("conv_id", "turn", size(F.array_intersect("a", "b")).alias("common"), size(F.array_except("a", "b")).alias("only_here"), size(F.array_union("a", "b")).alias("in_either"))


@query("g5_subset_and_overlap", "WITH s AS (SELECT user_id, list_distinct(list(event_type)) AS kinds FROM events GROUP BY 1) SELECT user_id, list_has_all(kinds, ['click', 'view']) AS has_both, list_has_any(kinds, ['error', 'signup']) AS overlaps FROM s")
def subset_and_overlap(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    lits = lambda *x: F.array(*map(F.lit, x))
    return kinds.select("user_id", (F.size(F.array_except(lits("click", "view"), "kinds")) == 0).alias("has_both"), F.arrays_overlap("kinds", lits("error", "signup")).alias("overlaps"))


@query("l13_folder_tree", f"WITH {NOTES_SQL}, own AS (SELECT folder_path AS path, count(*) AS n FROM notes GROUP BY 1), every AS (SELECT path, n FROM own UNION ALL SELECT split_part(path, '/', 1), n FROM own) SELECT path, CAST(sum(n) AS BIGINT) AS notes_below FROM every GROUP BY path ORDER BY path")
def folder_tree(spark, sf_dir):
    """Every folder with the number of notes in it and below."""
    own = notes(spark, sf_dir).groupBy("folder_path").agg(F.count("*").alias("n"))
    parts = F.split("folder_path", "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return own.select(F.explode(paths).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("notes_below")).orderBy("path")
