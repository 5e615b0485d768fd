"""Queries over the functions on notes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query
from ..session import table
from . import notes as N


@query("g7_merged_tags", """SELECT user_id, string_agg(tag, ',' ORDER BY event_id) AS tags FROM (SELECT user_id, event_id, tag, row_number() OVER (PARTITION BY user_id, lower(tag) ORDER BY event_id) AS k
  FROM (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS tag FROM events)) WHERE k = 1 GROUP BY 1""")
def merged_tags(spark, sf_dir):
    """All of a user's tags: those of the first half are there before, those of the second come to them. Of each half the
    first of equal tags is kept before they meet."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("tag"))
    middle = e.agg(F.expr("div(max(event_id), 2)").alias("m"))
    first = e.join(F.broadcast(middle)).groupBy("user_id", (F.col("event_id") > F.col("m")).alias("late"), F.lower("tag").alias("t")).agg(F.min(F.struct("event_id", "tag")).alias("x"))
    tags = lambda late: F.transform(F.array_sort(F.collect_list(F.when(F.col("late") == F.lit(late), F.col("x")))), lambda x: x["tag"])
    g = first.groupBy("user_id").agg(tags(False).alias("a"), tags(True).alias("b"))
    return g.select("user_id", F.array_join(N.merged_tags(F.col("a"), F.col("b")), ",").alias("tags"))


@query("h29_note_paths", r"SELECT page_id, regexp_matches(lower(path), '\.md$') AND NOT regexp_matches(path, '(^|/)\.') AND split_part(path, '/', 1) <> '_assets' AS is_note, regexp_matches(path, '^[/~]') OR regexp_matches(path, '(^|/)\.\.(/|$)') AS unsafe FROM (SELECT page_id, split_part(url, '://', 2) || CASE page_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '/../x.MD' ELSE '' END AS path FROM pages)")
def note_paths(spark, sf_dir):
    path = F.concat(F.split_part("url", F.lit("://"), F.lit(2)), F.when(F.col("page_id") % 3 == 0, ".md").when(F.col("page_id") % 3 == 1, "/../x.MD").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", N.is_note(path).alias("is_note"), N.unsafe(path).alias("unsafe"))


@query("h30_safe_titles", r"SELECT page_id, coalesce(nullif(rtrim(substr(trim(regexp_replace(regexp_replace(regexp_replace(url, '[/:\\]', '-', 'g'), '[\n\r\t]', ' ', 'g'), ' +', ' ', 'g'), ' .'), 1, 200), ' .'), ''), 'Untitled') AS title FROM pages")
def safe_titles(spark, sf_dir):
    """Addresses, all of them in ASCII, as titles of notes."""
    return table(spark, sf_dir, "pages").select("page_id", N.safe_title("url").alias("title"))


@query("h40_code_fences", "SELECT conv_id, turn, '```' || role || chr(10) || text || CASE WHEN ends_with(text, chr(10)) THEN '' ELSE chr(10) END || '```' AS block FROM conversations")
def code_fences(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", N.fenced(F.col("text"), F.col("role")).alias("block"))


@query("h43_appended", r"SELECT conv_id, turn, CASE WHEN b = '' AND c = '' THEN '' WHEN b = '' THEN c || chr(10) ELSE b || chr(10) || chr(10) || '---' || chr(10) || chr(10) || c || chr(10) END AS note FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN '' ELSE regexp_replace(text, '\s+$', '') END AS b, regexp_replace(regexp_replace(role, '^\s+', ''), '\s+$', '') AS c FROM conversations)")
def appended(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", N.appended(F.col("role"), F.when(F.col("turn") % 4 == 0, "").otherwise(F.col("text"))).alias("note"))


@query("h47_label_only", r"""WITH c AS (SELECT conv_id, turn, text, trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) AS line FROM conversations), l AS (SELECT conv_id, turn, line AS label, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS session FROM c)
  SELECT conv_id, turn, len(label) <= 60 AND label <> '' AND n <> '' AND len(string_split(n, ' ')) <= 4 AND NOT contains(CASE WHEN turn % 2 = 0 THEN session ELSE '' END, n) AS label_only FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(label), '^(?:[#>*+\-\s]|\d+[.)])+', ''), '[:#\s]+$', '')) AS n FROM l)""")
def label_only(spark, sf_dir):
    """The first line of each turn, against the turn itself or against nothing."""
    c = table(spark, sf_dir, "conversations").withColumn("line", F.trim(F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), r"\s+", " ")))
    return c.select("conv_id", "turn", N.label_only(F.col("line"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("")).alias("label_only"))


@query("h21_half_floats", "SELECT vec_id, CAST(2 * len(embedding) AS INTEGER) AS bytes, true AS close FROM embeddings")
def half_floats(spark, sf_dir):
    """Vectors to binary16 and back: two bytes a component, within a thousandth of the largest."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", N.half_floats("embedding").alias("raw")).withColumn("back", N.from_half_floats("raw"))
    top = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    worst = F.array_max(F.zip_with("embedding", "back", lambda a, b: F.abs(a - b)))
    return e.select("vec_id", F.octet_length("raw").alias("bytes"), (worst <= top / 1000).alias("close"))


@query("h25_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%d %H%M') AS stamp, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days FROM events")
def times(spark, sf_dir):
    """ISO-8601 in UTC and back, the stamp of conflict copies, civil days since a date."""
    e = table(spark, sf_dir, "events").withColumn("iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    back = F.try_to_timestamp("iso")
    return e.select("event_id", "iso", F.date_format(back, "yyyy-MM-dd HHmm").alias("stamp"), F.date_diff(back.cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("days"))


@query("h8_signatures", "SELECT item_id, CAST(len(list_distinct(list_transform(range(strlen(text)), lambda k: ('0x' || substr(hex(encode(lower(text))), CAST(2 * k + 1 AS INTEGER), 2))::INT % 64))) AS INTEGER) AS classes FROM benchmark")
def signatures(spark, sf_dir):
    """How many of 64 classes of bytes a text has: what a near word can't differ in by more than its edits."""
    from ..operators.fuzzy import signature

    return table(spark, sf_dir, "benchmark").select("item_id", F.bit_count(signature(F.lower("text"))).alias("classes"))


@query("d18_sums_of_reports", "SELECT source, count(*) AS notes, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(len(text)) AS BIGINT) AS characters FROM documents GROUP BY 1 UNION ALL SELECT 'all', count(*), CAST(sum(strlen(text)) AS BIGINT), CAST(sum(len(text)) AS BIGINT) FROM documents")
def sums_of_reports(spark, sf_dir):
    """Reports add up: by source, and all of them."""
    by = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("notes"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.length("text")).alias("characters"))
    return by.union(by.agg(F.lit("all"), F.sum("notes"), F.sum("bytes"), F.sum("characters")))


@query("d21_prune_counts", "SELECT count_if(ts < TIMESTAMP '2024-01-20' AND props IS NOT NULL) AS texts_nulled, count(DISTINCT CASE WHEN ts < TIMESTAMP '2024-01-20' AND event_type NOT IN ('error', 'signup', 'purchase') THEN event_id END) AS events_stripped FROM events")
def prune_counts(spark, sf_dir):
    old = F.expr("ts < timestamp_ntz'2024-01-20'")
    return table(spark, sf_dir, "events").agg(F.count_if(old & F.col("props").isNotNull()).alias("texts_nulled"), F.count_if(old & ~F.col("event_type").isin("error", "signup", "purchase")).alias("events_stripped"))


@query("b18_maintenance_due", "SELECT user_id, last IS NULL OR last > TIMESTAMP '2024-01-25' OR last <= TIMESTAMP '2024-01-25' - INTERVAL 24 HOUR AS due FROM (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN ts END) AS last FROM events GROUP BY 1)")
def maintenance_due(spark, sf_dir):
    """Never run, run in the future, or a day ago."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last"))
    return last.select("user_id", F.expr("last is null or last > timestamp_ntz'2024-01-25' or last <= timestamp_ntz'2024-01-25' - interval 24 hours").alias("due"))


@query("b11_event_images", "SELECT o_orderkey AS event_id, list(l_linenumber ORDER BY l_linenumber) AS images FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 97 = 1 GROUP BY 1".replace("list(l_linenumber ORDER BY l_linenumber)", "string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber)"))
def event_images(spark, sf_dir):
    """Events by id with their images in order."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 97 = 1").select(F.col("o_orderkey").alias("l_orderkey"))
    i = o.join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("i"))
    return i.select("event_id", F.array_join(F.col("i").cast("array<string>"), ",").alias("images"))


@query("e2_best_chunk_by_terms", "WITH t AS (SELECT conv_id, turn, len(list_filter(['the', 'and', 'ing', 'tion'], lambda w: contains(lower(text), w))) AS hits FROM conversations) SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY hits DESC, turn) AS k FROM t) WHERE k = 1")
def best_chunk_by_terms(spark, sf_dir):
    """Of each note the chunk with most of the terms, the first of equal ones."""
    hits = F.size(F.filter(F.array(*map(F.lit, ("the", "and", "ing", "tion"))), lambda w: F.contains(F.lower("text"), w)))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("turn", F.struct(hits, -F.col("turn"))).alias("turn"))


@query("f11_gate_after_over_fetch", """WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k, event_type FROM events) SELECT user_id, event_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) AS rank FROM s WHERE k <= 20 AND event_type <> 'view') WHERE rank <= 5""")
def gate_after_over_fetch(spark, sf_dir):
    """Four times as many as asked for are taken before the gate, and the rest is cut after it."""
    top = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))).where("k <= 20 and event_type <> 'view'")
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("k"))).where("rank <= 5").select("user_id", "event_id", "rank")
