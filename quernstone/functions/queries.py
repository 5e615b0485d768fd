"""Queries over the scalar and table functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..corpus import NOTES_SQL, TERMS_SQL, notes, terms
from ..derived import spread
from ..registry import query
from ..session import table
from . import text as T
from .markup import markdown_spans as styled_spans
from .paste import classified
from .temporal import temporal
from .wordpiece import encoder, vocabulary_of


@query("h2_terms", f"SELECT doc_id, len({TERMS_SQL.format('text')}) AS terms, len(list_distinct({TERMS_SQL.format('text')})) AS different FROM documents")
def term_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(terms("text")).cast("long").alias("terms"), F.size(F.array_distinct(terms("text"))).cast("long").alias("different"))


@query("h1_fold", "SELECT doc_id, replace(lower(strip_accents(text)), 'ß', 'ss') AS folded FROM documents")
def folded(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.fold("text").alias("folded"))


@query("h7_tolerance", "SELECT item_id, w, CASE WHEN len(w) < 4 THEN 0 WHEN len(w) < 8 THEN 1 ELSE 2 END AS tolerance FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS w FROM benchmark)".replace("\\\\", "\\"))
def tolerances(spark, sf_dir):
    from ..operators.fuzzy import tolerance

    w = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(terms("text"))).alias("w"))
    return w.withColumn("tolerance", tolerance(F.length("w")))


@query("h17_h18_ranking_math", "SELECT event_id, round(1.0 / (20 + 1 + event_id % 50), 9) AS rrf, round(1 + 0.05 * exp(-greatest(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts), 0) / 86400000000.0 / 30 * 0.6931471805599453), 9) AS boost FROM events")
def ranking_math(spark, sf_dir):
    from ..operators.search import recency

    return table(spark, sf_dir, "events").select("event_id", F.round(1 / (F.lit(20) + 1 + F.col("event_id") % 50), 9).alias("rrf"), F.round(recency(F.lit("2024-02-01").cast("timestamp_ntz"), F.col("ts")), 9).alias("boost"))


@query("h24_calendar_ranges", "SELECT event_id, date_trunc('week', ts) AS this_week, date_trunc('month', ts) - INTERVAL 1 MONTH AS last_month, date_trunc('year', ts) AS this_year, date_trunc('day', ts) - INTERVAL 6 HOUR AS last_night FROM events")
def calendar_ranges(spark, sf_dir):
    cut = lambda u: F.date_trunc(u, F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", cut("week").alias("this_week"), F.expr("cast(date_trunc('month', cast(ts as timestamp)) as timestamp_ntz) - interval 1 month").alias("last_month"), cut("year").alias("this_year"), F.expr("cast(date_trunc('day', cast(ts as timestamp)) as timestamp_ntz) - interval 6 hours").alias("last_night"))


@query("h24_temporal_phrases")
def temporal_phrases(spark, sf_dir):
    """Time phrases in front of the first words of each conversation turn."""
    c = table(spark, sf_dir, "conversations").withColumn("phrase", F.element_at(F.array(*map(F.lit, ("yesterday", "last week", "three days ago", "on May 3rd", "recently", ""))), (F.col("turn") % 6 + 1).cast("int")))
    p = temporal(F.concat_ws(" ", "text", "phrase"), F.lit("2024-02-01 12:00:00").cast("timestamp_ntz"))
    return c.select("conv_id", "turn", p.alias("t")).select("conv_id", "turn", "t.*")


@query("h27_token_estimate", "SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("h28_paths", """WITH RECURSIVE p AS (SELECT page_id, list_filter(string_split(split_part(url, '://', 2), '/'), lambda p: p <> '' AND p <> '.') AS parts FROM pages), w AS (SELECT page_id, parts, 1 AS k, CAST([] AS VARCHAR[]) AS out FROM p
  UNION ALL SELECT page_id, parts, k + 1, CASE WHEN parts[k] = '..' THEN out[1 : greatest(len(out) - 1, 0)] ELSE list_append(out, parts[k]) END FROM w WHERE k <= len(parts))
  SELECT page_id, array_to_string(out, '/') AS path FROM w WHERE k = len(parts) + 1""")
def paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.normal_path(F.split_part("url", F.lit("://"), F.lit(2))).alias("path"))


@query("h31_hashes", "SELECT doc_id, sha256(text) AS hash, substr(sha256(text), 1, 16) AS short_key FROM documents")
def hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.substring(F.sha2("text", 256), 1, 16).alias("short_key"))


@query("h32_h33_encoded_lists", "SELECT user_id, to_json(kinds) AS kinds_json, array_to_string(kinds, chr(31)) AS joined FROM (SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds FROM events GROUP BY 1)")
def encoded_lists(spark, sf_dir):
    k = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    return k.select("user_id", F.to_json("kinds").alias("kinds_json"), F.array_join("kinds", "\x1f").alias("joined"))


@query("h32_h33_decoded_lists", """SELECT event_id, CASE WHEN event_id % 4 = 1 THEN '' WHEN event_id % 4 = 3 THEN '' ELSE event_type || '|' || user_id END AS tags, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type || '|' || user_id END AS path FROM events""")
def decoded_lists(spark, sf_dir):
    """Stored lists read back: JSON that is broken or no list is empty, an empty path has no parts."""
    e = table(spark, sf_dir, "events").select("event_id", F.array("event_type", F.col("user_id").cast("string")).alias("list"))
    kind = F.col("event_id") % 4
    stored = e.select("event_id", F.when(kind == 1, '["open').when(kind == 3, '{"a": 1}').otherwise(F.to_json("list")).alias("tags"), F.when(kind == 0, "").otherwise(F.array_join("list", "\x1f")).alias("path"))
    return stored.select("event_id", F.array_join(T.decoded_tags(F.col("tags")), "|").alias("tags"), F.array_join(T.decoded_path(F.col("path")), "|").alias("path"))


@query("h34_snippets", r"WITH s AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS flat FROM documents), p AS (SELECT *, greatest(instr(lower(flat), 'th') - 48, 1) AS st FROM s) SELECT doc_id, CASE WHEN st > 1 THEN '…' ELSE '' END || trim(substr(flat, st, 178)) || CASE WHEN len(flat) >= st + 178 THEN '…' ELSE '' END AS snippet FROM p")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), F.lit("th")).alias("snippet"))


@query("h34_best_snippets", r"""WITH q AS (SELECT item_id, trim(text) AS raw, regexp_extract_all(text, '[\p{L}\p{N}]+') AS t, doc_id, trim(regexp_replace(body, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS flat FROM benchmark JOIN (SELECT doc_id, text AS body FROM documents) ON doc_id = item_id),
  a AS (SELECT *, list_filter(t, lambda x: len(x) = list_max(list_transform(t, lambda y: len(y))))[1] AS long FROM q), p AS (SELECT *, CASE WHEN contains(lower(flat), lower(raw)) THEN instr(lower(flat), lower(raw)) ELSE instr(lower(flat), lower(long)) END AS pos FROM a), s AS (SELECT *, greatest(pos - 48, 1) AS st FROM p)
  SELECT item_id, CASE WHEN st > 1 THEN '…' ELSE '' END || trim(substr(flat, st, 178)) || CASE WHEN len(flat) >= st + 178 THEN '…' ELSE '' END AS snippet FROM s""")
def best_snippets(spark, sf_dir):
    """A benchmark text, or its longest word, shown in the document of its number."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.trim("text").alias("raw"), F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("t"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("body"))
    return b.join(d, "item_id").select("item_id", T.best_snippet(F.col("body"), F.col("raw"), F.col("t")).alias("snippet"))


@query("h44_redaction", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, 'AKIA[0-9A-Z]{16}', '<redacted>', 'g'), '(?i)(password|api_key|token)\s*[=:]\s*[\x22'']?[A-Za-z0-9_\-]{8,}[\x22'']?', '<redacted>', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '<redacted>', 'g') AS clean FROM documents")
def redaction(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("clean"))


@query("utf16_lengths")
def utf16_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.utf16_length(F.col("text")).alias("length"))


@query("h42_i5_turn_diffs")
def turn_diffs(spark, sf_dir):
    """The line differences between each turn of a conversation and the one before."""
    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    d = c.select("conv_id", "turn", F.posexplode(T.diff(F.coalesce("before", F.lit("")), "text")).alias("pos", "d"))
    return d.select("conv_id", "turn", "pos", "d.op", "d.line")


@query("l12_unified_diffs")
def unified_diffs(spark, sf_dir):
    """Each turn against the one before, as text with three lines of context."""
    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", T.unified_diff(F.coalesce("before", F.lit("")), "text").alias("diff"))


@query("d22_diff_counts")
def diff_counts(spark, sf_dir):
    return turn_diffs(spark, sf_dir).groupBy("conv_id", "turn").agg(F.count_if(F.col("op") == "+").alias("added"), F.count_if(F.col("op") == "-").alias("removed"))


@query("i1_chunks")
def chunk_rows(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(T.chunked("text")).alias("ordinal", "c")).select("doc_id", "ordinal", "c.*")


@query("h39_pasted_kinds")
def pasted_kinds(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", classified("text").alias("k")).select("conv_id", "turn", "k.*")


@query("h22_hashed_embeddings")
def hashed_embeddings(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.hashed_embedding("text").alias("vector"))


@query("h45_wordpiece")
def wordpieces(spark, sf_dir):
    """Whole texts by a vocabulary of the documents' own frequent words; a model's is read with
    sources.markdown.vocabulary()."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = vocabulary_of(d, "text").collect()  # at most 30,000 words and the characters
    names = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *sorted({r.w for r in rows} | set(".,;:!?-'"))]
    return d.select("doc_id", encoder({w: k for k, w in enumerate(names)}, limit=1 << 30)("text").alias("t")).select("doc_id", "t.ids")


@query("h46_markdown_spans")
def markdown_spans(spark, sf_dir):
    """The styled spans of texts, with a heading, a list and a fence before each."""
    t = F.concat(F.lit("# Head *it*\n- [x] done `code`\n```py\nx\n```\n"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(styled_spans(t)).alias("ordinal", "s")).select("doc_id", "ordinal", "s.*")


@query("h20_h35_coverage", f"WITH {NOTES_SQL}, w AS (SELECT id, list_distinct(regexp_extract_all(lower(title), '[a-z]{{3,}}')) AS a, list_distinct(regexp_extract_all(lower(body), '[a-z]{{3,}}')) AS b FROM notes) SELECT id, len(a) AS words, len(list_intersect(a, b)) / greatest(len(a), 1) AS coverage FROM w")
def coverage(spark, sf_dir):
    w = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)))
    return notes(spark, sf_dir).select("id", w("title").alias("a"), w("body").alias("b")).select("id", F.size("a").cast("long").alias("words"), (F.size(F.array_intersect("a", "b")) / F.greatest(F.size("a"), F.lit(1))).alias("coverage"))
