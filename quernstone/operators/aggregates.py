"""Totals, ledgers, percentiles and outcome summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..derived import written
from ..registry import query
from ..session import table
from . import selection


def rounded_index(values: Column, share: float) -> Column:
    """sorted[round((n - 1) * share)] of an array, halves away from zero."""
    s = F.array_sort(values)
    return F.element_at(s, (F.floor((F.size(s) - 1) * share + 0.5) + 1).cast("int"))


def usage_totals(ledger: DataFrame, *by: str) -> DataFrame:
    """Requests and token sums of a ledger (input_tokens, output_tokens); 0 where there are none."""
    return ledger.groupBy(*by).agg(F.count("*").alias("requests"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")))


def ledger(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "ts", "event_type as purpose", "user_id", "cast(floor(value) as bigint) as input_tokens", "cast(get_json_object(props, '$.k') as bigint) as output_tokens")


LEDGER_SQL = "ledger AS (SELECT event_id, ts, event_type AS purpose, user_id, CAST(floor(value) AS BIGINT) AS input_tokens, CAST(json_extract(props, '$.k') AS BIGINT) AS output_tokens FROM events)"


@query("d1_counts", "SELECT (SELECT count(*) FROM documents) AS notes, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM events) AS events")
def counts(spark, sf_dir):
    rows = None
    for name, t in (("notes", "documents"), ("vectors", "embeddings"), ("events", "events")):
        n = table(spark, sf_dir, t).agg(F.count("*").alias(name))
        rows = n if rows is None else rows.join(n)
    return rows


@query("d2_usage_totals", f"WITH {LEDGER_SQL} SELECT count(*) AS requests, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens FROM ledger WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def totals(spark, sf_dir):
    return usage_totals(ledger(spark, sf_dir).where("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-12'"))


@query("d3_usage_by_purpose", f"WITH {LEDGER_SQL} SELECT purpose, count(*) AS requests, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens FROM ledger GROUP BY purpose")
def by_purpose(spark, sf_dir):
    return usage_totals(ledger(spark, sf_dir), "purpose")


@query("d4_usage_by_month", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS until, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def by_month(spark, sf_dir):
    month = F.date_trunc("month", "o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").groupBy(month.alias("month"), F.add_months(month, 1).alias("until")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("d6_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events GROUP BY 1")
def percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p = selection.percentiles(e, ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95})
    return p.join(e.groupBy("event_type").agg(F.max("value").alias("max")), "event_type")


@query("d7_rounded_percentile", "SELECT user_id, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.9 + 0.5) AS BIGINT) + 1] AS p90 FROM events GROUP BY 1")
def rounded_percentile(spark, sf_dir):
    """By range counts, so that no user's values gather in one task."""
    return selection.percentiles(table(spark, sf_dir, "events"), ["user_id"], "value", {"p90": 0.9}, selection.rounded)


@query("d8_by_category", "SELECT l.quality, l.toxic, count(*) AS n, avg(CASE WHEN d.lang = 'en' THEN 1.0 ELSE 0.0 END) AS english FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2")
def by_category(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.avg(F.when(F.col("lang") == "en", 1.0).otherwise(0.0)).alias("english"))


@query("d9_rates_with_defaults", "SELECT event_type, coalesce(avg(CASE WHEN value < 0 THEN (value < -1)::INT END), 1.0) AS rejected, coalesce(avg(CASE WHEN value >= 0 THEN (value < 10)::INT END), 0.0) AS wrongly FROM events GROUP BY 1")
def rates(spark, sf_dir):
    """Shares within a class, with the value for an empty class given."""
    rate = lambda which, hit, empty: F.coalesce(F.avg(F.when(F.expr(which), F.expr(hit).cast("int"))), F.lit(empty))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(rate("value < 0", "value < -1", 1.0).alias("rejected"), rate("value >= 0", "value < 10", 0.0).alias("wrongly"))


@query("d11_outcome_summary", """SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS hits, count(*) FILTER (event_type <> 'click') AS misses, count(*) FILTER (value > 50) AS over_budget,
  quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.5) FILTER (event_type = 'click') AS median_of_hits, quantile_disc(value, 0.9) AS p90, max(value) AS slowest, min(ts) AS first_at, max(ts) AS last_at,
  count(DISTINCT CAST(ts AS DATE)) AS days, count(*) FILTER (event_type = 'click') / count(*) >= 0.9 AS passes FROM events GROUP BY 1""")
def outcome_summary(spark, sf_dir):
    """Counts by partial sums, days by distinct pairs, percentiles by range counts: a busy user is no task of its own."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts")
    hit = F.col("event_type") == "click"
    sums = e.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.count_if(F.col("value") > 50).alias("over_budget"),
        F.max("value").alias("slowest"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), (F.count_if(hit) / F.count("*") >= 0.9).alias("passes"))
    days = e.select("user_id", F.col("ts").cast("date").alias("day")).distinct().groupBy("user_id").agg(F.count("day").alias("days"))
    # a user's values and, as a key of their own, those of the hits
    both = e.select("user_id", F.explode(F.when(hit, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("of_hits"), "value")
    p = written(selection.percentiles(both, ["user_id", "of_hits"], "value", {"median": 0.5, "p90": 0.9}), "percentiles")
    of_hits = p.where("of_hits").select("user_id", F.col("median").alias("median_of_hits"))
    return sums.join(days, "user_id").join(p.where("not of_hits").drop("of_hits"), "user_id").join(of_hits, "user_id", "left")


@query("d19_memory_report", "SELECT count(*) AS rows, CAST(sum(len(embedding)) AS BIGINT) AS slots, CAST(2 * sum(len(embedding)) AS BIGINT) AS bytes FROM embeddings")
def memory_report(spark, sf_dir):
    n = F.sum(F.size("embedding"))
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("rows"), n.alias("slots"), (2 * n).alias("bytes"))


@query("e8_sessions_12h", "WITH g AS (SELECT *, sum(CASE WHEN ts <= prev + INTERVAL 12 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) SELECT user_id, min(ts) AS started_at, max(ts) AS last_at, count(*) AS n FROM g GROUP BY user_id, s")
def sessions_12h(spark, sf_dir):
    """Sessions that close after twelve idle hours; equality still joins."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "12 hours")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_at"), F.count("*").alias("n")).drop("session_window")


@query("e9_blocked_undo", "SELECT event_id, EXISTS (SELECT 1 FROM events l WHERE l.user_id = e.user_id AND (l.ts, l.event_id) > (e.ts, e.event_id)) AS blocked FROM events e")
def blocked_undo(spark, sf_dir):
    """An event can't be undone while a later one touches the same subject: while it isn't the subject's last."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    last = e.groupBy("user_id").agg(F.max("at").alias("last"))
    return e.join(last, "user_id").select("event_id", (F.col("at") < F.col("last")).alias("blocked"))


@query("e7_renumbered", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal FROM conversations")
def renumbered(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("ordinal"))
