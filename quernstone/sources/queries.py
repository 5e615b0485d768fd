"""Queries over sources that need no files of their own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query
from ..session import table
from .markdown import derived_id, replayed, request_key, synthetic
from .reports import row_counts


@query("a3_derived_ids", "SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT page_id, sha256('note:' || url) AS h FROM pages)")
def derived_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", derived_id(F.col("url")).alias("id"))


@query("a13_replayed_requests", """WITH t AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS speaker FROM conversations),
  m AS (SELECT text, min(reply) AS reply FROM t WHERE role = 'user' AND speaker = 'assistant' GROUP BY 1) SELECT conv_id, turn, m.reply FROM conversations c LEFT JOIN m ON m.text = c.text WHERE role = 'user'""")
def replayed_requests(spark, sf_dir):
    """Every question with the reply that was recorded for it: what the assistant said to the same words, of several the
    least."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumn("reply", F.lead("text").over(w)).withColumn("speaker", F.lead("role").over(w)).where("role = 'user'")
    recorded = t.where("speaker = 'assistant'").groupBy(request_key(t.select("role", "text")).alias("key")).agg(F.min("reply").alias("responseBody"))
    return replayed(t.select("conv_id", "turn", "role", "text"), recorded, ["role", "text"]).select("conv_id", "turn", F.col("responseBody").alias("reply"))


@query("a14_synthetic_corpus")
def synthetic_corpus(spark, sf_dir):
    """A small note for every document, of the same words whenever it is made."""
    return synthetic(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("a19_catalog", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def catalog(spark, sf_dir):
    """Every table of the data with its rows; sources.reports.catalog() takes the names from the session's catalog."""
    return row_counts({t: table(spark, sf_dir, t) for t in TABLES})
