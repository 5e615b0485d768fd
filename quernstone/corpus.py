"""The note corpus as the driver's tables play it, in Spark and in SQL.

documents are notes: the folder is source/lang, the title the first sentence's first 60 characters,
the modification time an hour for each id. The tables have no such columns; both forms derive them alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table

NOW = "2024-02-01 00:00:00"

NOTES_SQL = r"""notes AS (SELECT doc_id AS id, source || '/' || lang AS folder_path,
  source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.md' AS relpath,
  trim(substr(regexp_extract(text, '^[^.\n]*'), 1, 60)) AS title, text AS body, sha256(text) AS content_hash,
  TIMESTAMP '2024-01-01' + to_hours(doc_id) AS mtime FROM documents)"""

TERMS_SQL = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    folder = F.concat_ws("/", "source", "lang")
    return d.select(
        F.col("doc_id").alias("id"), folder.alias("folder_path"),
        F.concat(folder, F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".md")).alias("relpath"),
        F.trim(F.substring(F.regexp_extract("text", r"^[^.\n]*", 0), 1, 60)).alias("title"), F.col("text").alias("body"),
        F.sha2("text", 256).alias("content_hash"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, doc_id)").alias("mtime"),
    )


def terms(column: str):
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
