"""Folders of Markdown files as notes, and the small files around them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.notes import is_note
from ..functions.text import parsed_front_matter
from .writers import settled

QUERY_SET = "version int, now string, timeZone string, queries array<struct<id: string, category: string, text: string, expectedPath: string, expectedSnippet: string, expectedRange: struct<start: string, end: string>, comment: string>>"
OUTCOMES = "at timestamp, query string, found boolean, seconds double, note string"
RECORDING = "key string, model string, purpose string, responseBody string"


def listing(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """relpath, mtime, size of every note; hidden files and _assets are none. Contents are read only where the column is
    used. paths: only these, which must be there."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
    literal = lambda p: re.sub(r"([{}\[\]*?\\])", r"\\\1", p)
    files = reader.load(root) if paths is None else reader.load([f"{root.rstrip('/')}/{literal(p)}" for p in paths])
    name = root.rstrip("/").split("/")[-1]
    rel = F.url_decode(F.replace(F.regexp_extract("path", rf"/{re.escape(name)}/(.*)$", 1), F.lit("+"), F.lit("%2B")))
    return files.select(rel.alias("relpath"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content").where(is_note(F.col("relpath")))


def derived_id(path):
    """A UUID (version 8) of the path's SHA-256, for notes without one."""
    h = F.sha2(F.concat(F.lit("note:"), path), 256)
    part = lambda a, n: F.substring(h, a, n)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(part(17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("8"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def notes(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """The notes table: id, relpath, folder_path, title, tags, created, mtime, size, content_hash, body."""
    f = listing(spark, root, paths).withColumn("raw", F.decode("content", "UTF-8")).withColumn("front", parsed_front_matter("raw"))
    title = F.regexp_replace(F.regexp_extract("relpath", "[^/]*$", 0), r"\.md$", "")
    folder = F.when(F.col("relpath").contains("/"), F.regexp_replace("relpath", "/[^/]*$", "")).otherwise("")
    return f.select(F.coalesce("front.id", derived_id(F.col("relpath"))).alias("id"), "relpath", folder.alias("folder_path"), title.alias("title"), "front.tags", F.coalesce(F.try_to_timestamp("front.created"), F.col("mtime")).alias("created"), "mtime", "size", F.sha2("content", 256).alias("content_hash"), F.col("front.body").alias("body"))


def changed(spark: SparkSession, root: str, manifest: DataFrame, scanned_at: Column | None = None) -> DataFrame:
    """relpaths that need reading, in order: size or modification time (to half a millisecond) differ from an earlier
    listing, or the file was written within two seconds of that scan, when it may have changed again unseen."""
    now = listing(spark, root).drop("content")
    was = manifest.select("relpath", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"))
    same = (F.col("size") == F.col("old_size")) & (F.abs(F.unix_micros(F.col("mtime").cast("timestamp")) - F.unix_micros(F.col("old_mtime").cast("timestamp"))) < 500)
    if scanned_at is not None:
        same = same & settled(F.col("old_mtime"), scanned_at)
    return now.join(was, "relpath", "left").where(~F.coalesce(same, F.lit(False))).select("relpath").orderBy("relpath")


def query_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY_SET).option("multiLine", True).json(path).select("now", F.explode("queries").alias("q")).select("q.*", "now")


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """The outcome log in order of time; lines that don't parse are left out."""
    return spark.read.schema(OUTCOMES).option("mode", "DROPMALFORMED").json(path).where("at is not null").orderBy("at")


def append_outcomes(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def recordings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORDING).option("multiLine", True).json(path)


def request_key(requests: DataFrame, columns: list[str] | None = None) -> Column:
    """The first 16 hex digits of the SHA-256 of a request's JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*(columns or requests.columns))), 256), 1, 16)


def replayed(requests: DataFrame, recorded: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Requests (of these columns, or all) with the reply recorded under their key."""
    return requests.withColumn("key", request_key(requests, columns)).join(recorded.select("key", "responseBody"), "key", "left")


def vocabulary(spark: SparkSession, path: str, most: int = 200_000) -> dict[str, int]:
    """A WordPiece vocabulary: the line number is the id. A longer file than ``most`` lines is refused."""
    lines = [r.value for r in spark.read.text(path).coalesce(1).limit(most + 1).collect()]  # a file's lines keep their order in one partition
    if len(lines) > most:
        raise ValueError(f"a vocabulary of more than {most} pieces")
    return {w: k for k, w in enumerate(lines) if w}


def synthetic(ids: DataFrame, seed: int = 1) -> DataFrame:
    """A small note for each id (a column ``id``) that depends on nothing but this and the seed."""
    pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(len(words))) + 1).cast("int"))
    sentence = F.concat_ws(" ", pick(["Check", "Plan", "Fix", "Review"], 1), pick(["the garden", "a server", "the budget", "our trip"], 2), pick(["today", "again", "with care", "by Friday"], 3))
    return ids.select("id", F.concat(F.lit("notes/"), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit(".md")).alias("relpath"), F.concat(F.lit("# Note "), F.col("id"), F.lit("\n\n"), sentence, F.lit(".\n")).alias("body"))
