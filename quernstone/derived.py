"""Tables that the library derives and reads again: written once, in the folder that the cluster shares.

``Inverted`` holds rows by a key, in buckets of the key's hash. A search reads the buckets of the keys it asks
for, and upkeep rewrites the buckets that a change touches.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How tables of texts are compressed: they take a third less than by Spark's default, which is faster where rows are rewritten.
COMPRESSION = "zstd"
#: Keys of a lookup up to which they are sent to every task.
ASKED = 200_000


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a single machine without that setting takes a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the whole cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='derived-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table: what reads it doesn't compute it again, and lost executors cost nothing before it."""
    uri = folder(df.sparkSession, name)
    df.write.parquet(uri, compression=COMPRESSION)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def apart(df: DataFrame) -> DataFrame:
    """df as a side of a join that doesn't pass the driver. Spark takes a table for as large as its compressed files, so that
    one of ten megabytes, a hundred once it is read, would be sent whole."""
    return df.hint("merge")


def sent(df: DataFrame) -> DataFrame:
    """df sent to every task while it has ASKED rows at most, else a side of a join that doesn't pass the driver."""
    return F.broadcast(df) if df.count() <= ASKED else apart(df)


def buckets_for(texts: DataFrame, *columns: str, each: int = 32 << 20) -> int:
    """A bucket for each so many bytes of these text columns: a power of two from 8 on."""
    size = texts.agg(*(F.sum(F.octet_length(c)).alias(c) for c in columns)).first()
    return max(8, 1 << (sum(x or 0 for x in size) // each).bit_length())


#: Rows of texts that a task takes at most, about.
DEALT = 4096


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, or more of DEALT rows each, if it comes in fewer: a small file of one
    row group is one task, and a large one would be a task that grows with it."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // DEALT))
    return df.repartition(parts) if df.rdd.getNumPartitions() <= parts else df


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def grouped(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df with the rows of a bucket in one partition: tables by this key that are made of it row by row are written without a
    shuffle of their own. A bucket of texts is small, see buckets_for()."""
    return df.repartitionById(buckets, bucket_of(F.col(key), buckets))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """df with row_number() over by, ordered by order, in a column ``name``. Rows are ranged by both, counted by part, and
    numbered within their part after those of the parts before, so that a hot key's rows stay spread. ``order`` decides
    between all rows of a key; of rows that are equal in it any comes first."""
    spark, keys = df.sparkSession, [*by, *order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    # as many rows a key as there are parts
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")).drop("_n")
    within = ranged.withColumn(name, F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)))
    match = [within[c].eqNullSafe(before[c]) for c in (*by, "_part")]
    joined = within.join(before, match).select(*(within[c] for c in df.columns), (within[name] + before["_before"]).cast("int").alias(name))
    return joined


class Inverted:
    """Rows by a key. Each bucket is a folder of files sorted by key; a hot key's rows are dealt over several files."""

    compression = "snappy"

    def __init__(self, spark: SparkSession, uri: str, schema, key: str, buckets: int):
        self.spark, self.uri, self.schema, self.key, self.buckets = spark, uri, schema, key, buckets

    @classmethod
    def build(cls, rows: DataFrame, key: str, name: str, buckets: int, uri: str | None = None, together: bool = False) -> Inverted:
        """Writes rows, null keys left out; ``together`` says that they come as grouped() leaves them."""
        table = cls(rows.sparkSession, uri or folder(rows.sparkSession, name), rows.schema, key, buckets)
        held = rows.where(F.col(key).isNotNull()).withColumn("bucket", table.bucket(F.col(key)))
        table._save(held if together else held.hint("rebalance", F.col("bucket")))
        return table

    def bucket(self, key: Column) -> Column:
        return bucket_of(key, self.buckets)

    def _save(self, dealt: DataFrame) -> None:
        sorted_ = dealt.sortWithinPartitions("bucket", self.key)
        sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.uri, compression=self.compression)

    def _read(self) -> DataFrame:
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        return self.spark.read.schema(f"{names}, bucket int").parquet(self.uri)

    def rows(self, keys: DataFrame | None = None) -> DataFrame:
        """All rows, or those of the keys in the first column of ``keys`` (distinct, or repeated as often)."""
        if keys is None:
            return self._read().where(F.col(self.key).isNotNull()).drop("bucket")
        asked = keys.select(F.col(keys.columns[0]).alias(self.key)).distinct()
        return self.pruned(asked).join(sent(asked), self.key, "left_semi")

    def pruned(self, keys: DataFrame) -> DataFrame:
        """The rows of the buckets of these keys. At most one number a bucket comes to the driver."""
        return self.within(self.touched(keys))

    def within(self, touched: list[int]) -> DataFrame:
        """The rows of these buckets."""
        return self._read().where(F.col("bucket").isin(touched) & F.col(self.key).isNotNull()).drop("bucket")

    def touched(self, keys: DataFrame) -> list[int]:
        return sorted(r.b for r in keys.select(self.bucket(F.col(keys.columns[0])).alias("b")).distinct().collect() if r.b is not None)

    def replace(self, touched: list[int], rows: DataFrame) -> None:
        """Rewrites the touched buckets; rows: all that they hold from now on. A bucket left empty keeps a row without
        a key, which readers don't see, so that what it held goes. Done twice it is the same."""
        if touched:
            self._save(self._dealt(touched, rows))

    def _dealt(self, touched: list[int], rows: DataFrame) -> DataFrame:
        blank = self.spark.createDataFrame([(b,) for b in touched], "bucket int").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields), "bucket")
        dealt = rows.where(F.col(self.key).isNotNull()).withColumn("bucket", self.bucket(F.col(self.key)))
        return dealt.unionByName(blank).hint("rebalance", F.col("bucket"))

    def revise(self, touched: list[int], gone: DataFrame, rows: DataFrame) -> None:
        """Of the touched buckets the rows whose column is in ``gone`` (one column, distinct) go, and ``rows`` come in. Rows that stay are
        in their bucket already and aren't shuffled, while ``gone`` is small enough to be sent."""
        if not touched:
            return
        by = gone.columns[0]
        if gone.count() > ASKED:
            kept = self.within(touched).join(apart(gone), by, "left_anti").select(*self.schema.names)
            self.replace(touched, kept.unionByName(rows))
            return
        # a bucket for each core at a time: a task reads, and sorts, a bucket or so, however many there are
        held, cores = self._read().where(F.col(self.key).isNotNull()), self.spark.sparkContext.defaultParallelism
        few = [held.where(F.col("bucket").isin(touched[k : k + cores])) for k in range(0, len(touched), cores)]
        kept = reduce(DataFrame.union, few).join(F.broadcast(gone), by, "left_anti")
        self._save(kept.select(*self.schema.names, "bucket").unionByName(self._dealt(touched, rows)))
