"""Numbering without a task for a key, against a window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.derived import Inverted, numbered


def test_numbered(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 > 0, (F.col("id") % 5).cast("string")).alias("k"), F.xxhash64("id").alias("at"), F.col("id").alias("v"))
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("at"))).collect()
    assert sorted(map(tuple, numbered(df, ["k"], ["at"], "n").collect()), key=repr) == sorted(map(tuple, want), key=repr)
    assert numbered(df.limit(0), ["k"], ["at"], "n").count() == 0


def test_inverted_table(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v long")
    t = Inverted.build(rows, "k", "pairs", 8)
    read = lambda d: sorted((r.k, r.v) for r in d.collect())
    assert read(t.rows()) == [("a", 1), ("a", 2), ("b", 3)]
    asked = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    assert read(t.rows(asked("a", "a", "zzz", None))) == [("a", 1), ("a", 2)] and read(t.rows(asked())) == []
    for _ in range(2):  # done twice it is the same
        t.replace(t.touched(asked("a")), t.pruned(asked("a")).where("k <> 'a'"))
        assert read(t.rows()) == [("b", 3)]
    t.replace([], rows)
    assert read(t.rows()) == [("b", 3)]
