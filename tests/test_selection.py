"""Order statistics by range counts against sorted lists."""

import math
import random

from pyspark.sql import functions as F

from quernstone.operators import selection


def brute(rows, shares, rule):
    by = {}
    for k, v in rows:
        by.setdefault(k, []).extend([] if v is None else [v])
    order = lambda v: (math.isnan(v), v)
    out = {}
    for k, v in by.items():
        v = sorted(v, key=order)
        out[k] = tuple(None if not v else v[(max(1, math.ceil(round(len(v) * x, 9))) if rule == "nearest" else math.floor((len(v) - 1) * x + 0.5) + 1) - 1] for x in shares)
    return out


def same(a, b):
    return {k: tuple(map(str, v)) for k, v in a.items()} == {k: tuple(map(str, v)) for k, v in b.items()}


def check(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    for rule, name in ((selection.nearest, "nearest"), (selection.rounded, "rounded")):
        got = {r.k: (r.a, r.b, r.c) for r in selection.percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.9, "c": 1.0}, rule).collect()}
        assert same(got, brute(rows, (0.5, 0.9, 1.0), name))


def test_one_key_holds_most_rows(spark, duck, same_rows):
    rng = random.Random(1)
    rows = [("hot", rng.lognormvariate(0, 3)) for _ in range(30_000)] + [(f"k{k % 300}", rng.choice([1.0, 2.0, float(k)])) for k in range(3_000)]
    check(spark, rows)
    df = spark.createDataFrame(rows, "k string, v double")
    relation = duck.sql("select * from (values " + ",".join(f"('{k}', {v!r}::double)" for k, v in rows) + ") t(k, v)").query("t", "select k, quantile_disc(v, 0.5) as a, quantile_disc(v, 0.95) as b from t group by k")
    same_rows(selection.percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.95}), relation)


def test_odd_values(spark, monkeypatch):
    """Ties, nulls, infinities, NaN, a null key, huge ranges, with ranges cut small."""
    monkeypatch.setattr(selection, "WIDTH", 4)
    monkeypatch.setattr(selection, "LAST", 3)
    inf, nan = float("inf"), float("nan")
    rng = random.Random(2)
    rows = [("tie", 7.0)] * 50 + [("none", None), (None, 1.0), (None, 3.0), (None, None)] + [("wide", x) for x in (1.7e308, -1.7e308, 0.0, 1e-320, 5.0, 6.0, 7.0)] * 3 + [("inf", x) for x in (inf, -inf, 1.0, 2.0, 3.0)] * 2
    rows += [("nan", x) for x in (nan, 1.0, 2.0, nan, 3.0, 4.0)] + [("steps", 2.0**k) for k in range(-60, 60)] + [("zero", rng.choice([1.0, 0.0])) for _ in range(40)]
    check(spark, rows)
    assert selection.percentiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", {"a": 0.5}).count() == 0


def test_no_task_holds_a_key(spark):
    """What is shuffled of a hot key is a row for each part and task, and not its values."""
    df = spark.range(200_000, numPartitions=4).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 100_003).cast("double").alias("v"))
    r = selection.percentiles(df, ["k"], "v", {"a": 0.5}).first()
    assert r.a == sorted(x * 7919 % 100_003 for x in range(200_000))[99_999]
