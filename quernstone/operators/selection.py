"""Exact order statistics by range counts: no key's values gather in one task, however many it has.

Each (key, rank) looks for its value in a range that holds it. A pass counts the values of the range in WIDTH equal parts,
summed where the rows are, and goes on with the part that holds the rank, whose ends are its least and greatest value. A range of
one value is found; ranges of LAST rows or fewer are sorted at the end. Two passes do for values spread evenly; others
take more, each over the rows of the remaining ranges only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..derived import ASKED, written

WIDTH, LAST = 1024, 4096


def _located(rows: DataFrame, ranges: DataFrame, key: list[str]) -> DataFrame:
    """Each range's values, by its rank: rows joined with ranges by key; NaN counts as greater than all numbers."""
    few = F.broadcast(ranges) if ranges.count() <= ASKED else ranges
    return rows.join(few, key).where("value >= low and value <= high")


def sizes(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, n, low, high: how many values a key has, the least and the greatest."""
    v = F.col(value).cast("double") + 0.0
    return rows.groupBy(*key).agg(F.count(value).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))


def at_ranks(rows: DataFrame, key: list[str], value: str, ranks: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """key, rank, value: the values at these ranks (from 1) of each key's values in ascending order. ranks: key, rank;
    ranks outside have no row. whole: sizes() of the rows, if these are known. Null values take no part; a null key is a key. Values are numbers, compared as doubles."""
    # joins don't match nulls: each key column goes as a text and whether it is null
    safe = [f"_k{i}" for i in range(2 * len(key))]
    coded = [c for i, k in enumerate(key) for c in (F.coalesce(F.col(k).cast("string"), F.lit("")).alias(safe[2 * i]), F.col(k).isNull().alias(safe[2 * i + 1]))]
    rows = rows.where(F.col(value).isNotNull()).select(*coded, (F.col(value).cast("double") + 0.0).alias("value"))
    asked = ranks.select(*key, "rank").distinct()
    whole = sizes(rows, safe, "value") if whole is None else whole.where("n > 0").select(*coded, "n", "low", "high")
    open_ = written(asked.select(*coded, "rank").join(whole, safe).where(F.col("rank").between(1, F.col("n"))).select(*safe, "rank", F.col("rank").alias("left"), "n", "low", "high"), "ranges")
    done = []
    while True:
        done.append(open_.where("low = high").select(*safe, "rank", F.col("low").alias("value")))
        rest = open_.where("low < high and n <= %d" % LAST)
        wide = open_.where("low < high and n > %d" % LAST)
        if not rest.isEmpty():
            found = _located(rows, rest, safe).withColumn("at", F.row_number().over(Window.partitionBy(*safe, "rank").orderBy("value")))
            done.append(found.where("at = left").select(*safe, "rank", "value"))
        if wide.isEmpty():
            break
        # infinite ends, and ranges whose width overflows, are cut at the middle by halves
        part = F.floor((F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * WIDTH)
        part = F.when(F.col("value") <= F.col("low"), 0).when(F.col("value") >= F.col("high"), WIDTH).otherwise(F.coalesce(F.when(~F.isnan(part.cast("double")), F.least(F.greatest(part, F.lit(0)), F.lit(WIDTH))), F.lit(WIDTH // 2)))
        counted = _located(rows, wide, safe).groupBy(*safe, "rank", "left", part.cast("int").alias("part")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        # WIDTH + 1 rows a range at most
        upto = F.sum("n").over(Window.partitionBy(*safe, "rank").orderBy("part"))
        counted = counted.withColumn("upto", upto).where((F.col("left") <= F.col("upto")) & (F.col("left") > F.col("upto") - F.col("n")))
        open_ = written(counted.select(*safe, "rank", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), "n", "low", "high"), "ranges")
    every = done[0]
    for d in done[1:]:
        every = every.union(d)
    return asked.select(*key, "rank", *coded).join(every, [*safe, "rank"]).select(*key, "rank", "value")


def nearest(n: Column, share: float) -> Column:
    """ceil(share * n), from 1."""
    return F.greatest(F.ceil(F.round(n * share, 9)), F.lit(1)).cast("long")


def rounded(n: Column, share: float) -> Column:
    """round((n - 1) * share) + 1, halves up."""
    return (F.floor((n - 1) * share + 0.5) + 1).cast("long")


def percentiles(rows: DataFrame, key: list[str], value: str, shares: dict[str, float], rule=nearest) -> DataFrame:
    """key and a column for each share: its percentile of the key's values by the rule; null for a key without any."""
    n = written(sizes(rows, key, value), "sizes")
    ranks = n.where("n > 0").select(*key, F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rule(F.col("n"), x).alias("rank")) for name, x in shares.items()))).alias("r")).select(*key, "r.*")
    named = ranks.alias("a").join(at_ranks(rows, key, value, ranks, n).alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*key, "rank")])
    wide = named.select(*(F.col(f"a.{k}").alias(k) for k in key), "name", "b.value").groupBy(*key).agg(*(F.max(F.when(F.col("name") == x, F.col("value"))).alias(x) for x in shares))
    return n.alias("n").join(wide.alias("w"), [F.col(f"n.{k}").eqNullSafe(F.col(f"w.{k}")) for k in key], "left").select(*(F.col(f"n.{k}").alias(k) for k in key), *shares)
