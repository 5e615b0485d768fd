"""Upkeep moves what is new, and many queries are scored within the notes."""

from pyspark.sql import functions as F

from quernstone.derived import Inverted
from quernstone.operators import postings
from quernstone.operators.postings import Postings, of_documents


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_that_stay_are_not_shuffled(spark, monkeypatch):
    """Before, an update shuffled all rows of the touched buckets."""
    t = Inverted.build(spark.range(2000).select((F.col("id") % 50).cast("string").alias("k"), F.col("id").alias("v")), "k", "pairs", 8)
    saved, save = [], Inverted._save
    monkeypatch.setattr(Inverted, "_save", lambda self, dealt: (saved.append(plan(dealt)), save(self, dealt)))
    t.revise(list(range(8)), spark.range(1000).select(F.col("id").alias("v")), spark.createDataFrame([("new", 1)], "k string, v long"))
    assert saved[0].count("Exchange rebalancepartitions") + saved[0].count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in saved[0]
    assert sorted((r.k, r.v) for r in t.rows().collect()) == sorted([("new", 1), *((str(v % 50), v) for v in range(1000, 2000))])


def test_many_queries_are_scored_within_the_notes(spark, monkeypatch):
    """Before, each pair of a query and a note was a row of a shuffle."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit(w), (F.col("id") % n).cast("string")) for w, n in (("a", 3), ("b", 7), ("c", 50)))).alias("text"))
    index = Postings.build(of_documents(docs, 8), 8, together=True)
    asked = spark.range(100).select(F.col("id").alias("query_id"), F.explode(F.array(F.concat(F.lit("a"), (F.col("id") % 4).cast("string")), F.concat(F.lit("c"), (F.col("id") % 60).cast("string")))).alias("term"), F.lit(1).alias("qtf"))
    many = index.bm25(asked)
    assert "Exchange" not in plan(many) and index._postings is None
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = rows(many)
    assert want == rows(index.bm25(asked, by_term=True)) and len(want) > 5000
    best = {(q, i): s for q, i, s in rows(index.bm25(asked, keep=3))}
    for q in range(0, 100, 9):
        first = sorted((-s, i) for p, i, s in want if p == q)[:3]
        assert all((q, i) in best for _, i in first)
    # queries of more terms than are sent together go in blocks; before, such were joined to all postings
    monkeypatch.setattr(postings, "TERMS", 60)
    blocks = index.bm25(asked)
    assert "Exchange" not in plan(blocks) and plan(blocks).count("MapInArrow") > 1 and rows(blocks) == want
