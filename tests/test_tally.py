import math

from quernstone.operators.search import bm25


def test_terms_are_counted_within_documents(spark):
    docs = [(1, "red fox red"), (2, "fox"), (3, None), (4, ""), (5, "blue sky")]
    found = bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, "Red red fox none"), (8, "sky"), (9, "")], "query_id long, text string"))
    # null texts are documents too, as in the SQL
    idf = lambda df: math.log1p((5 - df + 0.5) / (df + 0.5))
    part = lambda tf, length: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (6 / 5)))
    want = {(7, 1): 2 * idf(1) * part(2, 3) + idf(2) * part(1, 3), (7, 2): idf(2) * part(1, 1), (8, 5): idf(1) * part(1, 2)}
    assert {(r.query_id, r.doc_id): r.score for r in found.collect()} == {k: round(v, 9) for k, v in want.items()}
    # no task gathers the terms of many documents
    plan = found._jdf.queryExecution().toString()
    assert "hashpartitioning(doc_id" not in plan and "HashAggregate" not in plan
    # ties at the last place stay
    many = spark.createDataFrame([(i, f"fox {'dog ' * (i % 3)}") for i in range(50)], "doc_id long, text string")
    best = bm25(many, spark.createDataFrame([(7, "fox")], "query_id long, text string"), keep=2)
    assert {r.doc_id for r in best.collect()} >= {0, 3} and best.count() < 50
    assert bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "query_id long, text string")).count() == 0


def test_tasks_do_not_grow_with_the_rows(spark):
    from quernstone.derived import DEALT, spread

    assert spread(spark.range(20 * DEALT).coalesce(1)).rdd.getNumPartitions() == 20
