"""The pipeline's stages, each on its own input."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quernstone.llm import jaccard_join, personal, repeats, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return {name: (before, after) for name, before, after in out}


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_shape(stages, spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "best_fit_packing")


def test_toxicity(stages, spark, sf):
    before, after = stages["toxicity"]
    gone = {r.doc_id for r in toxicity.toxicity(before, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    assert set(rows(after)) == set(rows(before)) - gone


def test_near_duplicates(stages):
    before, after = stages["ngram_jaccard_join"]
    assert set(rows(after)) == {r.component_id for r in jaccard_join.near_duplicates(before).collect()}


def test_repeats(stages):
    before, after = stages["suffix_array_dedup"]
    a, b = rows(before), rows(after)
    assert set(a) == set(b)
    for r in repeats.repeated_spans(before, corpus_pipeline.PASSAGE).collect():
        raw = a[r.doc_id].text.encode()
        lost = len(raw) - len(b[r.doc_id].text.encode())
        assert r.n_removed - 6 * r.n_spans <= lost <= r.n_removed and b[r.doc_id].n_chars == len(b[r.doc_id].text)


def test_personal_data(stages):
    before, after = stages["pii"]
    a, b = rows(before), rows(after)
    assert set(a) == set(b)
    assert all(not personal.base_spans(r.text) for r in b.values())
    assert all(a[i].text == b[i].text for i in a if not personal.base_spans(a[i].text))


def test_packing(stages):
    before, after = stages["best_fit_packing"]
    full = Counter()
    for r in after.collect():
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 2048 and {r.doc_id for r in after.collect()} == set(rows(before))


def test_odd_table(spark, sf):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "mail me at x@example.com now please", None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
    assert docs.count() >= 4


def test_empty_long_and_clashing(spark, sf):
    """Empty tables stay empty; a very long text and columns named like our own pass all stages with their values."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, component_id long, bucket int, label string"
    long = " ".join(f"w{k}" for k in range(60_000)) + " write to x@example.com"
    for rows in ([], [(1, long, "en", "s", len(long), "r", 5, 6, "l"), (2, None, None, None, None, None, None, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, sf)
            assert after.columns == docs.columns
            docs = spark.createDataFrame(after.collect(), docs.schema)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        if rows:
            kept = {r.doc_id: r for r in docs.collect()}
            assert kept[1].text == long.replace("x@example.com", "<EMAIL>") and kept[1].row == "r" and kept[1].component_id == 5 and kept[1].n_chars == len(kept[1].text)
            assert {r.doc_id for r in packed} == {1, 2} and not kept[2].text
        else:
            assert docs.count() == 0 and packed == []


def test_rows_without_or_with_repeated_ids(spark, sf):
    """One text of each group of copies passes all stages whole, whatever the ids are."""

    def text(k):
        return " ".join(f"word{(k * 7919 + i * 104729) % 99991}" for i in range(80))

    rows = [(None, text(1)), (None, text(1)), (10, text(2)), (10, text(2)), (None, text(3)), (12, text(3)), (11, text(3)), (5, text(4)), (6, text(4)), (6, text(5)), (None, None), (None, None), (20, ""), (20, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        docs = spark.createDataFrame(after.collect(), after.schema)
    whole = [(None, text(1)), (10, text(2)), (11, text(3)), (5, text(4)), (6, text(5))]
    found = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert sorted(map(str, found)) == sorted(map(str, [*whole, (None, ""), (None, ""), (20, ""), (20, "")]))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 9


def test_toxic_rows_go_by_text(spark):
    rows = [(i, " ".join(f"w{(i * 31 + k * 17) % 400}" for k in range(80)) + (" vilemark nastymark vilemark" if i % 5 == 0 else "")) for i in range(600)]
    rows = [(i, " ".join(np.random.default_rng(i).permutation(t.split()))) for i, t in rows]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    bad, good = rows[0][1], rows[1][1]
    more = [(None, bad), (None, good), (9000, bad), (9000, good)]
    after = toxicity.reject(spark.createDataFrame([*rows, *more], "doc_id long, text string"), labels)
    assert [(r.doc_id, r.text) for r in after.where("doc_id is null or doc_id = 9000").collect()] == [(None, good), (9000, good)]
