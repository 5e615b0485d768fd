"""Phrases against brute force, and on odd tables."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quernstone.llm import collocations, shared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, bucket int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows, least=30, top=2000, percent=80, scale=2_000_000):
    counts, words = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", lower(text or "")):
            w = re.findall(r"[^ \t]+", piece)
            words[lang] += len(w)
            for k in (1, 2, 3, 4):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found, gone = [], set()
        for p, a in f.items():
            if len(p) > 1 and a >= least:
                for k in range(2, len(p)):
                    for i in range(len(p) - k + 1):
                        if 100 * a >= percent * f[p[i : i + k]]:
                            gone.add(p[i : i + k])
        for p, a in f.items():
            if len(p) > 1 and a >= least and p not in gone:
                score, _, l, r = min((scale * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, words[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, None, None, "w", 3) for k, (t, lang) in enumerate(rows)], SCHEMA)


def invented(seed=1):
    rng = np.random.default_rng(seed)
    words = np.array(["a", "B", "ç", "über", "e-f", "漢字", "x\x00y", "it's", "\x85k", "\xa0"])
    ends = np.array([" ", " ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", "! ", "; "])
    texts = ["".join(np.ravel(np.column_stack([rng.choice(words, n), rng.choice(ends, n)]))) for n in rng.integers(0, 60, 400)]
    return [(t, [None, "und", "en", "fr", ""][k % 5]) for k, t in enumerate(texts)]


def test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.text, r.lang) for r in docs.collect()])
    assert want and rows_of(collocations.op12_phrase_collocations(spark, sf)) == want


@pytest.mark.parametrize("projected", [1 << 22, 40])
def test_invented(spark, monkeypatch, projected):
    """Also with prefixes dealt out over several tasks, small pieces of text, and words sent twice."""
    monkeypatch.setattr(collocations, "PROJECTED", projected)
    rows = invented()
    rows += [("big a " * 300 + "a B " * 300, "en")] * 2 + [("one two three four five six", "de")] * 29 + [("One  two\tthree four five. six", "de")] * 2
    df = frame(spark, rows)
    assert rows_of(collocations.mine(df, least=5)) == brute(rows, 5)
    assert rows_of(collocations.mine(df, least=30)) == brute(rows)
    assert rows_of(collocations.mine(df, least=3, top=7, percent=50)) == brute(rows, 3, 7, 50)


def test_odd(spark):
    long = "word " * 260_000 + "x" * 1_300_000 + " a b c a b c"
    rows = [(None, "en"), ("", None), (None, None), (" \t\n..", "en"), (long, "en"), ("a b c " * 40, None), ("a b c " * 40, "und"), ("a b c " * 10, "l" * 3000)]
    assert rows_of(collocations.mine(frame(spark, rows), least=2)) == brute(rows, 2)
    assert collocations.mine(frame(spark, [])).count() == 0
    assert collocations.mine(frame(spark, [("a b", "en")])).count() == 0


def test_ranking_is_exact(spark):
    """A score whose product passes 64 bits."""
    phrases = spark.createDataFrame([([0, 1], 9_000_000_000_000_000_007)], "p array<long>, a long")
    single = spark.createDataFrame([([0], 4_000_000_000_000_000_001), ([1], 5_000_000_000_000_000_009)], "p array<long>, a long")
    words = spark.createDataFrame([(0, "en", "x"), (1, "en", "y")], "id long, lang string, word string")
    store = collocations.Frequent(spark, 6, 30)
    key = collocations._languages(frame(spark, [("", "en")]).select("text", "lang").toArrow().to_batches()[0])
    for b, s in shared.cut(key, 6):
        store.words.write(b, key[s], np.array([77]))
    r = collocations._ranked(phrases, single, words, store, 10, 80, 2_000_000).first()
    assert (r.phrase, r.score, r.n) == ("x y", 2_000_000 * 9_000_000_000_000_000_007 // 9_000_000_000_000_000_010, 77)


def test_words_of_a_task_are_few_rows(spark, monkeypatch):
    """A task sends its words a row a bucket and not a row each, also when it sends some before its end."""
    rows = [(" ".join(f"w{k} v{k}" for k in range(500)), ["en", None][j % 2]) for j in range(6)]
    made, mapped = [], collocations.shared.mapped

    def counted(df, f, schema):
        out = mapped(df, f, schema)
        if schema == collocations.PROJECTION:
            made.append(out.count())
        return out

    monkeypatch.setattr(collocations.shared, "mapped", counted)
    for held in (1 << 20, 40):
        monkeypatch.setattr(collocations, "SENT", held)
        monkeypatch.setattr(collocations, "MET", held)
        assert rows_of(collocations.mine(frame(spark, rows).coalesce(1), least=2)) == brute(rows, 2)
    assert made[0] < 500
