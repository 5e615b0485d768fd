"""Pasted texts, word pieces, delays, stored lists and the catalog against exact rows or plain loops."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quernstone.functions import paste as P
from quernstone.functions import text as T
from quernstone.functions import wordpiece as W
from quernstone.operators.maintenance import retry_delay
from quernstone.sources import reports

PASTES = {
    ("shell", "bash"): [
        "$ git status", "% ls -la", "  $ npm install\n  $ npm test", "Then run it:\n$ make all\nand wait for the result to come.", "git commit -m 'x'", "sudo apt-get install nginx", "FOO=1 ./run.sh now",
        "docker run \\\n  --rm \\\n  -p 80:80 nginx", "cat a.txt | sort | uniq -c", "cd /tmp\nls -l", "./configure --prefix=/usr", "FOO=1 build/App/run", "curl https://example.org/x", "ls -la | grep x\n| wc -l", "git push origin main",
    ],
    ("code", "json"): ['{"a": 1, "b": [1, 2]}', '[{"x": null}]', '{\n  "name": "x"\n}'],
    ("code", "yaml"): ["name: x\nversion: 2", "a:\n  - b\n  - c: 1\n    d: 2", "# note\nkey: value\nother: 1", "services:\n  web:\n    image: nginx"],
    ("code", "sql"): ["SELECT a, b FROM t WHERE c = 1", "insert into t (a) values (1)", "create table x (id int)", "select *\nfrom t\nwhere a > 1\norder by b"],
    ("code", "python"): ["def f(x):\n    return x + 1", "import os\nfrom sys import argv\nprint(argv)", "class A(B):\n    def __init__(self):\n        self.x = None"],
    ("code", "swift"): ["func load() -> Data {\n    let x: Int = 1\n    return d\n}", "struct Point {\n    var x: Int = 0\n}"],
    ("code", "javascript"): ["const x = require('y');\nconsole.log(x);", "export function f(a) {\n  return a === 1;\n}"],
    ("code", "rust"): ["fn main() {\n    let mut x = 1;\n}"],
    ("code", "go"): ["package main\nfunc main() {\n\tx := 1\n}"],
    ("code", "c"): ["#include <stdio.h>\nint main(void) {\n  return 0;\n}"],
    ("code", "html"): ["<div class=\"x\">hello</div>", "<!DOCTYPE html>\n<html>"],
    ("code", None): ["foo(bar);\nbaz(1, 2);\nif (x) {\n}", "x = 1;\ny = 2;\nz += x;\n}"],
    ("plain", None): [
        "", "   \n", None, "A line of prose, and so on.", "make sure to tell them about it", "find the keys in the kitchen before you go", "open the window and let it be", "$5 for the coffee", "100% sure", "Buy milk\nBuy eggs",
        "```sh\nls -l\n```", "{}", "[]", "{not json", "- one\n- two\n- three", "Title: a thing", "https://example.org/a/b", "echo", "git", "hello", "The price is in the table, and it was 5 = 5.", "I think that we should go to the market now.",
        "sort of thing we want to do is this", "x" * 200_001, "note to self", "top of the morning to you", "key value\nother thing", "Dear all,\n\nthis is what we have to do.\nThe rest is for you.",
    ],
}


@pytest.mark.parametrize("want", PASTES, ids=lambda w: "-".join(map(str, w)))
def test_pastes(want):
    for text in PASTES[want]:
        assert P.pasted(text) == want, (text or "")[:80]


@pytest.mark.parametrize("text", ["x" * 199_000, "a-b " * 40_000 + "x", ("word, " * 300 + "\n") * 90, "(" * 100_000, "a(" * 900 + "x", " " * 1900 + "x", "a.b[" * 450, "select " * 280])
def test_pastes_take_linear_time(text):
    import time

    began = time.time()
    P.pasted(text)
    assert time.time() - began < 3


def test_pasteboard_types():
    assert P.pasted("$ git status", ("public.file-url",)) == ("plain", None)
    assert P.pasted("foo(bar);\nbaz(1);\nqux") == ("plain", None) and P.pasted("foo(bar);\nbaz(1);\nqux", ("public.source-code",)) == ("code", None)
    assert P.is_yaml(["a: 1", "   b: 2"]) is False and P.is_yaml(["a:", "  b: 2", " c: 3"]) is False and not P.is_yaml(["a: 1"])
    assert not P.is_json("[" * 100_000 + "]" * 100_000)


def test_pastes_of_rows(spark):
    rows = spark.createDataFrame([(t,) for t in ("$ ls -l", None, '{"a": 1}')], "t string").select(P.classified("t").alias("k")).select("k.*").collect()
    assert [tuple(r) for r in rows] == [("shell", "bash"), ("plain", None), ("code", "json")]


VOCABULARY = {w: k for k, w in enumerate("[PAD] [UNK] [CLS] [SEP] un ##aff ##able ##a ##f runn ##ing run the a b c ##b ##c , . ! 漢 字 é ##😀 😀 ab ##ab x ##x ' - ß".split())}


def plain_loop(text, vocabulary, limit=256, lower=True):
    """The same, a character and a word at a time."""
    t = ""
    for c in text or "":
        kind = unicodedata.category(c)
        if c in "\t\n\r" or kind == "Zs":
            t += " "
        elif c != "\ufffd" and kind not in ("Cc", "Cf", "Co", "Cs", "Zl", "Zp"):
            t += c
    if lower:
        t = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn")
    words, word = [], ""
    for c in t + " ":
        k = ord(c)
        chinese = any(lo <= k <= hi for lo, hi in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2F800, 0x2FA1F)))
        mark = 33 <= k <= 47 or 58 <= k <= 64 or 91 <= k <= 96 or 123 <= k <= 126 or unicodedata.category(c)[0] == "P"
        if c.isspace() or chinese or mark:
            words += [word] if word else []
            words += [c] if chinese or mark else []
            word = ""
        else:
            word += c
    ids = []
    for w in words:
        found, a = [], 0
        while a < len(w) and len(w) <= 200:
            e = next((e for e in range(len(w), a, -1) if ("##" if a else "") + w[a:e] in vocabulary), None)
            if e is None:
                break
            found.append(vocabulary[("##" if a else "") + w[a:e]])
            a = e
        ids += found if a == len(w) else [vocabulary["[UNK]"]]
    return [vocabulary["[CLS]"], *ids[: limit - 2], vocabulary["[SEP]"]]


def test_wordpiece_is_the_plain_loop(spark, sf):
    rng = random.Random(3)
    texts = ["Unaffable, running! the\tRUN", None, "", " \x00\u200b\ufffd", "漢字a b", "É é e\u0301", "😀😀 x", "a" * 201 + " " + "x" * 200, "ab" * 90, "ß-SS'"] + ["".join(rng.choice("abcxABé漢字 .,!\t\n😀'-\x85\xa0") for _ in range(rng.randrange(60))) for _ in range(300)]
    for limit, pad in ((256, False), (12, True)):
        rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", W.encoder(VOCABULARY, limit, pad)("t").alias("e")).select("k", "e.*").collect()
        for r in rows:
            want = plain_loop(texts[r.k], VOCABULARY, limit)
            assert r.ids == want + [0] * (limit - len(want) if pad else 0) and r["mask"] == [1] * len(want) + [0] * (limit - len(want) if pad else 0), texts[r.k]
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(40)
    names = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *sorted(r.w for r in W.vocabulary_of(docs, "text", 300).collect()), ".", ","]
    vocabulary = {w: k for k, w in enumerate(names)}
    for r in docs.select("text", W.encoder(vocabulary, 1 << 30)("text").alias("e")).collect():
        assert r.e.ids == plain_loop(r.text, vocabulary, 1 << 30)
    assert W.basic("Éa b", lower=False) == ["Éa", "b"]


def test_delays(spark):
    rows = [(1, None, 0.0), (1, None, 1.0), (3, None, 0.5), (99, None, 1.0), (0, None, 1.0), (5, 7.0, 0.3), (5, -2.0, 0.3), (5, 900.0, 0.3), (5, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "n int, told double, r double")
    assert [r[0] for r in df.select(retry_delay(F.col("n"), F.col("told"), F.col("r"))).collect()] == [0.75, 1.0, 3.5, 60.0, 1.0, 7.0, 0.0, 60.0, 16.0]


def test_stored_lists(spark):
    df = spark.createDataFrame([('["a", "b"]',), ("[]",), ('["open',), ('{"a": 1}',), ('"x"',), ("",), (None,), ('[null, "a"]',)], "t string")
    assert [r[0] for r in df.select(T.decoded_tags(F.col("t"))).collect()] == [["a", "b"], [], [], [], [], [], [], ["a"]]
    df = spark.createDataFrame([("A\x1fB",), ("A",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.decoded_path(F.col("t"))).collect()] == [["A", "B"], ["A"], [], []]


def test_catalog(spark):
    spark.range(3).createOrReplaceTempView("some_rows")
    try:
        assert {r.name: r.n for r in reports.catalog(spark).collect()}["some_rows"] == 3
    finally:
        spark.catalog.dropTempView("some_rows")
    assert reports.row_counts({"a": spark.range(2), "b": spark.range(0)}).orderBy("name").collect() == [("a", 2), ("b", 0)]
