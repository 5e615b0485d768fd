from datetime import datetime, timedelta

import pytest

from quernstone.functions import text as T
from quernstone.functions.temporal import parse
from quernstone.operators.fuzzy import tolerance
from quernstone.operators.search import one_edit
from quernstone.plans.plans import undone

NOW = datetime(2024, 2, 1, 12)  # a Thursday


def day(y, m, d, n=1):
    return datetime(y, m, d), datetime(y, m, d) + timedelta(days=n)


@pytest.mark.parametrize(
    "text, span",
    [
        ("notes from yesterday", day(2024, 1, 31)),
        ("last night", (datetime(2024, 1, 31, 18), datetime(2024, 2, 1, 6))),
        ("this morning", (datetime(2024, 2, 1), datetime(2024, 2, 1, 12))),
        ("three days ago", day(2024, 1, 29)),
        ("2 weeks ago", day(2024, 1, 15, 7)),
        ("a month ago", day(2024, 1, 1, 31)),
        ("last week", day(2024, 1, 22, 7)),
        ("this year", day(2024, 1, 1, 366)),
        ("on thursday", day(2024, 2, 1)),
        ("since friday", day(2024, 1, 26)),
        ("May 3rd", day(2023, 5, 3)),
        ("the 12th of March", day(2023, 3, 12)),
        ("in december", day(2023, 12, 1, 31)),
    ],
)
def test_phrases(text, span):
    found = parse(text, NOW)
    assert (found["start"], found["end"]) == span and not found["soft"]


def test_phrase_is_taken_out():
    assert parse("budget from last week", NOW)["stripped"] == "budget"
    assert parse("yesterday", NOW)["stripped"] == "yesterday"
    assert parse("recently seen", NOW)["soft"]
    assert parse("Feb 31", NOW)["start"] is None
    assert parse(None, NOW)["stripped"] == ""


def test_front_matter():
    f = T.front_matter("﻿---\r\nid: \"x1\"\ntags: [a, 'b']\nother: 1\n---\nbody\n")
    assert (f["id"], f["tags"], f["body"]) == ("x1", ["a", "b"], "body\n")
    assert T.front_matter("---\ntags:\n- a\n- b\n...\nrest")["tags"] == ["a", "b"]
    assert T.front_matter("---\nid: open")["body"] == "---\nid: open"
    assert T.front_matter(None)["body"] == ""


def test_diff_and_undo():
    a, b = "one\ntwo\nthree", "one\n2\nthree\nfour"
    change = T.line_diff(a, b)
    assert T.patched(a, change) == b and T.patched(b, change, reverse=True) == a
    assert undone(a, b, b) == ("restored", a)
    assert undone(a, b, "zero\n" + b) == ("patched", "zero\n" + a)
    assert undone(a, b, "something else") == ("conflict", "something else")
    assert undone(None, "new", "new") == ("trashed", None)
    assert undone("old", None, None) == ("recreated", "old")


def test_edits(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("crul", "curl", True), ("abc", "abc", True), ("abc", "abcd", True), ("abc", "acb", True), ("abc", "bca", False), ("abcd", "ab", False)], "a string, b string, want boolean")
    for r in rows.withColumn("got", one_edit(F.col("a"), F.col("b"))).collect():
        assert r.got == r.want, r
    assert [r[0] for r in spark.range(10).select(tolerance(F.col("id"))).collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def test_paths(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a//b/./c/../d.md",), ("../x",), ("",)], "p string")
    assert [r[0] for r in rows.select(T.normal_path(F.col("p"))).collect()] == ["a/b/d.md", "x", ""]
