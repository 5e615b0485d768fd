"""Keyword and hybrid search, answers and writers on small libraries, against brute force or exact rows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quernstone.functions import notes as N
from quernstone.functions import text as T
from quernstone.functions.stopwords import SEARCHED
from quernstone.operators import answers, fuzzy, hybrid, keyword, organise
from quernstone.operators.index import Index
from quernstone.sources import writers
from quernstone.streaming import sessions as S

DAY = datetime(2024, 1, 1)
NOTES = [
    (1, "Docker compose", "Docker notes about compose files and images"), (2, "docker", "short"), (3, "My docker setup", "how to set it up"), (4, "Undockered", "nothing"),
    (5, "Dokcer", "a slip"), (6, "Garden", "docker appears in the body only, docker twice"), (7, "curl", "curl -H application/json"), (8, "Déjà vu", "accents"),
]


def library(spark):
    return spark.createDataFrame([(i, t, f"{t}.md", DAY + timedelta(days=i), b, "") for i, t, b in NOTES], "id long, title string, relpath string, mtime timestamp_ntz, body string, folder_path string")


def found(spark, *texts, limit=25):
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    out = {}
    for r in keyword.search(Index.build(library(spark)), q, limit).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.source, r.score))
    return out


def test_keyword_ladder(spark):
    got = found(spark, "docker", "DEJA", "pplication/js", "", "crul", "zzz")
    by = {i: (s, x) for i, s, x in got[0]}
    assert by[2] == ("titleExact", 1000.0) and by[1] == ("titlePrefix", 899.2) and by[3] == ("titleWord", 850.0) and by[4] == ("titleSubstring", 800.0)
    assert by[5] == ("titleFuzzy", 660.0) and by[6][0] == "body" and 500 < by[6][1] <= 580
    assert got[1][0][:2] == (8, "titlePrefix") and got[2] == [(7, "bodySubstring", 450.0)]
    assert [i for i, *_ in got[3]] == [8, 7, 6, 5, 4, 3, 2, 1] and got[3][0][1] == "recent"
    assert got[4][0][:2] == (7, "titleFuzzy") and 5 not in got


def plain_osa(a, b):
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            d[i, j] = i + j if not i or not j else min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_bit_parallel_distances():
    rng = random.Random(9)
    a, b = ([bytes(rng.choice(b"abc\xc3\xa9") for _ in range(rng.randint(0, rng.choice((5, 30, 64))))) for _ in range(400)] for _ in range(2))
    want = [plain_osa(x, y) for x, y in zip(a, b, strict=True)]
    assert fuzzy.distances(a, b).tolist() == want and fuzzy.distances([], []).tolist() == []
    assert [fuzzy.osa(x, y, 99) for x, y in zip(a, b, strict=True)] == want
    long = [bytes(rng.choice(b"ab") for _ in range(rng.randint(65, 150))) for _ in range(8)]
    assert all(fuzzy.osa(x, y, 999) == plain_osa(x, y) for x in long for y in long)


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 20))) for _ in range(150)} | {"kitten", "sitting", "titles of notes and more", "titels of notse and more", "a longer title than this one"}
    words |= {w[:3] + w[4:] for w in list(words) if len(w) > 5} | {w[:2] + w[3:4] + w[2:3] + w[4:] for w in list(words) if len(w) > 6}
    words |= {w.replace("a", "é").replace("b", "漢") for w in list(words)[:80]} | {"ñandú", "ñandu", "nandú", "naïveté", "naiveté", "naïvete"}
    d = spark.createDataFrame([(w,) for w in words], "w string")
    got = {(r.q, r.w): r.distance for r in fuzzy.near_pairs(d.withColumnRenamed("w", "q"), d, "q", "w").collect()}
    want = {}
    for q in words:
        k = 0 if len(q) < 4 else 1 if len(q) < 8 else 2
        for w in words:
            if k and q != w and (x := plain_osa(q.encode(), w.encode())) <= k:
                want[q, w] = x
    assert got == want and len(want) > 50
    assert fuzzy.osa("crul", "curl", 1) == 1 and fuzzy.osa("ca", "abc", 3) == 3 and fuzzy.osa("abcdef", "abc", 2) is None


def test_hybrid(spark):
    n = library(spark)
    q = spark.createDataFrame([(1, "compose images"), (2, "dokcer compoze"), (3, "docker from 2024 last month")], "query_id long, text string")
    now = F.lit("2024-02-01 12:00:00").cast("timestamp_ntz")
    chunks, notes = hybrid.candidates(q, Index.build(n, substrings=False, chunks=True), now)
    top = {r.query_id: r.note_id for r in notes.where("rank = 1").collect()}
    assert top[1] == 1 and {r.query_id for r in chunks.collect()} == {1, 2, 3}
    # the range of the third query leaves all notes in, an excluded folder none
    assert hybrid.candidates(q, Index.build(n.withColumn("folder_path", F.lit("x/y")), substrings=False, chunks=True), now, exclude=("x",))[0].count() == 0
    vocabulary = spark.createDataFrame([("docker", 5), ("docket", 1), ("compose", 2)], "term string, df long")
    fixed = hybrid.repairs(spark.createDataFrame([(1, "the dockar compose xq")], "query_id long, text string"), vocabulary).orderBy("nth").collect()
    assert [(r.term, r.correction) for r in fixed] == [("dockar", "docker")]
    row = spark.createDataFrame([("Fix dockar, dockars!", ["dockar"], ["docker"])], "t string, a array<string>, b array<string>")
    assert row.select(hybrid.rewritten("t", "a", "b")).first()[0] == "Fix docker, dockars!"


RANKED = [
    (1, 1, 11, 1, "prose", "restart the web server with care", 0.5), (1, 2, 12, 1, "code", "ctx\n\n```sh\nsystemctl restart web\n```\n", 0.45), (1, 3, 13, 2, "code", "```\nls\n```", 0.44),
    (2, 1, 21, 3, "code", "```\nmake all\n```", 1.0), (2, 2, 22, 4, "prose", "other words", 0.5), (3, 1, 31, 5, "prose", "nothing alike", 1.0),
]


def ranked(spark):
    return spark.createDataFrame([(*r, f"t{r[3]}", f"n{r[3]}.md") for r in RANKED], "query_id long, rank int, chunk_id long, note_id long, kind string, text string, score double, title string, relpath string")


def test_answers(spark):
    q = spark.createDataFrame([(1, "restart web server"), (2, "unrelated question"), (3, "quantum physics")], "query_id long, text string")
    assert {r.query_id: (r.chunk_id, r.why) for r in answers.offline_cards(ranked(spark), q, SEARCHED).collect()} == {1: (12, "code"), 2: (21, "margin")}
    assert {r.query_id: r.chunk_id for r in answers.local_choice(ranked(spark)).collect()} == {1: 12, 2: 21, 3: 31}
    replies = spark.createDataFrame([(1, '{"best_chunk_id": 2, "snippet": "systemctl restart web", "confidence": "high", "ranked_chunk_ids": [3, 9, 3]}'), (2, '{"best_chunk_id": 1, "snippet": "rm -rf /", "confidence": "certain"}'), (3, "no")], "query_id long, input string")
    assert {r.query_id: (r.chunk_id, r.snippet, r.confidence) for r in answers.answers(ranked(spark), replies).collect()} == {1: (12, "systemctl restart web", "high"), 2: (21, "make all", "low")}
    notes = spark.createDataFrame([(1, 1, 1), (1, 7, 2), (1, 2, 3)], "query_id long, note_id long, rank int")
    assert [(r.note_id, r["rank"]) for r in answers.reranked(notes, ranked(spark), replies).orderBy("rank").collect()] == [(2, 1), (7, 2)]
    assert N.shown("prose", "First.\n\nSecond.") == "First." and N.fenced_body("a\n~~~\nx\n```\n~~~") == "x\n```" and N.limited("1\n2\n3", 2) == "1\n2\n…"
    assert N.verbatim("  a\nb", "x\n a\n\n  b\n") and not N.verbatim("", "x")


def test_note_functions(spark):
    row = lambda *c: tuple(spark.range(1).select(*c).first())
    lit = F.lit
    assert row(N.appended(lit(" new "), lit("old\n\n")), N.appended(lit("new"), lit(" ")), N.appended(lit(""), lit(""))) == ("old\n\n---\n\nnew\n", "new\n", "")
    assert row(N.without_segment(lit("mid"), lit("head\nmid\ntail")), N.without_segment(lit("x"), lit("abc")), N.without_segment(lit("all"), lit("all"))) == ("head\n\ntail", None, "")
    assert row(N.added_lines(lit("a\nb\nc"), lit("a\nX\nY\nc")), N.added_lines(lit(""), lit("n")), N.added_lines(lit("a"), lit("a")), N.added_lines(lit("a"), lit("a\na"))) == ("X\nY", "n", "", "a")
    assert row(N.merged_tags(F.array(lit("A"), lit(" b ")), F.array(lit("a"), lit(""), lit("c"))))[0] == ["A", "b", "c"]
    assert row(N.label_only(lit("## Recipe:"), lit("about gardens")), N.label_only(lit("gardens"), lit("about Gardens")), N.label_only(lit("one two three four five"), lit(""))) == (True, False, False)
    assert N.clean_title("  ..a/b:c\n d\u200b. ") == "a-b-c d" and N.clean_title(" . ") == "Untitled" and len(N.clean_title("é" * 300).encode()) == 200
    text = N.rendered_front_matter({"id": "x", "created": "2024", "tags": ["a", "b, c", "true"]}, "other: 1")
    assert text == '---\nid: x\ncreated: 2024\ntags: [a, "b, c", "true"]\nother: 1\n---\n' and T.front_matter(text + "body")["body"] == "body"


def test_diffs():
    a = "\n".join(f"line {k}" for k in range(30))
    b = a.replace("line 5", "five").replace("line 25", "x\ny")
    d = T.line_diff(a, b)
    assert [c["line"] for c in d if c["op"] != "+"] == a.split("\n") and [c["line"] for c in d if c["op"] != "-"] == b.split("\n") and len(T.hunks(d)) == 2
    assert T.patched(a, d) == b and T.patched("new head\n" + a, d) == "new head\n" + b and T.patched(b, d, reverse=True) == a and T.patched("else", d) is None
    assert T.unified("a\nb", "a\nc") == "--- before\n+++ after\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n" and T.unified(a, a) == ""
    rng = random.Random(1)
    for _ in range(200):
        x, y = ("\n".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        d = T.line_diff(x, y)
        kept = sum(c["op"] == " " for c in d)

        def lcs(p, q):
            t = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
            for i, u in enumerate(p):
                for j, v in enumerate(q):
                    t[i + 1][j + 1] = t[i][j] + 1 if u == v else max(t[i][j + 1], t[i + 1][j])
            return t[-1][-1]

        assert kept == lcs(x.split("\n") if x else [], y.split("\n") if y else []) and T.patched(x, d) == y
    long = "\n".join(map(str, range(3000)))
    assert len(T.line_diff(long, "\n".join(map(str, range(3000, 6000))))) == 6000


def test_echoes(spark):
    at = lambda s: DAY + timedelta(seconds=s)
    own = [("a", "h", at(0)), ("a", "h", at(5)), ("b", "h", at(0)), ("c", None, at(0))]
    changes = [(1, "a", "h", at(-10)), (2, "a", "h", at(6)), (3, "a", "h", at(7)), (4, "a", "h", at(8)), (5, "b", "h", at(31)), (6, "c", None, at(3)), (7, "b", "x", at(1))]
    got = S.without_echoes(spark.createDataFrame(changes, "n long, relpath string, content_hash string, ts timestamp"), spark.createDataFrame(own, "relpath string, content_hash string, recorded_at timestamp"))
    assert {r.n for r in got.collect()} == {1, 4, 5, 7}


def test_an_operation_explains_many_changes(spark, same_rows, tmp_path):
    import duckdb

    at = lambda s: DAY + timedelta(seconds=s)
    rows = [(3, 1, "click", at(0)), (4, 1, "click", at(2)), (5, 1, "click", at(4)), (7, 1, "click", at(21)), (6, 2, None, at(0)), (8, 2, None, at(1)), (9, None, "view", at(0))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as from '{tmp_path}/events.parquet/*.parquet'")
    registered = __import__("__spark_entry__")
    got = registered.queries()["j3_echo_suppression"](spark, str(tmp_path))
    assert {r.event_id for r in got.collect()} == {6, 7, 8, 9}
    assert same_rows(got, con.sql(registered.oracle_sql()["j3_echo_suppression"])) == 4


def test_writers(spark, tmp_path):
    root = str(tmp_path)
    taken = spark.createDataFrame([("x/Plan.md",), ("x/plan 2.md",)], "relpath string")
    new = spark.createDataFrame([(1, "x", "Plan"), (2, "x", "Plan"), (3, "", "Plan"), (4, "x", "a/b")], "id long, folder_path string, title string")
    named = writers.free_names(new, taken)
    assert {r.id: r.relpath for r in named.collect()} == {1: "x/Plan 3.md", 2: "x/Plan 4.md", 3: "Plan.md", 4: "x/a-b.md"}
    assert writers.save(named.select("relpath", F.lit("text").alias("text")), root) == 4 and (tmp_path / "x/Plan 3.md").read_text() == "text"
    writers.delete(spark.createDataFrame([("Plan.md",)], "relpath string"), root)
    assert not (tmp_path / "Plan.md").exists() and (tmp_path / ".trash/Plan.md").exists() and not list(tmp_path.rglob("*.part"))
    try:
        writers.save(spark.createDataFrame([("../x.md", "t")], "relpath string, text string"), root)
        raise AssertionError
    except ValueError:
        pass
    c = spark.createDataFrame([(1, "x/Plan.md", "x", "Plan", "mine", "theirs", datetime(2024, 5, 6, 7, 8)), (2, "q.md", "", "q", "same", "same", None), (3, "r.md", "", "r", "mine", None, None)], "id long, relpath string, folder_path string, title string, mine string, theirs string, theirs_at timestamp")
    assert {(r.id, r.relpath, r.text, r.kind) for r in writers.conflict_copies(c, taken).collect()} == {(1, "x/Plan.md", "mine", "saved"), (1, "x/Plan (external edit 2024-05-06 0708).md", "theirs", "copy"), (3, "r.md", "mine", "saved")}


def test_contexts_fit_the_budget(spark):
    added = spark.createDataFrame([(1, "new line")], "session_id long, added string")
    found_ = spark.createDataFrame([(1, k, k) for k in range(1, 4)], "session_id long, id long, rank int")
    bodies = spark.createDataFrame([(k, f"t{k}", f"{k}.md", "x" * 8000) for k in range(1, 4)], "id long, title string, relpath string, body string")
    for budget, rung in ((10_000, 0), (2_500, 1), (400, 3), (10, 4)):
        r = organise.contexts(added, found_, bodies, budget).first()
        assert r.rung == rung and (r.tokens <= budget or rung == 4), (budget, r.rung, r.tokens)


def test_reports_and_corpora(spark, tmp_path):
    from quernstone.sources import reports

    m = spark.createDataFrame([("a|b", 0.5, None)], "category string, top1 double, note string")
    assert reports.markdown_table(m) == "| category | top1 | note |\n|---|---|---|\n| a\\|b | 0.500 |  |\n"
    reports.write_json(m, f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").first().top1 == 0.5
    g, d = spark.createDataFrame([("a.md", "g")], "relpath string, text string"), spark.createDataFrame([("a.md", "d"), ("b.md", "d")], "relpath string, text string")
    assert {tuple(r) for r in reports.corpus(g, d).collect()} == {("a.md", "g", True), ("b.md", "d", False)}
    e = spark.createDataFrame([(1, "c", "t", 5, 6, 3), (2, "c", "t", 5, 5, 1), (3, "c", "t", 5, None, None)], "query_id long, category string, text string, wanted long, found long, rank int")
    assert [r.query_id for r in reports.failures(e).collect()] == [3, 1]

    class Text:
        name = "text"

        def can_read(self, path):
            return path.endswith(".txt")

        def notes(self, spark, path):
            return spark.read.text(path)

    assert reports.importer_for("a.txt", [Text()]).name == "text"


def test_stream_of_files(spark, tmp_path):
    import time

    from quernstone.sources import reports

    root, seen, watch = tmp_path / "notes", [], reports.Progress()
    (root / "_assets").mkdir(parents=True)
    (root / "a.md").write_text("one")
    (root / "_assets" / "x.md").write_text("no")
    spark.streams.addListener(watch)
    q = reports.file_changes(spark, str(root)).queryName("files").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda b, n: seen.extend(r.relpath for r in b.select("relpath").collect())).start()
    try:
        for name in ("", "b.md"):
            if name:
                (root / name).write_text("two")
            for _ in range(100):
                if len(seen) >= (2 if name else 1):
                    break
                time.sleep(0.3)
        assert sorted(seen) == ["a.md", "b.md"]
    finally:
        q.stop()
        time.sleep(1)
        spark.streams.removeListener(watch)
    assert watch.batches.get("files", 0) >= 1 and watch.error is None


def test_markdown_spans():
    from quernstone.functions.markup import KINDS, styled

    text = "# Head *it* #\n> quote\n- [x] **b** and `co*de*`\n1. ~~s~~ ***bi***\n---\n😀 [t](u)\n```py\n*no*\n```\nsnake_case_word"
    wide = text.encode("utf-16-le")
    got = [(s["kind"], wide[2 * s["start"] : 2 * (s["start"] + s["length"])].decode("utf-16-le"), s["detail"]) for s in styled(text)]
    for want in [("heading", "Head *it*", "1"), ("italic", "it", None), ("blockQuote", "quote", None), ("listMarker", "-", None), ("taskMarker", "[x]", "checked"), ("bold", "b", None), ("inlineCode", "co*de*", None), ("listMarker", "1.", None),
                 ("strikethrough", "s", None), ("boldItalic", "bi", None), ("thematicBreak", "---", None), ("link", "t", None), ("linkURL", "u", None), ("codeFence", "```py", None), ("codeLanguage", "py", "py"), ("codeBlock", "*no*", None), ("codeFence", "```", None)]:
        assert want in got, want
    assert {k for k, *_ in got} == set(KINDS) and not any(t in ("de", "no", "case") for k, t, _ in got if k in ("italic", "bold"))
    assert styled(None) == [] and [s["kind"] for s in styled("```\nopen *x*")] == ["codeFence", "codeBlock"]
