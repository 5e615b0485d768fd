"""Queries that SQL can't express, on all rows of the tables against plain Python."""

import re

import pytest

from quernstone.functions import chunker, paste
from quernstone.functions import text as T
from quernstone.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def turns(spark, sf):
    return {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}


def plain_vector(text):
    v = [0.0] * 64
    for w in re.findall(r"\w+", (text or "").lower()):
        h = 0xCBF29CE484222325
        for byte in w.encode():
            h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        v[h % 64] += 1.0 if h >> 63 else -1.0
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else [1.0, *v[1:]]


def test_chunks(spark, sf, docs):
    got = {}
    for r in QUERIES["i1_chunks"](spark, sf).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r.doc_id, []).append({c: r[c] for c in chunker.NAMES})
    assert got == {i: found for i, t in docs.items() if (found := chunker.chunks(t))}
    for i, found in got.items():
        wide = docs[i].encode("utf-16-le")
        assert all(wide[2 * c["start"] : 2 * (c["start"] + c["length"])].decode("utf-16-le") == c["text"] and chunker.tokens(c["text"]) <= chunker.LIMIT for c in found)


def test_vectors(spark, sf, docs):
    got = {r.doc_id: r.vector for r in QUERIES["h22_hashed_embeddings"](spark, sf).collect()}
    assert set(got) == set(docs) and all(got[i] == pytest.approx(plain_vector(t), abs=1e-6) for i, t in docs.items())
    found = {(r.doc_id, r.ordinal): r.vector for r in QUERIES["k7_chunk_vectors"](spark, sf).collect()}
    want = {(i, k): plain_vector(c["text"]) for i, t in docs.items() for k, c in enumerate(chunker.chunks(t))}
    assert set(found) == set(want) and all(found[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_utf16_lengths(spark, sf, docs):
    assert {r.doc_id: r.length for r in QUERIES["utf16_lengths"](spark, sf).collect()} == {i: len(t.encode("utf-16-le")) // 2 for i, t in docs.items() if t is not None}


def test_pasted_kinds(spark, sf, turns):
    assert {(r.conv_id, r.turn): (r.kind, r.language) for r in QUERIES["h39_pasted_kinds"](spark, sf).collect()} == {k: paste.pasted(t) for k, t in turns.items()}


def test_near_words(spark, sf, docs):
    """All pairs of words within the tolerance, by a table for each pair of like length."""
    fold = lambda t: set(re.findall(r"[^\W_]+", T.folded(t or "")))
    asked = {w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in fold(r.text)}
    held = {w for t in docs.values() for w in fold(t)}
    from quernstone.operators.fuzzy import distances

    want = {}
    for q in asked:
        k = 0 if len(q) < 4 else 1 if len(q) < 8 else 2
        near = [w for w in held if k and w != q and abs(len(w.encode()) - len(q.encode())) <= k]
        d = distances([q.encode()] * len(near), [w.encode() for w in near])
        want |= {(q, w): int(x) for w, x in zip(near, d, strict=True) if x <= k}
    assert {(r.q, r.word): r.distance for r in QUERIES["h9_h10_near_words"](spark, sf).collect()} == want and len(want) > 100


def test_diffs_rebuild_their_texts(spark, sf, turns):
    """Each turn from the one before: the kept and added lines are the new text, the kept and removed ones the old."""
    got = {}
    for r in QUERIES["h42_i5_turn_diffs"](spark, sf).orderBy("conv_id", "turn", "pos").collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.op, r.line))
    counts = {(r.conv_id, r.turn): (r.added, r.removed) for r in QUERIES["d22_diff_counts"](spark, sf).collect()}
    unified = {(r.conv_id, r.turn): r["diff"] for r in QUERIES["l12_unified_diffs"](spark, sf).collect()}
    before = {}
    for (c, k), text in sorted(turns.items()):
        old, new, found = before.get(c) or "", text or "", got.get((c, k), [])
        before[c] = text
        assert "\n".join(x for o, x in found if o != "-") == new and "\n".join(x for o, x in found if o != "+") == old
        if found:
            assert counts[c, k] == (sum(o == "+" for o, _ in found), sum(o == "-" for o, _ in found))
        body = [x for x in unified[c, k].split("\n")[2:-1] if not x.startswith("@@")]
        assert [x for x in body if x[0] != " "] == [o + x for o, x in found if o != " "]


def test_plans_are_applied_and_undone(spark, sf, turns, docs):
    """Of every turn's plan: a new note with the turn's text, an addition, or a refusal with a reason."""
    rows = {}
    for r in QUERIES["k12_applied_plans"](spark, sf).collect():
        rows.setdefault(r.plan_id, []).append(r)
    assert set(rows) == {f"{c}-{k}" for c, k in turns}
    for (c, k), text in turns.items():
        found = rows[f"{c}-{k}"]
        if {r.status for r in found} & {"applied", "folder"}:
            made = [r for r in found if r.relpath == f"inbox/{c}.md" and r.status == "applied"]
            want = (text or "").strip() + "\n" if (text or "").strip() else ""
            assert len(made) == (1 if want else len(made)) and all(r.before is None and r.after == want for r in made)
        else:
            assert [r.status for r in found] in (["invalid"], ["conflict"], ["failed"])
    assert {r.outcome for r in QUERIES["k14_undone_plans"](spark, sf).collect()} <= {"trashed", "restored", "patched", "conflict"}


def test_every_other_query_without_sql_is_listed():
    """Queries without SQL have exact tests: here, or where this list says."""
    elsewhere = {
        "test_index.py": {"l1_l2_keyword_search", "l3_hybrid_chunks", "l3_hybrid_notes", "l11_hybrid_benchmark", "l8_candidates"}, "test_texts.py": {"h45_wordpiece"}, "test_autosave.py": {"j7_autosave"}, "test_state.py": {"j5_sessions"},
        "test_functions.py": {"h24_temporal_phrases"}, "test_search.py": {"l5_answers", "h41_added_lines", "h46_markdown_spans", "l9_contexts"}, "test_plans.py": {"l10_organised"}, "made anew, the same words": {"a14_synthetic_corpus"},
    }
    here = {"utf16_lengths", "i1_chunks", "h22_hashed_embeddings", "k7_chunk_vectors", "h39_pasted_kinds", "h9_h10_near_words", "h42_i5_turn_diffs", "d22_diff_counts", "l12_unified_diffs", "k12_applied_plans", "k14_undone_plans"}
    assert set(QUERIES) - set(ORACLE_SQL) == here.union(*elsewhere.values())
