from quernstone.plans.plans import decode
from quernstone.plans.repair import _plans, repair


def test_a_plan_is_a_row_with_only_the_texts_it_takes_from(spark):
    """Before, each plan was a group of its own for Python, with the text of every note that it named."""
    replies = spark.createDataFrame([
        ("a", '[{"action": "moveSegment", "note": "x/a.md", "segment": "not there", "to": "x/b.md"}, {"action": "appendToNote", "note": "x/b.md", "text": "t"}]'),
        ("b", '[{"action": "createNote", "path": "new/n.md", "text": "t"}]'), (None, '[{"action": "createNote", "path": "x/a.md", "text": "t", "tags": ["k"]}]'),
    ], "plan_id string, actions string")
    notes = spark.createDataFrame([("x/a.md", "one"), ("x/b.md", "two"), ("y/c.md", None)], "relpath string, body string")
    plans = _plans(decode(replies), notes)
    assert "CoGroup" not in plans._jdf.queryExecution().executedPlan().toString()
    got = {r.plan_id: (len(r.actions), sorted(r.taken or []), r.folders or [], [tuple(b) for b in r.bodies or []]) for r in plans.collect()}
    assert got == {"a": (2, ["x/a.md", "x/b.md"], ["x"], [("x/a.md", "one")]), "b": (1, [], [], []), None: (1, ["x/a.md"], ["x"], [])}
    actions, findings = repair(decode(replies), notes)
    assert sorted((r.plan_id or "", r.action_index, r.kind) for r in findings.collect()) == [("", 0, "repairedCollision"), ("a", 0, "repairedMerge"), ("b", 0, "repairedMissingFolder")]
    assert sorted((r.plan_id or "", r.action_index, r.action, r.tags) for r in actions.collect()) == [("", 0, "appendToNote", None), ("", 1, "tagNote", ["k"]), ("a", 0, "appendToNote", None), ("a", 1, "appendToNote", None), ("b", 0, "createFolder", None), ("b", 1, "createNote", None)]
