"""Plans are rows, and only texts that are needed move."""

from pyspark.sql import functions as F

from quernstone.plans import plans as P

ACTIONS = "plan_id string, actions string, preconditions map<string,string>"


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_are_not_groups_of_their_own(spark):
    """Before, each plan was a pandas group, and all notes' texts were shuffled to those that plans name."""
    replies = spark.createDataFrame([(str(k), f'[{{"action": "createNote", "path": "x/{k % 30}.md", "text": "t{k}"}}, {{"action": "appendToNote", "note": "x/hot.md", "text": "more {k}"}}]', {}) for k in range(60)] + [
        (None, '[{"action": "moveSegment", "note": "x/5.md", "segment": "five", "to": "x/hot.md"}]', {})], ACTIONS)
    notes = spark.createDataFrame([(f"x/{k}.md", f"text five {k}") for k in range(10)] + [("x/hot.md", "hot"), ("x/none.md", None)], "relpath string, body string")
    actions = P.decode(replies)
    assert "CoGroup" not in explained(P.collisions(actions, notes))
    out = P.apply(actions, replies, notes)
    assert "CoGroup" not in explained(out)
    got = {}
    for r in out.collect():
        got.setdefault(r.plan_id, set()).add((r.status, r.relpath, r.before, r.after))
    for k in range(60):
        # a plan that would take a taken path is invalid as a whole
        assert got[str(k)] == ({("invalid", None, None, None)} if k % 30 < 10 else {("applied", f"x/{k % 30}.md", None, f"t{k}\n"), ("applied", "x/hot.md", "hot", f"hot\n\n---\n\nmore {k}\n")})
    assert set(got) == {None, *map(str, range(60))}


def test_texts_are_read_for_the_notes_that_are_there(spark):
    notes = spark.range(1000).select(F.format_string("%d.md", "id").alias("relpath"), F.repeat(F.lit("x"), 1000).alias("body"))
    paths = spark.createDataFrame([("7.md",), ("7.md",), ("no.md",), (None,)], "relpath string")
    held = P.texts_at(paths, notes)
    assert [(r.relpath, len(r.body)) for r in held.collect()] == [("7.md", 1000)] and "Exchange" not in explained(held)
