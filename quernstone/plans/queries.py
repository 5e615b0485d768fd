"""Queries over plans that the conversations table stands in for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..corpus import notes
from ..registry import query
from ..session import table
from . import plans as P
from .repair import repair


def made_up(spark, sf_dir):
    """A plan for each turn of a conversation: it makes a note, appends to one, and now and then does something wrong."""
    c = table(spark, sf_dir, "conversations")
    target = "case when conv_id % 3 = 0 then 'none/here.md' else 'src1/en/000000000001.md' end"
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("plan_id"), F.lit("tidy").alias("summary"), F.to_json(F.expr(
        f"array(named_struct('action', 'createNote', 'note', cast(null as string), 'path', 'inbox/' || conv_id || '.md', 'text', text), named_struct('action', case when conv_id % 5 = 0 then 'explode' else 'appendToNote' end, 'note', {target}, 'path', cast(null as string), 'text', text))")).alias("actions"),
        F.expr(f"case when conv_id % 7 = 0 then map({target}, 'stale') else cast(map() as map<string, string>) end").alias("preconditions"))


@query("i3_decoded_actions", """SELECT plan_id, action_index, action, known FROM (SELECT conv_id || '-' || turn AS plan_id, 0 AS action_index, 'createNote' AS action, true AS known FROM conversations
  UNION ALL SELECT conv_id || '-' || turn, 1, CASE WHEN conv_id % 5 = 0 THEN 'explode' ELSE 'appendToNote' END, conv_id % 5 <> 0 FROM conversations)""")
def decoded_actions(spark, sf_dir):
    return P.decode(made_up(spark, sf_dir)).select("plan_id", "action_index", "action", "known")


@query("i6_plan_issues", """WITH c AS (SELECT conv_id, conv_id || '-' || turn AS plan_id, text, EXISTS (SELECT 1 FROM documents WHERE doc_id = 1 AND source = 'src1' AND lang = 'en') AS there FROM conversations)
  SELECT plan_id, 1 AS action_index, 'warning' AS severity, 'unreadableAction' AS kind FROM c WHERE conv_id % 5 = 0
  UNION ALL SELECT plan_id, 0, 'error', 'unknownFolder' FROM c
  UNION ALL SELECT plan_id, 1, 'error', 'unknownNote' FROM c WHERE conv_id % 5 <> 0 AND (conv_id % 3 = 0 OR NOT there)
  UNION ALL SELECT plan_id, 0, 'warning', 'emptyContent' FROM c WHERE trim(text) = '' UNION ALL SELECT plan_id, 1, 'error', 'emptyContent' FROM c WHERE conv_id % 5 <> 0 AND trim(text) = ''""")
def plan_issues(spark, sf_dir):
    return P.issues(P.decode(made_up(spark, sf_dir)), notes(spark, sf_dir))


@query("i7_repaired_plans", """SELECT conv_id || '-' || turn AS plan_id, 1 AS action_index, 'createNote' AS action, 'inbox/' || conv_id || '.md' AS path, CAST(NULL AS VARCHAR) AS folder FROM conversations
  UNION ALL SELECT conv_id || '-' || turn, 2, CASE WHEN conv_id % 5 = 0 THEN 'explode' ELSE 'appendToNote' END, NULL, NULL FROM conversations
  UNION ALL SELECT conv_id || '-' || turn, 0, 'createFolder', NULL, 'inbox' FROM conversations""")
def repaired_plans(spark, sf_dir):
    return repair(P.decode(made_up(spark, sf_dir)), notes(spark, sf_dir))[0].select("plan_id", "action_index", "action", "path", "folder")


@query("i7_repair_findings", "SELECT conv_id || '-' || turn AS plan_id, 0 AS action_index, 'warning' AS severity, 'repairedMissingFolder' AS kind FROM conversations")
def repair_findings(spark, sf_dir):
    return repair(P.decode(made_up(spark, sf_dir)), notes(spark, sf_dir))[1]


@query("k12_applied_plans")
def applied_plans(spark, sf_dir):
    """Repaired plans, each applied to the notes as they are."""
    p, n = made_up(spark, sf_dir), notes(spark, sf_dir)
    return P.apply(repair(P.decode(p), n)[0], p, n)


@query("k14_undone_plans")
def undone_plans(spark, sf_dir):
    """Each applied change taken back where half of the notes have since got another line."""
    a = applied_plans(spark, sf_dir).where("relpath is not null")
    moved_on = F.when(F.pmod(F.xxhash64("plan_id"), F.lit(2)) == 0, F.concat("after", F.lit("\nlater"))).otherwise(F.col("after"))
    return P.undo(a.select("plan_id", "relpath", "before", "after", moved_on.alias("current")))
