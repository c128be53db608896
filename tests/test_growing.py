"""Plans and work of queries whose tables grow."""

from __future__ import annotations

from people import documents, fields, person, profiles

from formweave.operators import evaluate as E
from formweave.operators.mapping import attach_values, match_keys
from formweave.operators.retrieval import similar_pairs


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_and_decisions_are_never_broadcast(spark):
    golden = spark.createDataFrame(
        [("p", "https://x.example", [("#a", "basics.email")], ["#b"])],
        "page_id string, url string, fields array<struct<selector:string,canonical:string>>, expect_no_fill array<string>",
    )
    signals = spark.createDataFrame(
        [("p", "f0", 0, ["#a"], [(0, [("id", "a"), ("", "input")])])],
        "page_id string, ref string, pos int, selector_keys array<string>, "
        "elements array<struct<pos:int,attrs:array<struct<key:string,value:string>>>>",
    )
    decisions = spark.createDataFrame([("p", "f0", "basics.email", "m", "fill")], "page_id string, ref string, canonical string, value string, action string")
    judged = E.judge(golden, signals, decisions)
    assert "BroadcastHashJoin" not in plan_of(judged)
    assert {(r.selector, r.correct, r.forbidden) for r in judged.collect()} == {("#a", True, False), ("#b", False, False)}


def test_profiles_of_candidates_are_never_broadcast(spark):
    asked = fields(spark, {"f": {"label": "Email"}})
    valued = attach_values(match_keys(asked), profiles(spark, person("runa")), documents(spark))
    assert "BroadcastHashJoin" not in plan_of(valued)


def test_questions_and_saved_answers_are_never_broadcast(spark):
    side = spark.createDataFrame([("c", "which river would you measure first")], "grp string, text string")
    pairs = similar_pairs(side, side, 0.85)
    assert "BroadcastHashJoin" not in plan_of(pairs)
    assert [(r.text == r.other, r.score) for r in pairs.collect()] == [(True, 1.0)]


def test_profiles_are_dealt_out_before_their_values_are_made(spark):
    asked = fields(spark, {"f": {"label": "Email"}})
    plan = plan_of(attach_values(match_keys(asked), profiles(spark, person("runa")).coalesce(1), documents(spark)))
    assert [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line and "hashpartitioning(cand" in line]
