"""Retrieval and merging of saved answers against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from people import answer, answers

from formweave.operators import answers as A
from formweave.operators import retrieval as R
from formweave.operators.answers import save_answers
from formweave.operators.tracker import answers_after_use


def words(s):
    return set(s.split())


def grams(s):
    p = f" {s} "
    return {p[i:i + 3] for i in range(len(p) - 2)} if s else set()


def jac(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def fuzzy(a, b):
    return max(jac(words(a), words(b)), jac(grams(a), grams(b)))


VOCAB = "why do you want to work here tell us about your notice period salary team role a b remote start".split()


def phrases(n, seed, longest=12):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.5:
            base = rnd.choice(out).split()
            k = rnd.randrange(3)
            if k == 0:
                base.insert(rnd.randrange(len(base) + 1), rnd.choice(VOCAB))
            elif k == 1 and len(base) > 1:
                base.pop(rnd.randrange(len(base)))
            else:
                i = rnd.randrange(len(base))
                base[i] = base[i] + rnd.choice(["", "s", "x"])
            out.append(" ".join(base))
        else:
            out.append(" ".join(rnd.choice(VOCAB) for _ in range(rnd.randint(1, longest))))
    return out


@pytest.mark.parametrize("t,tokens,longest", [(0.85, True, 12), (0.92, False, 12), (0.85, True, 45), (0.6, True, 6)])
def test_similarity_join_loses_nothing(spark, monkeypatch, t, tokens, longest):
    monkeypatch.setattr(R, "PART_ROWS", 7)  # so that frequent elements are dealt out in parts on both sides
    left, right = sorted(set(phrases(150, 1, longest))), sorted(set(phrases(150, 2, longest) + phrases(40, 1, longest)))
    df = lambda rows: spark.createDataFrame([("g", r) for r in rows], "grp string, text string")
    got = {(r.text, r.other): r.score for r in R.similar_pairs(df(left), df(right), t, tokens).collect()}
    score = fuzzy if tokens else (lambda a, b: jac(grams(a), grams(b)))
    want = {(a, b): score(a, b) for a in left for b in right if score(a, b) >= t}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_similarity_join_with_very_long_texts(spark):
    """A line of 5,000 words, the same with some words less, and short ones."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(5000)]
    left = [" ".join(words), "notice period", "a"]
    right = [" ".join(words[:4700]), " ".join(words[:2000]), " ".join(words[1:]), "notice periods", "a", ""]
    df = lambda rows: spark.createDataFrame([("g", r) for r in rows], "grp string, text string")
    got = {(r.text, r.other): r.score for r in R.similar_pairs(df(left), df(right), 0.85).collect()}
    want = {(a, b): fuzzy(a, b) for a in left for b in right if fuzzy(a, b) >= 0.85}
    assert len(want) == 4 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_no_job_runs_while_the_join_is_planned(spark):
    df = spark.createDataFrame([("g", "why here"), ("g", "why there")], "grp string, text string")
    spark.sparkContext.setJobGroup("planning", "similar_pairs")
    try:
        pairs = R.similar_pairs(df, df, 0.85)
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("planning") == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {(r.text, r.other) for r in pairs.collect()} == {("why here",) * 2, ("why there",) * 2}


def test_retrieval_and_dedup(spark):
    saved = answers(
        spark,
        answer("c", "a1", "Why do you want to work here?", "x"),
        answer("c", "a2", "What is your notice period?", "x", aliases=["current notice period"]),
        answer("c", "a0", "Notice", "x", aliases=["current notice period"]),
        answer("d", "d1", "Why do you want to work here?", "y"),
    )
    asked = ["why do you want to work here", "why do you really want to work here", "describe your leadership style",
             "current notice period", "what is your notice periods", ""]
    qs = spark.createDataFrame([("c", q) for q in asked], "cand string, key string")
    got = {r.key: (r.id, r.source, round(r.score, 3)) for r in R.retrieve_answers(qs, saved).collect()}
    assert got == {
        asked[0]: ("a1", "answer-exact", 1.0), asked[1]: ("a1", "answer-fuzzy", 0.875),
        asked[3]: ("a0", "answer-exact", 1.0), asked[4]: ("a2", "answer-fuzzy", round(fuzzy(asked[4], "what is your notice period"), 3)),
    }
    dup = {r.key: r.id for r in R.find_duplicates(qs, saved).collect()}
    assert dup == {asked[0]: "a1", asked[3]: "a0", **({asked[4]: "a2"} if jac(grams(asked[4]), grams("what is your notice period")) >= 0.92 else {})}


def fold(saves, start):
    """One save after the other."""
    book = [dict(a, alias_keys=list(a["alias_keys"])) for a in start]
    for s in sorted(saves, key=lambda s: (s["ts_us"], s["seq"])):
        key = " ".join("".join(c.lower() if c.isalnum() else " " for c in s["question"]).split())
        hit = next((a for a in book if a["normalized_key"] == key or key in a["alias_keys"]), None)
        if hit is None:
            best = 0.0
            for a in book:
                sc = jac(grams(key), grams(a["normalized_key"]))
                if sc >= 0.92 and sc > best + 1e-12:
                    hit, best = a, sc
        if hit is None:
            book.append(dict(id=f"{s['cand']}-{s['seq']}", normalized_key=key, alias_keys=[], answer=s["answer"],
                             question_text=s["question"], last_used_us=s["ts_us"], times_used=0, created_us=s["ts_us"]))
            continue
        if hit["normalized_key"] != key and key not in hit["alias_keys"]:
            hit["alias_keys"].append(key)
        hit.update(answer=s["answer"], question_text=s["question"], last_used_us=s["ts_us"])
    return book


def test_saving_equals_one_after_the_other(spark):
    rnd = random.Random(5)
    base = "please describe in some detail the most interesting project of your professional career so far number "
    questions = [base + str(rnd.randrange(10, 40)) + "!" * rnd.randrange(3) for _ in range(60)] + [
        p.capitalize() + "?" for p in phrases(60, 9)]
    saves = [dict(cand="c", seq=i, ts_us=rnd.randrange(50), question=q, answer=f"t{i}") for i, q in enumerate(questions)]
    start = [answer("c", "a1", base + "12", "old"), answer("c", "a2", "Why do you want to work here?", "old", aliases=["motive"])]
    got = save_answers(
        spark.createDataFrame([tuple(s.values()) for s in saves], "cand string, seq long, ts_us long, question string, answer string"),
        answers(spark, *start),
    ).collect()
    shape = lambda a: (a["id"], a["normalized_key"], list(a["alias_keys"]), a["answer"], a["question_text"], a["last_used_us"],
                       a["created_us"])
    assert sorted(shape(r) for r in got) == sorted(shape(a) for a in fold(saves, start))


def test_usage_counts_and_learnt_aliases(spark):
    saved = answers(spark, answer("c", "a1", "q key", "x", aliases=["old"]), answer("c", "a2", "other", "x"))
    uses = spark.createDataFrame(
        [("c", "a1", 5, 0, "new b", True), ("c", "a1", 3, 1, "new a", True), ("c", "a1", 4, 2, "seen", False),
         ("c", "a1", 6, 3, "new b", True), ("c", "a1", 7, 4, "q key", True)],
        "cand string, answer_id string, ts_us long, seq long, question_key string, confirmed_fuzzy boolean")
    got = {r.id: r for r in answers_after_use(saved, uses).collect()}
    assert (got["a1"].times_used, got["a1"].last_used_us, got["a1"].alias_keys) == (5, 7, ["old", "new a", "new b"])
    assert got["a2"].times_used == 0


def test_keys_with_one_first_save_are_one_answer_and_others_stay_alone(spark):
    schema = "cand string, seq string, ts_us long, question string, answer string"
    saves = [
        ("c", "s1", 5, "Notice period?", "a"), ("c", "s1", 5, "Which river would you measure", "b"), ("c", "s2", 6, "notice PERIOD", "later"),
        ("c", "s3", 7, "Salary", "x"), ("c", "s3", 7, "salary", "y"), ("d", "s1", 5, "Notice period", "d"), (None, "s1", 5, "nobody", "n"),
        ("c", "s4", 8, None, "n"), ("c", "a9", 9, "Old id", "n"),
    ]
    existing = [answer("c", "c-a9", "something quite different", "old"), answer("e", "e1", "untouched", "u")]
    got = {
        r.id: (r.cand, r.normalized_key, list(r.alias_keys), r.answer, r.question_text, r.created_us, r.last_used_us)
        for r in save_answers(spark.createDataFrame(saves, schema), answers(spark, *existing)).collect()
    }
    assert got["c-s1"] == ("c", "notice period", ["which river would you measure"], "later", "notice PERIOD", 5, 6)
    assert got["c-s3"] == ("c", "salary", [], "y", "salary", 7, 7)
    assert got["d-s1"] == ("d", "notice period", [], "d", "Notice period", 5, 5)
    assert got["c-a9"][:4] == ("c", "something quite different", ["old id"], "n") and got["e1"][3] == "u"
    assert len(got) == 5


def test_a_key_is_sent_once_before_it_is_compared(spark):
    """Old code sent each key to both sides and wrote it with its question to a checkpoint."""
    rows = [("c", f"s{i}", i, f"Question {i} of the long list: describe in your own words which unusual project, team or customer taught you most about planning work, finding errors early", "a") for i in range(40)]
    saves = spark.createDataFrame(rows, "cand string, seq string, ts_us long, question string, answer string")
    keyed = saves.withColumn("key", F.lower("question"))
    pairs = A._similar_before(keyed, answers(spark), 0.92)
    want = {(a, b) for _, _, i, a, _ in rows for _, _, j, b, _ in rows if j < i and jac(grams(a.lower()), grams(b.lower())) >= 0.92}
    assert {(r.key, r.other) for r in pairs.collect()} == {(a.lower(), b.lower()) for a, b in want} and len(want) > 5
    assert not pairs.filter("fixed").count()
