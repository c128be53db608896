"""Instructions, outcomes and the histories they feed."""

from __future__ import annotations

from people import document, documents, fields, options
from pyspark.sql import functions as F

from formweave.operators import answers as A
from formweave.operators import fill as L
from formweave.operators import tracker as K

DECISIONS = """cand string, page_id string, ref string, canonical string, source string, value string,
option struct<value:string,text:string>, options_multi array<struct<value:string,text:string>>, checked boolean,
document_id string, confidence double, action string, reason string, saved_answer_id string"""
ROWS = {
    "text": ("k", "lexicon", "v", None, None, None, None, "fill", None),
    "option": ("k", "lexicon", "Yes", ("1", "Yes"), None, None, None, "fill-amber", None),
    "multi": ("k", "lexicon", "A", None, [("a", "A")], None, None, "fill", None),
    "check": ("k", "lexicon", None, None, None, False, None, "fill", None),
    "file": ("k", "adapter", "cv.pdf", None, None, None, "d1", "fill-amber", None),
    "lost": ("k", "adapter", "cv.pdf", None, None, None, "d9", "fill-amber", None),
    "review": ("k", "answer-fuzzy", "Maybe", None, None, None, None, "review", "a1"),
    "blank": (None, None, None, None, None, None, None, "abstain", None),
    "answer": ("k", "answer-fuzzy", "x", None, None, None, None, "fill-amber", "a2"),
}


def decisions(spark):
    return spark.createDataFrame(
        [("runa", "p1", ref, c, s, v, o, m, ch, d, 0.9, a, "r", sa) for ref, (c, s, v, o, m, ch, d, a, sa) in ROWS.items()], DECISIONS)


def signals(spark):
    kinds = {"option": "select", "review": "select", "multi": "multiselect", "check": "checkbox", "file": "file", "lost": "file"}
    return fields(spark, {r: {"kind": kinds.get(r, "text"), "selector": f"#{r}", "label": f"Label {r}", "visible": r != "blank",
                              **({"options": options(("y", "Yes"), ("n", "No way"))} if r in ("option", "review") else {})} for r in ROWS})


def overrides(spark, *rows):
    return spark.createDataFrame([("runa", "p1", *r) for r in rows], "cand string, page_id string, ref string, value string, included boolean, save boolean")


def test_instructions(spark):
    out = L.instructions(decisions(spark), signals(spark), documents(spark, document("runa", "d1", "resume", "cv.pdf")))
    got = {r.ref: (r.payload.type, r.amber) for r in out.collect()}
    assert got == {"text": ("text", False), "option": ("option", True), "multi": ("multi", False), "check": ("check", False),
                   "file": ("file", True), "review": ("text", True), "answer": ("text", True)}


def test_overrides_and_attempts(spark):
    o = overrides(spark, ("review", "no way!", True, False), ("option", "", False, False), ("blank", "z", True, False))
    targets = L.fill_targets(decisions(spark), o)
    assert {r.ref for r in targets.select("ref").collect()} == {"text", "option", "multi", "check", "file", "lost", "review", "answer"}
    tried = spark.createDataFrame([("runa", "p1", "top", "#text")], "cand string, page_id string, frame_path string, selector string")
    out = L.reviewed_instructions(targets, signals(spark), documents(spark, document("runa", "d1", "resume", "cv.pdf")), tried)
    got = {r.ref: (r.payload.type, r.payload.option_value) for r in out.collect()}
    assert got == {"option": ("option", "1"), "multi": ("multi", None), "check": ("check", None), "file": ("file", None),
                   "review": ("option", "n"), "answer": ("text", None)}


def test_outcomes_counts_and_uses(spark):
    outcomes = spark.createDataFrame(
        [("runa", "p1", "text", True, True, None), ("runa", "p1", "answer", True, False, None), ("runa", "p1", "file", False, False, "boom"),
         ("runa", "p1", "review", True, True, None)],
        "cand string, page_id string, ref string, ok boolean, verified boolean, error string")
    rows = L.classify_outcomes(decisions(spark), outcomes)
    got = {r.ref: r.outcome for r in rows.collect()}
    assert (got["text"], got["file"], got["blank"], got["option"]) == ("filled", "failed", "abstain", "abstain")
    s = L.fill_stats(rows).first()
    assert (s.field_count, s.filled, s.failed, s.reviewed, s.abstained) == (9, 2, 1, 1, 1)
    a = L.action_counts(decisions(spark), signals(spark)).first()
    assert (a.ready, a.review, a.abstained) == (7, 1, 0)
    changed = overrides(spark, ("review", "other", True, False))
    uses = L.answer_uses(rows, signals(spark), changed).collect()
    assert [(u.answer_id, u.label, u.confirmed_fuzzy) for u in uses] == [("a2", "Label answer", True)]
    ticked = overrides(spark, ("review", "Own words", True, True), ("blank", "", True, True), ("text", "", False, True))
    saves = A.saves_from_review(decisions(spark), signals(spark), ticked).collect()
    assert sorted((r.question, r.answer) for r in saves) == [("Label review", "Own words"), ("Label text", "v")]


CHANGE = """cand string, seq long, ts_us long, op string, url string, ats string, title string, jd string, field_count long,
filled long, reviewed long, failed long, status string, reminder_days int"""


def change(seq, op, url="https://x.example/a?q=1", title="", jd=None, status=None, days=None, n=0):
    return ("c", seq, seq * 10, op, url, "lever", title, jd, n, n, n, n, status, days)


def test_history_of_one_url(spark):
    rows = [change(1, "status", status="offer"), change(2, "detected", title="First", jd="J1"), change(3, "filled", n=4), change(4, "filled", title="T" * 300, n=7),
            change(5, "detected", jd="J2"), change(6, "status", status="interviewing"), change(7, "reminder", days=2),
            change(8, "applied", url="https://X.example/b#f"), change(9, "reminder", url="https://x.example/b", days=0),
            change(10, "status", url="https://x.example/never", status="offer"),
            change(11, "filled", url="https://x.example/gone", n=1), change(12, "delete", url="https://x.example/gone"),
            change(13, "detected", url="https://x.example/gone", title="Back")]
    got = {r.url: r for r in K.applications(spark.createDataFrame(rows, CHANGE)).collect()}
    assert set(got) == {f"https://x.example/{p}" for p in ("a", "b", "gone")}
    a, b, gone = (got[f"https://x.example/{p}"] for p in ("a", "b", "gone"))
    assert (a.id, a.title, a.jd_snippet, a.status, a.times_filled, a.filled) == ("c-2", "T" * 200, "J1", "interviewing", 2, 7)
    assert a.first_seen_us == 20 and a.last_filled_us == 40 and a.reminder_us == 70 + 2 * K.US_PER_DAY
    assert (b.status, b.reminder_us) == ("applied", None)
    assert (gone.times_filled, gone.first_seen_us, gone.title, gone.status) == (0, 130, "Back", "saved")
    due = K.reminders_due(K.applications(spark.createDataFrame(rows, CHANGE)), 10**15).collect()
    assert [d.message for d in due] == ["T" * 200 + ". You planned to follow up on this application today."]


def test_page_past_the_end_shows_the_last(spark):
    apps = spark.range(40).select(F.lit("c").alias("cand"), F.col("id").cast("string").alias("id"), F.col("id").alias("first_seen_us"))
    apps = apps.unionByName(spark.createDataFrame([("d", "x", 1)], "cand string, id string, first_seen_us long"))
    page = K.history_page(apps, page=9)
    assert sorted((r.cand, r.page, r.n) for r in page.groupBy("cand", "page").agg(F.count("*").alias("n")).collect()) == [("c", 2, 10), ("d", 0, 1)]


def test_outcomes_without_a_day_or_a_domain(spark):
    rows = [(0, "a", "x"), (None, "a", "x"), (None, None, "x"), (0, None, None)]
    entries = spark.createDataFrame(rows, "at_us long, domain string, ats string").withColumn(
        "outcomes", F.array(F.struct(F.lit("lexicon").alias("source"), F.lit("filled").alias("outcome")))
    )
    got = K.outcome_rates(entries, "source").collect()
    assert sorted((str(r.day), r.source, r.fields, r.filled) for r in got) == [("0", "lexicon", 2, 2), ("None", "lexicon", 2, 2)]
    got = K.outcome_rates(entries, "domain", "ats", totals=True).collect()
    assert {(r.day, r.domain, r.ats, r.n_summed): r.fields for r in got} == {
        (0, "a", "x", 0): 1, (0, "a", None, 1): 1, (0, None, None, 0): 1, (0, None, None, 1): 1, (0, None, None, 2): 2,
        (None, "a", "x", 0): 1, (None, "a", None, 1): 1, (None, None, "x", 0): 1, (None, None, None, 1): 1, (None, None, None, 2): 2,
    }
    assert len(got) == 10
