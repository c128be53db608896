"""Extraction, classification and the golden evaluation on our own pages."""

from __future__ import annotations

import pytest
from people import EXPLICIT, answer, answers, document, documents, fields, from_records, person, profiles
from pyspark.sql import functions as F

from formweave.operators import evaluate as E
from formweave.operators import extract as X
from formweave.operators.classify import classify_forms
from formweave.operators.mapping import map_fields

WHY = "What makes this team interesting to you?"

BOARD = """<html><head><title>Job Application for Data Engineer at Fabrikam</title></head><body>
<article class="posting">""" + "We move parcels and data around the globe. " * 8 + """</article>
<form id="application_form"><label for="first_name">Given <b>name</b> *</label><input id="first_name" aria-required="true">
<label for="last_name">Family</label><input id="last_name"><label for="email">Mail</label><input id="email" type="email">
<label for="phone">Phone</label><input id="phone" type="tel"><label for="resume">CV</label>
<input type="file" id="resume" accept=".pdf,.docx">
<label for="q1">Are you legally authorized to work in Norway? *</label>
<select id="q1" name="job_application[answers_attributes][0][boolean_value]"><option value="">Choose<option value="1">Yes
<option value="0">No</select>
<h3>Voluntary self identification</h3><label for="job_application_gender">Gender</label>
<select id="job_application_gender" name="job_application[gender]"><option value="">Choose</option><option value="1">Male</option>
<option value="3">Decline To Self Identify</option></select></form>
<iframe src="https://jobs.ashbyhq.com/fabrikam/embed"></iframe></body></html>"""

SECOND = f"""<html><body><form><div class="q"><div class="t">Full name ✱</div><div class="f"><input name="name"></div></div>
<div class="q"><div class="t">Email ✱</div><div><input type="email" name="email"></div></div>
<div class="q"><div class="t">Employer</div><div><input name="org"></div></div>
<div class="q"><div class="t">Profile</div><div><input name="urls[LinkedIn]"></div></div>
<div class="q"><div class="t">{WHY}</div><div><textarea name="cards[x][field0]"></textarea></div></div>
<div class="q"><div class="t">Race</div><div><select name="eeo[race]"><option value="">-</option>
<option>Decline to self-identify</option></select></div></div></form></body></html>"""

THIRD = """<div><form><div><label for="_systemfield_name">Name *</label><input id="_systemfield_name" required></div>
<div><label for="_systemfield_location">Where</label><input id="_systemfield_location" role="combobox"></div>
<div><label for="z">Do you require visa sponsorship to work here? *</label>
<input id="z" role="combobox" aria-controls="zl"><div id="zl" role="listbox"><div role="option" data-value="y">Yes</div>
<div role="option" data-value="n">No</div></div></div></form></div>"""

OPEN = """<html><head><title>Analyst | Contoso</title></head><body><h1>Apply</h1><form name="apply">
<input autocomplete="given-name" aria-label="Vorname"><input autocomplete="section-a family-name" placeholder="Nachname">
<label>E-mail <input type="email"></label>
<h2>Education</h2><label for="es">Start date</label><input id="es" type="month"><label for="gd">Graduation date</label>
<input id="gd" placeholder="DD/MM/YYYY"><h2>Other</h2>
<fieldset><legend>Will you now or in the future require sponsorship? *</legend><label><input type="radio" name="sp" value="y"> Yes</label>
<label><input type="radio" name="sp" value="n" checked> No</label></fieldset>
<div>Which of the following skills do you use? <label><input type="checkbox" name="sk" value="sv"> Surveying</label>
<label><input type="checkbox" name="sk" checked> Kriging</label></div>
<label for="min">Minimum salary (EUR)</label><input id="min" type="number">
<label for="cc">Country code</label><select id="cc"><option value="a">Austria (+43)</option><option value="b">Switzerland (+41)</option></select>
<label for="dino">Best dinosaur</label><input id="dino">
<label><input type="checkbox" id="ok"> I certify that all of this is true</label>
<input type="text" style="display:none" id="gone"><input type="file" id="up" style="display:none" aria-label="Cover letter">
<input type="hidden" name="csrf"><button>Send</button></form></body></html>"""

PAGES = [
    {"page_id": "board", "url": "https://boards.greenhouse.io/fabrikam/jobs/1", "html": BOARD},
    {"page_id": "second", "url": "https://jobs.lever.co/northwind/abc/apply", "html": SECOND},
    {"page_id": "third", "url": "https://jobs.ashbyhq.com/tailspin/1", "html": THIRD},
    {"page_id": "open", "url": "https://www.contoso.example/careers/analyst", "html": OPEN},
    {"page_id": "story", "url": "https://news.example/x", "html": "<main>no form <input></main>"},
]


def label(selector, canonical):
    return {"selector": selector, "canonical": canonical, "kind": "text"}


GOLDEN = [
    {"page_id": "board", "url": PAGES[0]["url"], "expect_no_fill": [], "fields": [
        label("#first_name", "basics.firstName"), label("#last_name", "basics.lastName"), label("#email", "basics.email"),
        label("#phone", "basics.phone"), label("#resume", "attachments.resume"), label("#q1", "preferences.workAuth"),
        label("#job_application_gender", "eeo.gender")]},
    {"page_id": "second", "url": PAGES[1]["url"], "expect_no_fill": [], "fields": [
        label('input[name="name"]', "basics.fullName"), label('input[name="email"]', "basics.email"),
        label('input[name="org"]', "work.company"), label('input[name="urls[LinkedIn]"]', "links.linkedin"),
        label('textarea[name="cards[x][field0]"]', "custom.what makes this team interesting to you"),
        label('select[name="eeo[race]"]', "eeo.race")]},
    {"page_id": "third", "url": PAGES[2]["url"], "expect_no_fill": [], "fields": [
        label("#_systemfield_name", "basics.fullName"), label("#_systemfield_location", "location.full"),
        label("#z", "preferences.requiresSponsorship")]},
    {"page_id": "open", "url": PAGES[3]["url"], "expect_no_fill": ["#dino", "#ok"], "fields": [
        label("#es", "education.start"), label("#gd", "education.end"),
        label('input[name="sp"]', "preferences.requiresSponsorship"), label('input[name="sk"]', "skills.list"),
        label("#min", "preferences.salaryMin"), label("#cc", "basics.phoneCountryCode"),
        label("#up", "attachments.coverLetter")]},
]
GOLDEN_SCHEMA = """page_id string, url string, fields array<struct<selector:string,canonical:string,kind:string>>,
expect_no_fill array<string>"""


@pytest.fixture(scope="module")
def nodes(spark):
    pages = from_records(spark, PAGES, "page_id string, url string, html string")
    return X.page_nodes(X.with_form_controls(pages)).cache()


@pytest.fixture(scope="module")
def signals(nodes):
    return X.form_signals(nodes, inline_styles=True).cache()


@pytest.fixture(scope="module")
def found(signals):
    return {(r.page_id, r.selector): r for r in signals.collect()}


def test_gate_skips_pages_without_forms(found):
    assert {page for page, _ in found} == {"board", "second", "third", "open"}


@pytest.mark.parametrize("page,selector,expected", [
    ("board", "#first_name", dict(label="Given name", label_source="label-for", required=True, ats="greenhouse")),
    ("board", "#resume", dict(kind="file", accept=".pdf,.docx", section_heading=None)),
    ("board", "#job_application_gender", dict(kind="select", section_heading="Voluntary self identification")),
    ("second", 'input[name="name"]', dict(label="Full name", label_source="geometric", ats="lever")),
    ("third", "#z", dict(kind="aria_combobox", widget_hint="ashby_combobox",
                         options=[("y", "Yes"), ("n", "No")])),
    ("third", "#zl", dict(kind="aria_listbox", options=[("y", "Yes"), ("n", "No")])),
    ("open", "#es", dict(kind="date", section_heading="Education")),
    ("open", 'input[name="sp"][value="y"]', dict(
        kind="radio_group", label="Will you now or in the future require sponsorship? *", required=True, current_value="n",
        options=[("y", "Yes"), ("n", "No")], group_id="apply::sp",
        member_selectors=['input[name="sp"][value="y"]', 'input[name="sp"][value="n"]'])),
    ("open", 'input[name="sk"][value="sv"]', dict(
        kind="multiselect", options=[("sv", "Surveying"), ("Kriging", "Kriging")], group_id="apply::cb::sk")),
    ("open", "#ok", dict(kind="checkbox", label="I certify that all of this is true", current_value="false")),
    ("open", "#gone", dict(visible=False)),
    ("open", "#up", dict(visible=True, label="Cover letter", label_source="aria-label")),
    ("open", "#cc", dict(current_value="a")),
])
def test_signal(found, page, selector, expected):
    row = found[(page, selector)]
    plain = lambda v: [tuple(x) if isinstance(x, tuple) else x for x in v] if isinstance(v, list) else v
    assert {k: plain(row[k]) for k in expected} == expected


def test_document_order_and_unique_refs(signals):
    rows = signals.filter("page_id = 'open'").orderBy("pos").collect()
    assert [r.ref for r in rows] == [f"top:f{i}" for i in range(len(rows))]


def test_label_fallbacks(found):
    rows = sorted((r for (p, _), r in found.items() if p == "open"), key=lambda r: r.pos)[:3]
    assert [(r.label, r.label_source) for r in rows] == [
        ("Vorname", "aria-label"), ("Nachname", "placeholder"), ("E-mail", "label-for")]


def test_job_description_and_embedded_board(nodes):
    jd = {r.page_id: r.jd_text for r in X.job_descriptions(nodes).collect()}
    assert set(jd) == {"board"} and jd["board"].startswith("We move parcels") and not jd["board"].endswith(" ")
    assert [tuple(r) for r in X.embedded_boards(nodes).collect()] == [
        ("board", "https://jobs.ashbyhq.com/fabrikam/embed", "ashby")]


def test_latest_scan_of_each_frame(spark):
    scans = spark.createDataFrame(
        [("p", "top", 1, "a"), ("p", "top", 2, "b"), ("p", "top/0", 1, "c"), ("p", "top", 2, "d")],
        "page_id string, frame_path string, scan_us long, ref string")
    assert sorted(r.ref for r in X.merge_frames(scans).collect()) == ["b", "c", "d"]


def test_golden_gates(spark, signals):
    asked = signals.withColumn("cand", F.lit("runa")).withColumn("date_format_hint", F.lit("MM/DD/YYYY"))
    asked = asked.withColumn("company", F.lit(None).cast("string")).withColumn("role", F.lit(None).cast("string"))
    decisions = map_fields(
        asked, profiles(spark, person("runa", EXPLICIT)), answers(spark, answer("runa", "s1", WHY, "The people.")),
        documents(spark, document("runa", "d1", "resume", "okoye-cv.pdf"), document("runa", "d2", "coverLetter", "c.pdf")),
    )
    golden = from_records(spark, GOLDEN, GOLDEN_SCHEMA)
    judged = E.judge(golden, signals, decisions).cache()
    assert E.mistakes(judged).collect() == []
    rows = {(r.ats, r.page_id): r for r in E.scores(judged).collect()}
    total = rows[(None, None)]
    assert (total.labels, total.detected, total.forbidden) == (23, 23, 0) and total.precision == 1.0
    assert total.filled == 23
    assert rows[("greenhouse", None)].labels == 7
    gate = E.gates(E.scores(judged)).first()
    assert gate.recall_ok and gate.precision_ok and gate.forbidden_ok


# one page a rule of the scoring table, its edges, and sums around the threshold; each has two fields that score nothing besides
PLAIN = [{"label": "Lantern"}, {"label": "Rope"}]
QUIET = ("https://mast.example/y", "Mast")
FILE = {"label": "Chart", "kind": "file"}
PLACES = [{"label": x} for x in ("First name", "Last name", "City", "Country", "LinkedIn")]
SCORES = {
    "nothing": (*QUIET, [], 0),
    "file named a resume": (*QUIET, [{**FILE, "label": "Resume"}], 3),
    "file for documents": (*QUIET, [{**FILE, "accept": ".doc"}], 3),
    "file for pictures": (*QUIET, [{**FILE, "accept": ".png"}], 1),
    "both kinds of file": (*QUIET, [FILE, {**FILE, "accept": ".doc"}], 3),
    "one known": (*QUIET, PLACES[:1], 0),
    "two known": (*QUIET, PLACES[:2], 1),
    "three known": (*QUIET, PLACES[:3], 2),
    "four known": (*QUIET, PLACES[:4], 2),
    "five known": (*QUIET, PLACES, 3),
    "unseen": (*QUIET, [{**f, "visible": False} for f in PLACES], 0),
    "sensitive": (*QUIET, [{"label": "Gender"}], 2),
    "mail by kind": (*QUIET, [{"label": "Gull", "kind": "email"}], 1),
    "mail by autocomplete": (*QUIET, [{"label": "Gull", "autocomplete": "email"}], 1),
    "address": ("https://mast.example/careers/9", "Mast", [], 2),
    "title": ("https://mast.example/y", "Jobs on board", [], 1),
    "address before title": ("https://mast.example/careers/9", "Jobs on board", [], 2),
    "coupon": (*QUIET, [{"label": "Coupon"}], -4),
    "two negatives count once": (*QUIET, [{"label": "Coupon"}, {"label": "Password"}], -4),
    "five": ("https://mast.example/careers/9", "Mast", [{**FILE, "accept": ".doc"}], 5),
    "six": ("https://mast.example/careers/9", "Mast", [{**FILE, "accept": ".doc"}, {"label": "Gull", "kind": "email"}], 6),
    "six less four": ("https://mast.example/careers/9", "Mast", [{**FILE, "accept": ".doc"}, {"label": "Gull", "kind": "email"}, {"label": "Coupon"}], 2),
}


def test_form_classifier(spark):
    cases = {f"{p}/{i}": {"page_id": p, **f} for p, (_, _, fs, _) in SCORES.items() for i, f in enumerate(PLAIN + fs)}
    cases["alone/0"] = {"page_id": "alone", **FILE, "accept": ".doc"}
    of = {p: (u, t) for p, (u, t, *_) in SCORES.items()} | {"alone": ("https://mast.example/careers/9", "Mast")}
    pages = spark.createDataFrame([(p, u, t) for p, (u, t) in of.items()], "page_id string, url string, title string")
    got = {r.page_id: r for r in classify_forms(pages, fields(spark, cases)).collect()}
    assert {p: got[p].score for p in SCORES} == {p: s for p, (*_, s) in SCORES.items()}
    assert {p for p, r in got.items() if r.is_application} == {p for p, (*_, s) in SCORES.items() if s >= 6}
    assert got["six less four"].reasons == ["+3 resume/CV upload field", "+1 email field", "+2 application-like URL", "-4 password/payment fields present"]
    assert (got["alone"].score, got["alone"].reasons) == (0, ["fewer than 2 visible fields"])


def test_few_controls_and_empty_for(spark):
    html = {
        "none": "<p>Nothing to fill in</p>",
        "one": "<label for=''>Cookie notice</label><input type=email placeholder='Your mail'>",
        "two": "<label for=''>Cookie notice</label><label for=q>Boat</label><input id=q><input aria-label=Harbour>",
        "list": "<div role=listbox aria-label=Tide></div>",
    }
    pages = spark.createDataFrame([(p, "https://x.example/", h) for p, h in html.items()], "page_id string, url string, html string")
    found = {}
    for r in X.form_signals(X.page_nodes(pages)).collect():
        found.setdefault(r.page_id, []).append(r.label)
    assert {p: sorted(labels) for p, labels in found.items()} == {"one": ["Your mail"], "two": ["Boat", "Harbour"], "list": ["Tide"]}
    assert {r.page_id for r in X.with_form_controls(pages).collect()} == {"two"}
