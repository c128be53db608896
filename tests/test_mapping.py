"""The cascade, options, constraints and gates on single fields."""

from __future__ import annotations

import pytest
from people import EXPLICIT, answer, answers, document, documents, fields, options, person, profiles

from formweave.operators.mapping import attach_values, map_fields
from formweave.operators.profiles import profile_values

GENDER = options(("1", "Woman"), ("2", "Man"), ("3", "Nonbinary"), ("9", "Prefer not to answer"))
YES_NO = options(("j", "Yes"), ("n", "No"))
WHY = "Which of our rivers would you measure first?"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"

CASES = {
    "adapter": {"ats": "greenhouse", "id_attr": "first_name", "label": "Box 12"},
    "token": {"autocomplete": "section-x shipping given-name", "label": "---"},
    "lexicon": {"label": "Your LinkedIn page"},
    "nothing": {"label": "Best glacier"},
    "no_value": {"label": "GitHub name"},
    "eeo_unset": {"kind": "select", "label": "Gender", "options": GENDER},
    "eeo_set": {"cand": "set", "kind": "select", "label": "Gender", "options": GENDER},
    "sponsor": {"cand": "set", "kind": "radio_group", "options": YES_NO,
                "label": "Would you need sponsorship to take up this post?"},
    "salary_unset": {"label": "Desired salary per year"},
    "salary_answer": {"cand": "teo", "label": "Desired salary per year"},
    "consent": {"kind": "checkbox", "label": "I consent to the storage of this form"},
    "not_offered": {"cand": "set", "kind": "select", "options": options(("?", "Ask me later")),
                    "label": "Are you eligible to work in this canton?"},
    "country": {"kind": "select", "label": "Country",
                "options": options(("AT", "Austria"), ("CH", "Switzerland"))},
    "dial": {"kind": "select", "label": "Country code",
             "options": options(("a", "Austria (+43)"), ("s", "Switzerland (+41)"))},
    "exact": {"cand": "teo", "kind": "textarea", "label": WHY},
    "fuzzy": {"cand": "teo", "kind": "textarea", "label": "Which of our many rivers would you measure first?"},
    "far": {"cand": "teo", "kind": "textarea", "label": "Name a bridge you like"},
    "alias": {"cand": "teo", "label": "Where to begin (required)"},
    "custom": {"cand": "teo", "ats": "greenhouse", "label": "Tell of a gauge you built",
               "name_attr": "job_application[answers_attributes][0][text_value]"},
    "standard": {"cand": "set", "ats": "greenhouse", "label": "Length of your notice period",
                 "name_attr": "job_application[answers_attributes][1][text_value]"},
    "template": {"cand": "teo", "kind": "textarea", "label": "Your letter to us", "company": "Pegel Werke", "role": "Gauge Keeper"},
    "template_open": {"cand": "teo", "kind": "textarea", "label": "Your letter to us", "company": "Pegel Werke"},
    "file": {"cand": "set", "kind": "file", "label": "Resume/CV", "id_attr": "resume", "ats": "greenhouse"},
    "file_none": {"kind": "file", "label": "Resume/CV"},
    "file_mismatch": {"cand": "teo", "kind": "file", "label": "Your CV", "accept": ".pdf"},
    "file_star": {"cand": "set", "kind": "file", "label": "cover", "accept": "image/*, application/*"},
    "too_long": {"cand": "teo", "kind": "textarea", "label": "Anything else about you", "max_length": 100},
    "hidden": {"label": "Email", "visible": False},
    "date": {"label": "Start date", "section_heading": "Work Experience", "placeholder": "MM/YYYY"},
    "date_input": {"label": "Start date", "section_heading": "Education", "kind": "date"},
    "ended": {"label": "End date", "section_heading": "Employment"},
    "skills": {"kind": "multiselect", "label": "Which of the following skills have you used in the field?",
               "options": options(("d", "Diving"), ("k", "Kriging"), ("s", "Surveying"))},
    "skills_none": {"kind": "multiselect", "label": "Skills", "options": options(("w", "Welding"))},
    "skills_text": {"label": "Skills"},
    "salary_min": {"cand": "set", "kind": "number", "label": "Minimum salary (CHF)"},
    "salary_min_unset": {"kind": "number", "label": "Minimum salary"},
    "not_number": {"kind": "number", "label": "Full name"},
    "box": {"kind": "checkbox", "label": "City"},
}


@pytest.fixture(scope="module")
def decided(spark):
    people = profiles(spark, person("runa"), person("teo"), person("set", EXPLICIT))
    saved = answers(
        spark,
        answer("teo", "a1", WHY, "The Thur, for its floods.", aliases=["where to begin"]),
        answer("teo", "a2", "Desired salary per year", "CHF 104,000"),
        answer("teo", "a3", "Tell of a gauge you built", "A float in a well."),
        answer("teo", "a4", "Your letter to us", "{company} measures well, and so would I as {Role}."),
        answer("teo", "a5", "Anything else about you", "y" * 101),
    )
    docs = documents(
        spark,
        document("set", "d1", "resume", "okoye-cv.pdf"),
        document("set", "d3", "coverLetter", "letter.pdf"),
        document("teo", "d2", "resume", "teo-cv.docx", DOCX),
    )
    return {r.ref: r for r in map_fields(fields(spark, CASES), people, saved, docs).collect()}


# name -> members the decision must have
EXPECTED = {
    "adapter": dict(canonical="basics.firstName", source="adapter", value="Runa", action="fill", confidence=1.0),
    "token": dict(canonical="basics.firstName", source="autocomplete", action="fill", confidence=0.978),
    "lexicon": dict(canonical="links.linkedin", value="https://linkedin.com/in/runa-okoye", confidence=0.91),
    "nothing": dict(action="abstain", canonical=None, reason="no rule, token, lexicon or saved answer matched"),
    "no_value": dict(action="abstain", canonical="links.github", reason="no profile value for links.github"),
    "eeo_unset": dict(action="review", canonical="eeo.gender", value=None),
    "eeo_set": dict(action="fill-amber", option=("9", "Prefer not to answer")),
    "sponsor": dict(canonical="preferences.requiresSponsorship", option=("n", "No"), action="fill-amber"),
    "salary_unset": dict(action="review", canonical="preferences.salary"),
    "salary_answer": dict(action="fill-amber", canonical="preferences.salary", value="CHF 104,000", source="answer-exact"),
    "consent": dict(action="review", canonical=None, reason="consent checkboxes always need you"),
    "not_offered": dict(action="review", option=None, reason='"Yes" is not among this field\'s options'),
    "country": dict(option=("CH", "Switzerland"), action="fill"),
    "dial": dict(option=("s", "Switzerland (+41)"), value="+41", action="fill-amber",
                 reason="matched the field label (closest option)", confidence=0.76),
    "exact": dict(source="answer-exact", value="The Thur, for its floods.", action="fill", confidence=0.955,
                  canonical="custom.which of our rivers would you measure first"),
    "fuzzy": dict(source="answer-fuzzy", action="fill-amber", saved_answer_id="a1"),
    "far": dict(action="abstain"),
    "alias": dict(source="answer-exact", saved_answer_id="a1"),
    "custom": dict(source="answer-exact", value="A float in a well."),
    "standard": dict(canonical="preferences.noticePeriod", value="10 weeks"),
    "template": dict(value="Pegel Werke measures well, and so would I as Gauge Keeper.", action="fill"),
    "template_open": dict(action="review", saved_answer_id="a4",
                          reason="couldn't detect the company/role for your template answer"),
    "file": dict(document_id="d1", action="fill-amber", reason="will attach okoye-cv.pdf"),
    "file_none": dict(action="abstain", reason="no resume stored in your vault"),
    "file_mismatch": dict(action="review", reason="form wants .pdf but your resume is teo-cv.docx"),
    "file_star": dict(document_id="d3", action="fill-amber", canonical="attachments.coverLetter"),
    "too_long": dict(action="review", reason="answer exceeds the field's 100-character limit"),
    "hidden": dict(action="abstain", reason="field not visible"),
    "date": dict(canonical="work.start", value="11/2022"),
    "date_input": dict(canonical="education.start", value="2015-02-01"),
    "ended": dict(action="abstain", canonical="work.end"),
    "skills": dict(canonical="skills.list", options_multi=[("s", "Surveying"), ("k", "Kriging")],
                   value="Surveying, Kriging", action="fill"),
    "skills_none": dict(action="review", reason="none of your values match this field's options"),
    "skills_text": dict(value="Surveying, Kriging", action="fill"),
    "salary_min": dict(canonical="preferences.salaryMin", value="88000", action="fill-amber"),
    "salary_min_unset": dict(action="review", canonical="preferences.salaryMin"),
    "not_number": dict(action="review", reason="this field needs a number"),
    "box": dict(action="review", reason="checkbox needs a yes/no answer"),
}


@pytest.mark.parametrize("name", EXPECTED)
def test_decision(decided, name):
    got = decided[name].asDict(recursive=False)
    plain = lambda v: [tuple(x) for x in v] if isinstance(v, list) else tuple(v) if isinstance(v, tuple) else v
    assert {k: plain(got[k]) for k in EXPECTED[name]} == EXPECTED[name]


def test_every_field_decided_once(decided):
    assert set(decided) == set(CASES)


def test_values_and_documents_of_a_candidate_with_most_fields(spark):
    """Fields of one candidate, a third of all, meet their values in split partitions, whole."""
    hot = [{"cand": "set" if i % 3 == 0 else "teo" if i % 2 else f"c{i % 50}"} for i in range(3000)]
    keys = ["basics.email", "eeo.gender", "attachments.resume", "attachments.coverLetter", "work.school", None]
    rows = [(f["cand"], f"p{i}", str(i), "text" if i % 7 else "file", keys[i % len(keys)]) for i, f in enumerate(hot)]
    # a candidate without a name, and one with documents only
    rows += [(None, "n", "0", "text", "basics.email"), ("doc", "n", "1", "file", "attachments.resume")]
    matched = spark.createDataFrame(rows, "cand string, page_id string, ref string, kind string, rule_key string").repartition(8)
    people = profiles(spark, person("set", EXPLICIT), person("teo"), *[person(f"c{i}") for i in range(50)])
    papers = documents(spark, document("set", "d1", "resume", "a.pdf"), document("set", "d2", "coverLetter", "b.pdf"),
                       document("doc", "d3", "resume", "c.pdf"))
    values = {(r.cand, r.key): r.text for r in profile_values(people).collect()}
    given = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    }
    before = {k: spark.conf.get(k, None) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        out = attach_values(matched, people, papers)
        got = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert "skew=true" in plan
    assert len(got) == len(rows) and {r.ref for r in got if r.page_id != "n"} == {r[2] for r in rows[:-2]}
    stored = {("set", "resume"): "d1", ("set", "coverLetter"): "d2", ("doc", "resume"): "d3"}
    for r in got:
        assert r.p_text == (None if r.is_file else values.get((r.cand, r.rule_key)))
        assert (r.doc.id if r.doc else None) == (stored.get((r.cand, r.doc_role)) if r.is_file else None)
