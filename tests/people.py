"""Test candidates, fields and answers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from formweave import schemas

FIELD = {
    "cand": "runa", "page_id": "p1", "pos": 0, "frame_path": "top", "selector": "#x", "kind": "text", "label": "",
    "label_source": "label-for", "required": False, "visible": True, "in_shadow": False, "widget_hint": "native",
    "ats": "generic", "date_format_hint": "MM/DD/YYYY",
}


def from_records(spark, records, schema):
    """Records as dicts; members not given are null."""
    lines = spark.createDataFrame([(json.dumps(r),) for r in records], "line string")
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*")


def options(*pairs):
    return [{"value": v, "text": t} for v, t in pairs]


def fields(spark, cases):
    """cases: name -> field members; the name becomes the ref."""
    records = [{**FIELD, "ref": name, "pos": i, **case} for i, (name, case) in enumerate(cases.items())]
    return from_records(spark, records, schemas.SIGNALS)


EXPLICIT = {
    "workAuth": "Yes", "requiresSponsorship": "No", "salary": "CHF 91,500", "salaryMin": "CHF 88,000",
    "salaryMax": "CHF 97,000", "startDate": "2031-02-15", "relocation": "No", "remote": "Hybrid",
    "noticePeriod": "10 weeks", "gender": "Prefer not to say", "race": "Decline to self-identify",
    "hispanic": "No", "veteran": "I am not a protected veteran", "disability": "No, I do not have a disability",
}


def person(cand, explicit=None, **parts):
    base = {
        "cand": cand, "version": 1,
        "basics": {"firstName": "Runa", "lastName": "Okoye", "email": "runa.okoye@post.example",
                   "phone": "+41 44 555 0187", "pronouns": "they/them"},
        "location": {"street": "Seestrasse 7", "city": "Winterthur", "region": "Kanton Zürich",
                     "country": "Switzerland", "postalCode": "8400"},
        "links": {"linkedin": "https://linkedin.com/in/runa-okoye", "github": "", "portfolio": "https://okoye.example", "website": ""},
        "work": [{"company": "Glacier Gauges AG", "title": "Field Hydrologist", "start": "2022-11", "end": "",
                  "current": True, "location": "Chur", "description": "Snow melt."}],
        "education": [{"school": "Alpine Polytechnic", "degree": "MSc", "field": "Earth Science",
                       "start": "2015-02", "end": "2020-07", "gpa": "5.2"}],
        "skills": ["Surveying", "Kriging"],
        "explicit": explicit or {},
    }
    return {**base, **parts}


def profiles(spark, *people):
    return from_records(spark, people, schemas.PROFILES)


def answer(cand, id, question, text, key=None, aliases=()):
    words = "".join(ch.lower() if ch.isalnum() else " " for ch in question).split()
    return {"cand": cand, "id": id, "question_text": question, "normalized_key": key or " ".join(words),
            "alias_keys": list(aliases), "answer": text, "times_used": 0, "last_used_us": 0, "created_us": 0}


def answers(spark, *rows):
    return from_records(spark, rows, schemas.ANSWERS)


def document(cand, id, role, name, mime="application/pdf"):
    return {"cand": cand, "id": id, "role": role, "file_name": name, "mime": mime, "size": 1000, "added_us": 0}


def documents(spark, *rows):
    return from_records(spark, rows, schemas.DOCUMENTS)
