"""Sanitising, routing and sessions of usage events on small cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from formweave import schemas
from formweave.operators import telemetry as T

CASES = {
    "unknown": ("made_up_event", {"ats": "lever"}, None),
    "extra": ("fill_completed", {"filled": 12, "ats": "greenhouse", "url": "https://x", "email": "a@b.c"}, '"ats":"greenhouse","filled":12'),
    "nested": ("fill_completed", {"ats": {"n": 1}, "filled": [1], "failed": None, "via": "w"}, '"via":"w"'),
    "types": ("resume_imported", {"method": True, "warnings": 2.5}, '"method":"true","warnings":2.5'),
    "urls": ("extension_error", {"context": "scan", "message": "no https://jobs.lever.co/a?b=1. now"}, '"context":"scan","message":"no <url> now"'),
    "long": ("extension_error", {"message": "x" * 500}, '"message":"' + "x" * 100 + '"'),
    "quotes": ("settings_changed", {"field": 'a"b'}, '"field":"a\\"b"'),
    "empty": ("telemetry_opt_out", {"a": 1}, ""),
}


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.USAGE_EVENTS)


@pytest.fixture(scope="module")
def clean(spark):
    rows = [(name, i, i, event, json.dumps(params), False) for i, (name, (event, params, _)) in enumerate(CASES.items())]
    rows.append(("broken", 99, 99, "panel_opened", "{not json", False))
    out = T.sanitize(frame(spark, rows)).withColumn("json", T.params_as_json(F.col("params")))
    return {r.client_id: r.json for r in out.collect()}


@pytest.mark.parametrize("name", CASES)
def test_sanitize(clean, name):
    assert clean.get(name) == CASES[name][2]


def test_unreadable_params_leave_none(clean):
    assert clean["broken"] == ""


def test_order_of_checks(spark):
    """Caps and firsts advance before the opt-out, sessions only see what is sent."""
    minute = T.US_PER_MINUTE
    rows = [("c", i, i, "extension_error", '{"context":"x"}', True) for i in range(25)]
    rows += [("c", 100, 5 * minute, "onboarding_completed", "{}", True), ("c", 101, 70 * minute, "onboarding_completed", "{}", True),
             ("c", 102, 40 * minute, "unknown", "{}", False), ("c", 103, 65 * minute, "panel_opened", "{}", False)]
    toggles = spark.createDataFrame([("c", 4 * minute, 1, False), ("c", 60 * minute, 2, True)], "client_id string, ts_us long, seq long, enabled boolean")
    got = {r.event_id: r.session_id for r in T.prepare_events(frame(spark, rows), toggles).collect()}
    # 20 errors; the first milestone fell into the opted-out time and is used up
    assert set(got) == {*range(20), 103}
    assert len(set(got.values())) == 2


def test_opt_out_event_itself_is_sent(spark):
    rows = [("c", 1, 10, "telemetry_opt_out", "{}", False), ("c", 2, 10, "panel_opened", "{}", False), ("c", 3, 9, "panel_opened", "{}", False)]
    toggles = spark.createDataFrame([("c", 10, 1, False)], "client_id string, ts_us long, seq long, enabled boolean")
    assert {r.event_id for r in T.drop_opted_out(frame(spark, rows), toggles).collect()} == {1, 3}


def test_thirty_minutes_stay_together(spark):
    m = T.US_PER_MINUTE
    rows = [("c", i, t * m, "panel_opened", "{}", False) for i, t in enumerate([29, 59, 89, 120])] + [("d", 9, 1, "x", "{}", False)]
    got = sorted((r.client_id, r.session_start // m, r.session_end // m, r.events) for r in T.sessions(frame(spark, rows)).collect())
    assert got == [("c", 29, 89, 3), ("c", 120, 120, 1), ("d", 0, 0, 1)]


def test_payload_is_json_whatever_the_client_is_called(spark):
    cell = {"client_id": '],"x":[', "session_id": 'a"b', "event_id": 1, "ts_us": 5, "event": "panel_opened", "params": []}
    schema = "client_id string, session_id string, event_id long, ts_us long, event string, params array<struct<name:string,value:string,is_number:boolean>>"
    sent = T.collection_payload(spark.createDataFrame([cell], schema), {"language": "en"})
    got = json.loads(sent.first().payload)
    assert got["client_id"] == cell["client_id"] and got["events"][0]["params"]["session_id"] == 'a"b'


def test_switches_of_one_moment_and_over_days(spark):
    day = T.US_PER_DAY
    toggles = spark.createDataFrame(
        [("a", 10, 1, False), ("a", 10, 2, True), ("b", 10, 1, True), ("b", 10, 2, False), ("c", 5, 1, False), ("c", 3 * day, 1, True)],
        "client_id string, ts_us long, seq long, enabled boolean")
    events = spark.createDataFrame(
        [("a", 11, "x"), ("b", 9, "x"), ("b", 10, "telemetry_opt_out"), ("b", 10, "x"), ("b", 9 * day, "x"), ("c", 4, "x"), ("c", 2 * day, "x"),
         ("c", 3 * day, "x"), ("d", 1, "x")], "client_id string, ts_us long, event string")
    want = {("a", 11, "x"), ("b", 9, "x"), ("b", 10, "telemetry_opt_out"), ("c", 4, "x"), ("c", 3 * day, "x"), ("d", 1, "x")}
    assert {tuple(r) for r in T.drop_opted_out(events, toggles).collect()} == want
    assert {tuple(r) for r in T.drop_opted_out_stream(events, toggles).collect()} == want
