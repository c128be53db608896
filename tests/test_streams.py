"""Streams give what the batch operators give."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from formweave import schemas
from formweave.operators import telemetry as T
from formweave.operators import tracker as K
from formweave.operators.answers import save_answers
from formweave.streaming import live, usage

MINUTE = 60_000_000


def events(n, seed=3):
    rnd = random.Random(seed)
    at = 1_700_000_000_000_000
    rows = []
    for i in range(n):
        at += rnd.choice([1, 5, 10, 31]) * MINUTE
        rows.append({"client_id": rnd.choice("aaab"), "event_id": i, "ts_us": at, "event": rnd.choice(["extension_error", "panel_opened"]),
                     "params_json": json.dumps({"context": rnd.choice("xy"), "surface": "s"}), "once": False})
    # exactly one gap apart: still the same session
    rows.append({**rows[-1], "client_id": "b", "event_id": n, "ts_us": at + MINUTE})
    rows.append({**rows[-1], "client_id": "b", "event_id": n + 1, "ts_us": at + 31 * MINUTE})
    return rows


def feed(folder, rows, parts=3):
    folder.mkdir()
    size = -(-len(rows) // parts)
    for i in range(parts):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows[i * size:(i + 1) * size]))
    # a far later event of another client moves the watermark on
    flush = {"client_id": "flush", "event_id": -1, "ts_us": rows[-1]["ts_us"] + 90 * 24 * 60 * MINUTE, "event": "panel_opened",
             "params_json": "{}", "once": False}
    (folder / "9.json").write_text(json.dumps(flush))
    return str(folder)


def run(spark, df, mode="append"):
    name = f"t{random.randrange(10**9)}"
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return spark.table(name).collect()


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    rows = events(80)
    folder = feed(tmp_path_factory.mktemp("stream") / "in", rows)
    stream = lambda: usage.read_events(spark, folder).withColumn("context", F.get_json_object("params_json", "$.context"))
    batch = spark.read.schema(schemas.USAGE_EVENTS).json(folder).filter("client_id <> 'flush'")
    return stream, batch.withColumn("context", F.get_json_object("params_json", "$.context"))


def test_sessions(spark, source):
    stream, batch = source
    cols = ("client_id", "session_start", "session_end", "events")
    want = sorted(tuple(r[c] for c in cols) for r in T.sessions(batch).collect())
    got = sorted(tuple(r[c] for c in cols) for r in run(spark, usage.sessions(stream())) if r.client_id != "flush")
    assert got == want


def test_event_sessions(spark, source):
    stream, batch = source
    want = {r.event_id: r.session_id for r in T.with_session_id(batch).collect()}
    got = {r.event_id: r.session_id for r in run(spark, usage.event_sessions(stream())) if r.client_id != "flush"}
    assert got == want


def feed_in_order(folder, parts):
    """Files that a stream reads one a micro-batch, in this order."""
    folder.mkdir()
    for i, rows in enumerate(parts):
        path = folder / f"{i:03}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def one_file_a_batch(spark, folder):
    raw = spark.readStream.schema(schemas.USAGE_EVENTS).option("maxFilesPerTrigger", 1).json(folder)
    return raw.withColumn("ts", F.timestamp_micros("ts_us"))


FLUSH = {"client_id": "flush", "event_id": -1, "ts_us": 1_800_000_000_000_000, "event": "panel_opened", "params_json": "{}", "once": False}


def test_event_sessions_of_shuffled_batches(spark, tmp_path):
    """Rows out of order by less than the lateness, over many micro-batches: the ids of the batch operator."""
    rnd = random.Random(6)
    rows = sorted(events(120, seed=9), key=lambda r: r["ts_us"] + rnd.randrange(9 * MINUTE))
    # a file spans more than it is out of order, so no row is behind the watermark of the files before it
    parts = [rows[i:i + 30] for i in range(0, len(rows), 30)]
    folder = feed_in_order(tmp_path / "in", [*parts, [FLUSH]])
    batch = spark.read.schema(schemas.USAGE_EVENTS).json(folder).filter("client_id <> 'flush'")
    want = {r.event_id: r.session_id for r in T.with_session_id(batch).collect()}
    got = [(r.event_id, r.session_id) for r in run(spark, usage.event_sessions(one_file_a_batch(spark, folder))) if r.client_id != "flush"]
    assert len(got) == len(want) and dict(got) == want


def test_late_events_are_dropped(spark, tmp_path):
    at = 1_700_000_000_000_000
    event = lambda i, t: {**FLUSH, "client_id": "a", "event_id": i, "ts_us": at + t * MINUTE}
    # the watermark stands at 110 minutes when 3 (late) and 4 (not late) come; 4 joins the session of 2
    folder = feed_in_order(tmp_path / "in", [[event(1, 0), event(2, 120)], [event(9, 121)], [event(3, 20), event(4, 115)], [FLUSH]])
    got = {r.event_id: r.session_id for r in run(spark, usage.event_sessions(one_file_a_batch(spark, folder))) if r.client_id != "flush"}
    first, second = str(at // 1000), str((at + 115 * MINUTE) // 1000)
    assert got == {1: first, 4: second, 2: second, 9: second}


def test_capped_errors(spark, source):
    stream, batch = source
    limit = 2
    want = {r.event_id for r in T.cap_per_day(batch.filter("event = 'extension_error'"), limit=limit).collect()}
    got = {r.event_id for r in run(spark, usage.capped_errors(stream().filter("event = 'extension_error'"), limit=limit))}
    assert got == want


def test_stateless_steps_and_firsts(spark, source):
    stream, batch = source
    clean = run(spark, usage.sanitized(stream().filter("client_id <> 'flush'")))
    assert sorted(r.event_id for r in clean) == sorted(r.event_id for r in T.sanitize(batch).collect())
    firsts = {(r.client_id, r.event) for r in run(spark, usage.first_events(stream())) if r.client_id != "flush"}
    assert firsts == {(r.client_id, r.event) for r in T.first_only(batch).collect()}
    toggles = spark.createDataFrame([("a", 0, 1, False)], "client_id string, ts_us long, seq long, enabled boolean")
    left = run(spark, usage.opted_in(stream(), toggles))
    assert {r.client_id for r in left} == {"b", "flush"}
    days = run(spark, usage.daily_activity(stream()))
    assert sum(r.events for r in days if r.client_id != "flush") == batch.count()


def test_parse_requests_once(spark, tmp_path):
    rows = [{"job_id": j, "ts_us": 1_700_000_000_000_000 + i} for i, j in enumerate("aabca")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(map(json.dumps, rows)))
    stream = usage.read_events(spark, str(tmp_path / "in"), schema="job_id string, ts_us long")
    assert sorted(r.job_id for r in run(spark, usage.parse_requests(stream))) == ["a", "b", "c"]


def test_payload_files(spark, source, tmp_path):
    stream, _ = source
    ready = usage.sanitized(stream().filter("event = 'panel_opened'")).withColumn("session_id", F.lit("1"))
    query = usage.write_payloads(ready, str(tmp_path / "out"), str(tmp_path / "cp"), {"app_version": "1"}).trigger(availableNow=True).start()
    query.awaitTermination(120)
    record = json.loads(spark.read.text(str(tmp_path / "out")).filter("value LIKE '%surface%'").first().value)
    assert record["user_properties"] == {"app_version": {"value": "1"}}
    assert record["events"] == [{"name": "panel_opened", "params": {"surface": "s", "session_id": "1", "engagement_time_msec": 100}}]


CHANGE = "cand string, seq long, ts_us long, op string, url string, ats string, title string, jd string, field_count long, " \
         "filled long, reviewed long, failed long, status string, reminder_days int"


def changes(n, seed=4):
    rnd = random.Random(seed)
    ops = ["detected", "filled", "applied", "status", "reminder", "filled", "detected", "delete"]
    return [(rnd.choice("pq"), i, rnd.randrange(1000) * 1000, rnd.choice(ops), f"https://X.example/{rnd.randrange(4)}?q={i}", "generic",
             rnd.choice(["", f"T{i}"]), rnd.choice([None, f"J{i}"]), i, i // 2, i // 3, i // 4,
             rnd.choice(["offer", "rejected"]), rnd.choice([0, 3])) for i in range(n)]


def by_batch(spark, rows, schema, n):
    size = -(-len(rows) // n)
    return [spark.createDataFrame(rows[i * size:(i + 1) * size], schema) for i in range(n)]


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files_of(run):
    return sorted((p, os.path.getmtime(os.path.join(d, p))) for d, _, names in os.walk(run.path.removeprefix("file:")) for p in names)


def test_live_applications_and_replay(spark, tmp_path):
    rows = sorted(changes(200), key=lambda r: (r[2], r[1]))
    path = str(tmp_path / "apps")
    apply = live.fold_into(path, live.applications_fold, fanout=3)
    frames = by_batch(spark, rows, CHANGE, 5)
    for batch_id, frame in enumerate(frames):
        apply(frame, batch_id)
    runs = live.current_runs(spark, path)
    assert len(runs) < 5 and (runs[0].first, runs[-1].last) == (0, 4)
    assert all(a.last + 1 == b.first for a, b in zip(runs, runs[1:]))
    want = as_rows(K.applications(spark.createDataFrame(rows, CHANGE)))
    assert as_rows(live.live_applications(spark, path)) == want and len(want) > 3
    # batches replayed, alone or merged into a larger run meanwhile, have no effect
    apply(frames[4], 4)
    apply(frames[2], 2)
    assert as_rows(live.live_applications(spark, path)) == want
    assert as_rows(live.live_applications(spark, path, "p")) == [r for r in want if r[0] == "p"]
    assert live.live_applications(spark, path, "nobody").isEmpty()


def test_a_batch_writes_only_its_own_rows(spark, tmp_path):
    path = str(tmp_path / "apps")
    apply = live.fold_into(path, live.applications_fold, fanout=4)
    frames = by_batch(spark, sorted(changes(90), key=lambda r: (r[2], r[1])), CHANGE, 3)
    before = {}
    for batch_id, frame in enumerate(frames):
        apply(frame, batch_id)
        runs = live.current_runs(spark, path)
        assert len(runs) == batch_id + 1 and spark.read.parquet(runs[-1].path).count() == 30
        assert all(files_of(r) == before[r.path] for r in runs[:-1])
        before = {r.path: files_of(r) for r in runs}


def test_a_broken_write_is_done_again_and_empty_batches_pass(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "cand string, id string, at_us long"
    apply = live.fold_into(path, live.fill_log_fold)
    frame = spark.createDataFrame([("p", "e1", 1), ("p", "e2", 2)], schema)
    with pytest.raises(FileNotFoundError):
        live.stored_rows(spark, path)
    apply(frame.limit(0), 0)
    apply(frame, 1)
    [run] = live.current_runs(spark, path)
    os.remove(run.path.removeprefix("file:") + "/_SUCCESS")
    with pytest.raises(FileNotFoundError):
        live.stored_rows(spark, path)
    apply(frame, 1)
    assert as_rows(live.live_fill_log(spark, path).select("id")) == [("e1",), ("e2",)]


def test_buckets_are_split_as_the_table_grows(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "cand string, id string, at_us long"
    # candidate c0 holds a third of the rows
    entries = [(f"c{0 if i % 3 == 0 else i % 40}", f"e{i:04}", i) for i in range(800)]
    apply = live.fold_into(path, live.fill_log_fold, fanout=2, bucket_bytes=4000)
    seen = []
    for batch_id, frame in enumerate(by_batch(spark, entries, schema, 5)):
        apply(frame, batch_id)
        seen.append(live.current_runs(spark, path)[0].buckets)
    assert seen[0] == 1 and seen == sorted(seen) and seen[-1] >= 4
    want = K.fill_log(spark.createDataFrame(entries, schema))
    assert as_rows(live.live_fill_log(spark, path).select("cand", "id")) == as_rows(want.select("cand", "id"))
    for cand in ("c0", "c7"):
        one = live.live_fill_log(spark, path, cand)
        assert as_rows(one.select("cand", "id")) == as_rows(want.filter(F.col("cand") == cand).select("cand", "id"))


def test_live_fill_log(spark, tmp_path):
    entries = [("p" if i % 3 else "q", f"e{i:03}", i * 10) for i in range(200)]
    path = str(tmp_path / "log")
    apply = live.fold_into(path, live.fill_log_fold, fanout=2)
    for b in range(2):
        apply(spark.createDataFrame(entries[b::2], "cand string, id string, at_us long"), b)
    # merged into one run that holds no more than is kept
    [run] = live.current_runs(spark, path)
    assert spark.read.parquet(run.path).count() == 100
    kept = live.live_fill_log(spark, path).groupBy("cand").agg(F.count("*").alias("n"), F.min("at_us").alias("m")).collect()
    assert {r.cand: r.n for r in kept} == {"p": 50, "q": 50} and min(r.m for r in kept) > 500


def test_live_answers(spark, tmp_path):
    schema = "cand string, seq long, ts_us long, question string, answer string"
    asked = ["Why this team?", "Why this  TEAM", "What is your notice period?", "What is your notice periods?", "Your favourite tool"]
    rnd = random.Random(8)
    saves = [(rnd.choice("pq"), i, i * 10, rnd.choice(asked), f"A{i}") for i in range(40)]
    path = str(tmp_path / "answers")
    apply = live.fold_into(path, live.answers_fold, fanout=2)
    for batch_id, frame in enumerate(by_batch(spark, saves, schema, 4)):
        apply(frame, batch_id)
    want = save_answers(spark.createDataFrame(saves, schema), spark.createDataFrame([], schemas.ANSWERS))
    assert as_rows(live.live_answers(spark, path)) == as_rows(want)


def test_milestones(spark):
    rows = spark.createDataFrame(changes(40), CHANGE)
    out = T.first_only(live.milestones(rows).filter("once"))
    assert {(r.client_id, r.event) for r in out.collect()} == {
        (c, e) for c in "pq" for e in ("first_application_detected", "first_fill_completed", "first_application_marked")}
