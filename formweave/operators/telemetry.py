"""Usage events: sanitising, caps, first-only milestones, sessions, heartbeats.

Event rows: client_id, event_id, ts_us (epoch microseconds), event,
params_json, once.  Ties in time are ordered by event_id.

A single client may own a large share of all rows.  Every operator here
either pre-aggregates on the map side, or keeps a bounded number of rows per
key before the shuffle, or spreads a client over (client, time cell) keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formweave.functions.dates import hours_since
from formweave.functions.text import strip_urls
from formweave.rules import telemetry as rules

US_PER_MINUTE = 60_000_000
US_PER_DAY = 86_400_000_000
NUMERIC_TYPES = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def utc_day(ts_us: Column) -> Column:
    return F.floor(ts_us / US_PER_DAY)


def activity_cells(
    events: DataFrame, gap_minutes: int = rules.SESSION_GAP_MINUTES, keys: tuple[str, ...] = ("client_id",)
) -> DataFrame:
    """One row per (client, cell of one gap width), each with the session it belongs to.

    Two events of one cell are always less than a gap apart, so a cell never
    spans two sessions.  The events collapse into cells in a hash aggregation
    with map-side combine; the ordered pass then sees at most one row per
    client and gap width of wall time, however many events the client has.
    """
    gap = gap_minutes * US_PER_MINUTE
    cells = events.groupBy(*keys, F.floor(F.col("ts_us") / gap).alias("cell")).agg(
        F.min("ts_us").alias("cell_start"), F.max("ts_us").alias("cell_end"), F.count("*").alias("cell_events")
    )
    in_order = Window.partitionBy(*keys).orderBy("cell")
    before = F.lag("cell_end").over(in_order)
    opens = before.isNull() | (F.col("cell_start") - before > gap)
    return cells.withColumn(
        "session_start",
        F.last(F.when(opens, F.col("cell_start")), ignorenulls=True).over(
            in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )


def sessions(events: DataFrame, gap_minutes: int = rules.SESSION_GAP_MINUTES) -> DataFrame:
    """client_id, session_start, session_end, events; a gap of exactly 30 minutes stays inside."""
    return (
        activity_cells(events, gap_minutes)
        .groupBy("client_id", "session_start")
        .agg(F.max("cell_end").alias("session_end"), F.sum("cell_events").alias("events"))
    )


def with_session_id(events: DataFrame, gap_minutes: int = rules.SESSION_GAP_MINUTES) -> DataFrame:
    """Adds session_id, the first event's epoch milliseconds as text."""
    gap = gap_minutes * US_PER_MINUTE
    cells = activity_cells(events, gap_minutes).select(
        "client_id", "cell", F.floor(F.col("session_start") / 1000).cast("string").alias("session_id")
    )
    return (
        events.withColumn("cell", F.floor(F.col("ts_us") / gap))
        .join(cells, ["client_id", "cell"])
        .drop("cell")
    )


def first_only(events: DataFrame) -> DataFrame:
    """The first row per (client, event).

    Rank 1 is kept per map task before the shuffle, so a hot key moves one
    row per task.
    """
    rank = F.row_number().over(Window.partitionBy("client_id", "event").orderBy("ts_us", "event_id"))
    return events.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def cap_per_day(
    events: DataFrame, context: str = "context", limit: int = rules.MAX_ERRORS_PER_CONTEXT_PER_DAY
) -> DataFrame:
    """The first `limit` rows per client, context and UTC day."""
    rank = F.row_number().over(
        Window.partitionBy("client_id", context, utc_day(F.col("ts_us"))).orderBy("ts_us", "event_id")
    )
    return events.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def install_times(events: DataFrame) -> DataFrame:
    """First write wins: the earliest event of each client."""
    return events.groupBy("client_id").agg(F.min("ts_us").alias("installed_us"))


def with_hours_since_install(events: DataFrame, installs: DataFrame) -> DataFrame:
    hours = hours_since(F.floor(F.col("installed_us") / 1000), F.floor(F.col("ts_us") / 1000))
    return events.join(installs, "client_id", "left").withColumn("hours_since_install", hours).drop("installed_us")


def _off_from(switch: Column, event: Column, ts_us: Column) -> Column:
    """Whether an event falls to a switch (ts_us, enabled) that was off; the opt-out event of that very switch does not."""
    farewell = (event == "telemetry_opt_out") & (ts_us == switch["ts_us"])
    return F.coalesce(~switch["enabled"] & ~farewell, F.lit(False))


def drop_opted_out(events: DataFrame, toggles: DataFrame) -> DataFrame:
    """Remove events sent while the client's usage switch was off.

    toggles: client_id, ts_us, seq (order of the same time), enabled; clients
    start enabled.  The opt-out event of the very switch that turns it off is
    still sent.

    An as-of lookup: switches and events of one client and day are put in
    order and each event takes the last switch before it; what was set at the
    day's start comes from one row a client and day.
    """
    day = F.floor(F.col("ts_us") / US_PER_DAY).alias("_day")
    switch = F.struct("ts_us", "seq", "enabled")
    last = toggles.groupBy("client_id", day).agg(F.max(switch).alias("s"))
    days = events.select("client_id", day).distinct()
    earlier = Window.partitionBy("client_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    opening = days.join(last, ["client_id", "_day"], "full").select(
        "client_id", "_day", F.last("s", ignorenulls=True).over(earlier).alias("_switch")
    ).filter("_switch IS NOT NULL")

    rows = events.select("*", day, F.lit(None).cast("struct<ts_us:bigint,seq:bigint,enabled:boolean>").alias("_switch"), F.lit(2).alias("_kind"))
    of_switch = lambda c: F.struct(c["ts_us"].cast("bigint").alias("ts_us"), c["seq"].cast("bigint").alias("seq"), c["enabled"].alias("enabled"))
    marks = toggles.select("client_id", "ts_us", day, of_switch(switch).alias("_switch"), F.lit(1).alias("_kind")).unionByName(
        opening.select("client_id", F.lit(None).cast("bigint").alias("ts_us"), "_day", of_switch(F.col("_switch")).alias("_switch"), F.lit(0).alias("_kind"))
    )
    # the opening row first, switches before events of the same time
    in_order = Window.partitionBy("client_id", "_day").orderBy(F.col("ts_us").asc_nulls_first(), "_kind", "_switch.seq")
    so_far = F.last("_switch", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    held = rows.unionByName(marks, allowMissingColumns=True).withColumn("_switch", so_far)
    return held.filter((F.col("_kind") == 2) & ~_off_from(F.col("_switch"), F.col("event"), F.col("ts_us"))).select(*events.columns)


def drop_opted_out_stream(events: DataFrame, toggles: DataFrame) -> DataFrame:
    """The same for a stream of events and a table of toggles, where rows can't be put in order: a join with the off periods."""
    in_order = Window.partitionBy("client_id").orderBy("ts_us", "seq")
    off = (
        toggles.withColumn("off_until", F.lead("ts_us").over(in_order))
        .filter(~F.col("enabled"))
        .select("client_id", F.col("ts_us").alias("off_from"), "off_until")
    )
    e, o = events.alias("e"), off.alias("o")
    inside = (F.col("e.ts_us") >= F.col("o.off_from")) & (
        F.col("o.off_until").isNull() | (F.col("e.ts_us") < F.col("o.off_until"))
    )
    farewell = (F.col("e.event") == "telemetry_opt_out") & (F.col("e.ts_us") == F.col("o.off_from"))
    return e.join(o, (F.col("e.client_id") == F.col("o.client_id")) & inside & ~farewell, "left_anti")


def _literal_map(schema: dict[str, list[str]]) -> Column:
    pairs: list[Column] = []
    for event, params in schema.items():
        pairs += [F.lit(event), F.array(*[F.lit(p) for p in params]).cast("array<string>")]
    return F.create_map(*pairs)


def sanitize(
    events: DataFrame,
    schema: dict[str, list[str]] | None = None,
    forbidden: list[str] | None = None,
) -> DataFrame:
    """Replace params_json by `params`, the permitted parameters in allowlist order.

    params: array<struct<name, value, is_number>>.  Unknown events, unknown or
    forbidden names, nested values and nulls are dropped; booleans become
    text; text loses URLs and is cut at 100 characters.  The allowlist is a
    map literal, so the step is a projection and a filter.
    """
    banned = set(rules.FORBIDDEN_PARAMS if forbidden is None else forbidden)
    permitted = {
        e: [p for p in ps if p not in banned] for e, ps in (schema or rules.event_schema()).items()
    }
    raw = F.from_json("params_json", "map<string,variant>")
    known = events.withColumn("_allowed", F.element_at(_literal_map(permitted), F.col("event"))).filter(
        F.col("_allowed").isNotNull()
    )
    typed = known.withColumn("_raw", raw).withColumn(
        "_params",
        F.transform(
            "_allowed",
            lambda p: F.struct(
                p.alias("name"),
                F.schema_of_variant(F.element_at("_raw", p)).alias("type"),
                F.try_variant_get(F.element_at("_raw", p), "$", "string").alias("value"),
            ),
        ),
    )
    kept = F.filter("_params", lambda p: p["type"].rlike(NUMERIC_TYPES) | p["type"].isin("STRING", "BOOLEAN"))
    shaped = F.transform(
        kept,
        lambda p: F.struct(
            p["name"].alias("name"),
            F.when(p["type"] == "STRING", F.substring(strip_urls(p["value"]), 1, rules.MAX_STRING_LENGTH))
            .otherwise(p["value"])
            .alias("value"),
            p["type"].rlike(NUMERIC_TYPES).alias("is_number"),
        ),
    )
    return typed.withColumn("params", shaped).drop("_allowed", "_raw", "_params", "params_json")


def params_as_json(params: Column) -> Column:
    """The sanitised parameters as the members of a JSON object, without braces."""
    member = lambda p: F.when(
        p["is_number"], F.concat(F.lit('"'), p["name"], F.lit('":'), p["value"])
    ).otherwise(F.regexp_replace(F.to_json(F.create_map(p["name"], p["value"])), r"^\{|\}$", ""))
    return F.array_join(F.transform(params, member), ",")


def collection_payload(events: DataFrame, user_properties: dict[str, str]) -> DataFrame:
    """client_id and the JSON record to send for each sanitised event with a session_id."""
    user = F.to_json(F.struct(*[F.struct(F.lit(v).alias("value")).alias(k) for k, v in user_properties.items()]))
    # the members of an object, without its braces
    inner = lambda s: F.regexp_replace(F.to_json(s), r"^\{|\}$", "")
    members = F.concat_ws(
        ",",
        F.nullif(params_as_json(F.col("params")), F.lit("")),
        inner(F.struct(F.col("session_id").cast("string").alias("session_id"))),
        F.lit(f'"engagement_time_msec":{rules.ENGAGEMENT_TIME_MSEC}'),
    )
    payload = F.concat(
        F.lit("{"), inner(F.struct(F.coalesce(F.col("client_id").cast("string"), F.lit("")).alias("client_id"))),
        F.lit(',"user_properties":'), user,
        F.lit(',"events":[{"name":"'), F.col("event"), F.lit('","params":{'), members, F.lit("}}]}"),
    )
    return events.select("client_id", "event_id", "ts_us", payload.alias("payload"))


def route(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(errors, first-only, plain): an error goes to the cap even when marked once."""
    is_error = F.col("event") == "extension_error"
    once = F.coalesce(F.col("once"), F.lit(False))
    return events.filter(is_error), events.filter(~is_error & once), events.filter(~is_error & ~once)


def prepare_events(
    events: DataFrame, toggles: DataFrame | None = None, schema: dict[str, list[str]] | None = None
) -> DataFrame:
    """Events to send, with session ids.

    Caps and first-only flags advance before the opt-out and allowlist checks;
    the session only sees what is really sent.
    """
    errors, firsts, plain = route(events)
    context = F.coalesce(F.get_json_object("params_json", "$.context"), F.lit("panel"))
    capped = cap_per_day(errors.withColumn("context", context)).drop("context")
    sent = capped.unionByName(first_only(firsts)).unionByName(plain)
    if toggles is not None:
        sent = drop_opted_out(sent, toggles)
    return with_session_id(sanitize(sent, schema))


def activation_funnel(events: DataFrame, steps: list[str]) -> DataFrame:
    """First time of each step per client, one hash aggregation."""
    firsts = [F.min(F.when(F.col("event") == s, F.col("ts_us"))).alias(f"{s}_us") for s in steps]
    return events.filter(F.col("event").isin(steps)).groupBy("client_id").agg(*firsts)


def heartbeats(
    installs: DataFrame, jobs: DataFrame, answers: DataFrame, documents: DataFrame, now_us: int
) -> DataFrame:
    """Entity counts per candidate, one aggregation over tagged rows instead of four joins."""
    tag = lambda df, kind, status: df.select(
        "cand", F.lit(kind).alias("kind"), status.alias("status"), F.lit(None).cast("long").alias("installed_us")
    )
    null = F.lit(None).cast("string")
    rows = (
        tag(jobs, "job", F.col("status"))
        .unionByName(tag(answers, "answer", null))
        .unionByName(tag(documents, "document", null))
        .unionByName(
            installs.select("cand", F.lit("install").alias("kind"), null.alias("status"), "installed_us")
        )
    )
    count = lambda cond: F.count_if(cond)
    kind = F.col("kind")
    out = rows.groupBy("cand").agg(
        count(kind == "job").alias("jobs_total"),
        count((kind == "job") & (F.col("status") == "applied")).alias("jobs_applied"),
        count(kind == "answer").alias("answers_total"),
        count(kind == "document").alias("documents_total"),
        F.min("installed_us").alias("installed_us"),
    )
    hours = hours_since(F.floor(F.col("installed_us") / 1000), F.lit(now_us // 1000))
    days = F.coalesce(F.floor(hours / 24), F.lit(0))
    return out.withColumn("days_since_install", days).drop("installed_us")
