"""Usage-event queries over the events table, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.operators import telemetry as T
from formweave.plans.common import table, usage_events

# allowlist for the event types of the given table
DEMO_SCHEMA = {"click": ["k"], "view": ["k", "value"], "purchase": ["value"], "signup": []}
FUNNEL = ["signup", "view", "click", "purchase"]
USER_PROPERTIES = {"app_version": "1.0.0", "language": "en", "timezone": "UTC"}

_EVENTS = """
e AS (SELECT user_id AS client_id, event_id, epoch_us(ts) AS ts_us, event_type AS event,
             props, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def _sessions_sql(source: str) -> str:
    return f"""
gaps AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w <= 1800000000 THEN 0 ELSE 1 END AS opens
         FROM {source} WINDOW w AS (PARTITION BY client_id ORDER BY ts_us, event_id)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY client_id ORDER BY ts_us, event_id
                                        ROWS UNBOUNDED PRECEDING) AS n FROM gaps),
started AS (SELECT *, min(ts_us) OVER (PARTITION BY client_id, n) AS session_start FROM numbered)"""


def telemetry_sessions(spark: SparkSession, d: str) -> DataFrame:
    return T.sessions(usage_events(spark, d))


def telemetry_event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return T.with_session_id(usage_events(spark, d)).select("client_id", "event_id", "session_id")


def telemetry_error_cap(spark: SparkSession, d: str) -> DataFrame:
    errors = usage_events(spark, d).withColumn("context", F.col("event"))
    return T.cap_per_day(errors).select("client_id", "event_id", "context")


def telemetry_type_cap(spark: SparkSession, d: str) -> DataFrame:
    """All events as one client's, so that the daily cap really bites."""
    errors = usage_events(spark, d).withColumn("client_id", F.lit(0)).withColumn("context", F.col("event"))
    return T.cap_per_day(errors).select("event_id", "context")


def telemetry_first_events(spark: SparkSession, d: str) -> DataFrame:
    events = usage_events(spark, d)
    installs = T.install_times(events.filter("event = 'signup'"))
    return T.with_hours_since_install(T.first_only(events), installs).select(
        "client_id", "event", "event_id", "hours_since_install"
    )


def telemetry_sanitize(spark: SparkSession, d: str) -> DataFrame:
    clean = T.sanitize(usage_events(spark, d), DEMO_SCHEMA)
    return clean.select("event_id", "event", T.params_as_json(F.col("params")).alias("params"))


def _toggles(events: DataFrame) -> DataFrame:
    """Purchases stand in for settings changes: k below 50 switches off."""
    k = F.get_json_object("params_json", "$.k").cast("int")
    return events.filter("event = 'purchase'").select("client_id", "ts_us", F.col("event_id").alias("seq"), (k >= 50).alias("enabled"))


def telemetry_opt_out(spark: SparkSession, d: str) -> DataFrame:
    events = usage_events(spark, d)
    return T.drop_opted_out(events, _toggles(events)).select("client_id", "event_id")


def telemetry_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Cap, opt-out, allowlist, then sessions: what would be sent, per client."""
    events = usage_events(spark, d).withColumn("context", F.col("event"))
    sent = T.sanitize(T.drop_opted_out(T.cap_per_day(events), _toggles(events)), DEMO_SCHEMA)
    s = T.sessions(sent)
    length = F.col("session_end") - F.col("session_start")
    return s.groupBy("client_id").agg(
        F.count("*").alias("sessions"),
        F.sum("events").alias("events_sent"),
        F.max("events").alias("largest_session"),
        F.sum(length).alias("active_us"),
    )


def telemetry_payload(spark: SparkSession, d: str) -> DataFrame:
    sent = T.with_session_id(T.sanitize(usage_events(spark, d), DEMO_SCHEMA))
    return T.collection_payload(sent, USER_PROPERTIES).select("event_id", "payload")


def telemetry_funnel(spark: SparkSession, d: str) -> DataFrame:
    return T.activation_funnel(usage_events(spark, d), FUNNEL)


def telemetry_daily_active(spark: SparkSession, d: str) -> DataFrame:
    """Daily tumbling windows: events and distinct clients.

    (day, client) pairs are made distinct first, so a hot client adds one row
    per map task.
    """
    per_client = usage_events(spark, d).groupBy(T.utc_day(F.col("ts_us")).alias("day"), "client_id").agg(
        F.count("*").alias("n")
    )
    return per_client.groupBy("day").agg(F.sum("n").alias("events"), F.count("*").alias("clients"))


def telemetry_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    """Orders as applications, purchases and views as answers and documents."""
    events = usage_events(spark, d).withColumn("cand", F.col("client_id"))
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").alias("cand"),
        F.when(F.col("o_orderstatus") == "F", "applied").otherwise("saved").alias("status"),
    )
    installs = events.groupBy("cand").agg(F.min("ts_us").alias("installed_us"))
    return T.heartbeats(
        installs, orders, events.filter("event = 'purchase'"), events.filter("event = 'view'"),
        now_us=1_735_689_600_000_000,
    )


QUERIES = {
    f.__name__: f
    for f in (
        telemetry_sessions, telemetry_event_sessions, telemetry_error_cap, telemetry_type_cap,
        telemetry_first_events, telemetry_sanitize, telemetry_opt_out, telemetry_pipeline,
        telemetry_payload, telemetry_funnel, telemetry_daily_active, telemetry_heartbeat,
    )
}

_CLEAN = """
clean AS (SELECT *, CASE event WHEN 'click' THEN '"k":' || k
                               WHEN 'view' THEN '"k":' || k ELSE '' END AS params
          FROM e WHERE event IN ('click', 'view', 'purchase', 'signup'))"""

_OFF = """
toggles AS (SELECT client_id, ts_us, k >= 50 AS enabled,
                   lead(ts_us) OVER (PARTITION BY client_id ORDER BY ts_us, event_id) AS until
            FROM e WHERE event = 'purchase'),
off AS (SELECT client_id, ts_us AS off_from, until FROM toggles WHERE NOT enabled)"""

_NOT_OFF = """NOT EXISTS (SELECT 1 FROM off o WHERE o.client_id = x.client_id AND x.ts_us >= o.off_from
                          AND (o.until IS NULL OR x.ts_us < o.until))"""

ORACLES = {
    "telemetry_sessions": f"""WITH {_EVENTS}, {_sessions_sql('e')}
SELECT client_id, session_start, max(ts_us) AS session_end, count(*) AS events
FROM started GROUP BY client_id, session_start""",
    "telemetry_event_sessions": f"""WITH {_EVENTS}, {_sessions_sql('e')}
SELECT client_id, event_id, CAST(session_start // 1000 AS VARCHAR) AS session_id FROM started""",
    "telemetry_error_cap": f"""WITH {_EVENTS}
SELECT client_id, event_id, event AS context FROM e
QUALIFY row_number() OVER (PARTITION BY client_id, event, ts_us // 86400000000 ORDER BY ts_us, event_id) <= 20""",
    "telemetry_type_cap": f"""WITH {_EVENTS}
SELECT event_id, event AS context FROM e
QUALIFY row_number() OVER (PARTITION BY event, ts_us // 86400000000 ORDER BY ts_us, event_id) <= 20""",
    "telemetry_first_events": f"""WITH {_EVENTS},
installs AS (SELECT client_id, min(ts_us) AS at FROM e WHERE event = 'signup' GROUP BY client_id),
firsts AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY client_id, event ORDER BY ts_us, event_id) = 1)
SELECT f.client_id, f.event, f.event_id,
       floor((f.ts_us // 1000 - i.at // 1000) / 3600000.0 * 10 + 0.5) / 10 AS hours_since_install
FROM firsts f LEFT JOIN installs i ON i.client_id = f.client_id""",
    "telemetry_sanitize": f"WITH {_EVENTS}, {_CLEAN} SELECT event_id, event, params FROM clean",
    "telemetry_opt_out": f"WITH {_EVENTS}, {_OFF} SELECT client_id, event_id FROM e x WHERE {_NOT_OFF}",
    "telemetry_pipeline": f"""WITH {_EVENTS}, {_OFF},
capped AS (SELECT * FROM e QUALIFY row_number() OVER (
    PARTITION BY client_id, event, ts_us // 86400000000 ORDER BY ts_us, event_id) <= 20),
sent AS (SELECT * FROM capped x WHERE {_NOT_OFF} AND event IN ('click', 'view', 'purchase', 'signup')),
{_sessions_sql('sent')},
s AS (SELECT client_id, session_start, max(ts_us) AS session_end, count(*) AS events
      FROM started GROUP BY client_id, session_start)
SELECT client_id, count(*) AS sessions, CAST(sum(events) AS BIGINT) AS events_sent,
       max(events) AS largest_session, CAST(sum(session_end - session_start) AS BIGINT) AS active_us
FROM s GROUP BY client_id""",
    "telemetry_payload": f"""WITH {_EVENTS}, {_CLEAN}, {_sessions_sql('clean')}
SELECT event_id, '{{"client_id":"' || client_id || '","user_properties":{{"app_version":{{"value":"1.0.0"}},'
    || '"language":{{"value":"en"}},"timezone":{{"value":"UTC"}}}},"events":[{{"name":"' || event
    || '","params":{{' || CASE WHEN params = '' THEN '' ELSE params || ',' END
    || '"session_id":"' || (session_start // 1000) || '","engagement_time_msec":100}}}}]}}' AS payload
FROM started""",
    "telemetry_funnel": f"""WITH {_EVENTS}
SELECT client_id, min(ts_us) FILTER (event = 'signup') AS signup_us, min(ts_us) FILTER (event = 'view') AS view_us,
       min(ts_us) FILTER (event = 'click') AS click_us, min(ts_us) FILTER (event = 'purchase') AS purchase_us
FROM e WHERE event IN ('signup', 'view', 'click', 'purchase') GROUP BY client_id""",
    "telemetry_daily_active": f"""WITH {_EVENTS}
SELECT ts_us // 86400000000 AS day, count(*) AS events, count(DISTINCT client_id) AS clients FROM e GROUP BY 1""",
    "telemetry_heartbeat": f"""WITH {_EVENTS},
r AS (SELECT o_custkey AS cand, 'job' AS kind, o_orderstatus = 'F' AS applied, NULL::BIGINT AS installed FROM orders
      UNION ALL SELECT client_id, 'answer', false, NULL FROM e WHERE event = 'purchase'
      UNION ALL SELECT client_id, 'document', false, NULL FROM e WHERE event = 'view'
      UNION ALL SELECT client_id, 'install', false, min(ts_us) FROM e GROUP BY client_id)
SELECT cand, count(*) FILTER (kind = 'job') AS jobs_total, count(*) FILTER (applied) AS jobs_applied,
       count(*) FILTER (kind = 'answer') AS answers_total, count(*) FILTER (kind = 'document') AS documents_total,
       CAST(coalesce(floor(floor((1735689600000 - min(installed) // 1000) / 3600000.0 * 10 + 0.5) / 10 / 24), 0) AS BIGINT)
           AS days_since_install
FROM r GROUP BY cand""",
}
