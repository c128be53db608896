"""Application-history queries over the orders table, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.operators import tracker as K
from formweave.plans.common import micros, table

NOW_US = 946_684_800_000_000  # 2000-01-01


def changes(spark: SparkSession, d: str) -> DataFrame:
    """orders as change rows: the status letter and the price choose the kind of change."""
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    op = (
        F.when(status == "O", "detected")
        .when(status == "F", "filled")
        .when(price > 400_000, "status")
        .when(price > 300_000, "reminder")
        .when(price < 20_000, "delete")
        .otherwise("applied")
    )
    year = F.year("o_orderdate")
    fields = F.floor(price / 10_000)
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("cand"),
        F.col("o_orderkey").alias("seq"),
        micros("o_orderdate").alias("ts_us"),
        op.alias("op"),
        F.concat(F.lit("https://Jobs.Example.com/"), year, F.lit("?ref="), F.col("o_orderkey")).alias("url"),
        F.when(price > 250_000, "lever").otherwise("generic").alias("ats"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(
            F.concat(F.lit('Role "'), F.col("o_orderpriority"), F.lit('" '), F.col("o_orderkey"))
        ).alias("title"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("Long text "), F.col("o_orderkey"))).alias("jd"),
        fields.alias("field_count"),
        F.floor(fields / 2).alias("filled"),
        F.floor(fields / 4).alias("reviewed"),
        F.floor(fields / 8).alias("failed"),
        F.when(price > 450_000, "interviewing").otherwise("rejected").alias("status"),
        F.when(F.col("o_orderpriority") == "2-HIGH", 0).otherwise(7).alias("reminder_days"),
        F.col("o_orderpriority").alias("priority"),
    )


def history_upsert(spark: SparkSession, d: str) -> DataFrame:
    return K.applications(changes(spark, d))


def history_page(spark: SparkSession, d: str) -> DataFrame:
    """Page 2 of the orders of each customer, clamped; orders carry one entry each."""
    apps = changes(spark, d).select("cand", F.col("seq").alias("id"), F.col("ts_us").alias("first_seen_us"))
    return K.history_page(apps, page=1).select(
        "cand", "id", F.col("rank").cast("long").alias("rank"), F.col("page").cast("long").alias("page")
    )


def history_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return K.status_counts(K.applications(changes(spark, d)))


def history_search(spark: SparkSession, d: str) -> DataFrame:
    found = K.search(K.applications(changes(spark, d)), " 1-URGENT ", "applied")
    return found.select("cand", "url", "title")


def history_newest_first(spark: SparkSession, d: str) -> DataFrame:
    return K.newest_first(K.applications(changes(spark, d))).select("cand", "id", "first_seen_us")


def history_csv(spark: SparkSession, d: str) -> DataFrame:
    return K.applications(changes(spark, d)).select("id", K.csv_line().alias("line"))


def reminders_due(spark: SparkSession, d: str) -> DataFrame:
    return K.reminders_due(K.applications(changes(spark, d)), NOW_US).select("cand", "url", "reminder_us", "message")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """orders as fill-log entries."""
    return changes(spark, d).select("cand", F.col("seq").alias("id"), F.col("ts_us").alias("at_us"), "ats", "filled", "priority")


def fill_log_ring(spark: SparkSession, d: str) -> DataFrame:
    """All orders of one priority form one log, so that the limit really bites."""
    logs = _entries(spark, d).withColumn("cand", F.col("priority")).drop("priority")
    return K.fill_log(logs).select("cand", "id", "at_us")


def outcome_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Field outcomes by domain (of the supplier), board (of the part) and tier, with totals; n_summed tells a total, shown as 'all', from a null, shown alike."""
    shown = lambda c: F.coalesce(F.col(c), F.lit("all")).alias(c)
    rates = K.outcome_rates(_outcomes(spark, d), "domain", "ats", "source", totals=True)
    return rates.select("day", *[shown(c) for c in ("domain", "ats", "source")], "fields", "filled", "review", "abstain", "failed",
                        F.col("n_summed").cast("long").alias("n_summed"))


def outcome_rates(spark: SparkSession, d: str) -> DataFrame:
    """lineitems as field outcomes of their order."""
    return K.outcome_rates(_outcomes(spark, d), "source")


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    outcome = (
        F.when(F.col("l_returnflag") == "R", "failed")
        .when(F.col("l_linestatus") == "O", "filled")
        .when(F.col("l_quantity") > 25, "review")
        .otherwise("abstain")
    )
    source = F.when(F.col("l_discount") > 0.05, "lexicon").when(F.col("l_discount") > 0.02, "adapter")
    return li.select(
        micros("l_shipdate").alias("at_us"), F.concat(F.lit("shop"), (F.col("l_suppkey") % 7).cast("string")).alias("domain"),
        F.concat(F.lit("board"), (F.col("l_partkey") % 3).cast("string")).alias("ats"),
        F.array(F.struct(source.alias("source"), outcome.alias("outcome"))).alias("outcomes"),
    )


def documents_by_role(spark: SparkSession, d: str) -> DataFrame:
    docs = changes(spark, d).select(
        "cand", F.col("seq").alias("id"), F.col("ts_us").alias("added_us"),
        F.when(F.col("ats") == "lever", "resume").otherwise("coverLetter").alias("role"),
    )
    return K.documents_by_role(docs)


def profile_last_good(spark: SparkSession, d: str) -> DataFrame:
    """orders as profile versions, valid unless their number of fields is a multiple of three."""
    versions = changes(spark, d).select(
        "cand", "ts_us", "seq", (F.col("field_count") % 3 != 0).alias("valid"), F.col("seq").alias("profile")
    )
    return K.current_profiles(versions)


def settings_merged(spark: SparkSession, d: str) -> DataFrame:
    patches = changes(spark, d).select(
        "cand", "ts_us", "seq",
        F.when(F.col("op") == "status", "DD/MM/YYYY").when(F.col("op") == "reminder", "YYYY-MM-DD")
        .alias("date_format_hint"),
        F.when(F.col("op") == "delete", F.lit(False)).when(F.col("op") == "applied", F.lit(True)).alias("auto_detect"),
    )
    return K.merged_settings(patches, {"date_format_hint": "MM/DD/YYYY", "auto_detect": True})


def answer_usage(spark: SparkSession, d: str) -> DataFrame:
    """One saved answer per customer, orders as its uses; all belong to one candidate."""
    answers = table(spark, d, "customer").select(
        F.lit(0).alias("cand"), F.col("c_custkey").alias("id"), F.lit("q").alias("question_text"), F.lit("key").alias("normalized_key"),
        F.array(F.lit("5-LOW")).alias("alias_keys"), F.lit("a").alias("answer"), F.lit(0).cast("long").alias("times_used"),
        F.lit(0).cast("long").alias("last_used_us"), F.lit(0).cast("long").alias("created_us"),
    )
    uses = table(spark, d, "orders").select(
        F.lit(0).alias("cand"), F.col("o_custkey").alias("answer_id"), micros("o_orderdate").alias("ts_us"),
        F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("question_key"),
        (F.col("o_orderstatus") == "F").alias("confirmed_fuzzy"),
    )
    used = K.answers_after_use(answers, uses)
    return used.select("id", "times_used", "last_used_us", F.array_join("alias_keys", ";").alias("aliases"))


def customers_cleared(spark: SparkSession, d: str) -> DataFrame:
    """Fill-log entries left after the customers in debt cleared theirs."""
    debt = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("cand"))
    return K.without(_entries(spark, d), debt, "cand").select("cand", "id")


QUERIES = {
    f.__name__: f
    for f in (
        history_upsert, history_page, history_status_counts, history_search, history_newest_first, history_csv,
        reminders_due, fill_log_ring, outcome_rates, outcome_rollup, documents_by_role, profile_last_good, settings_merged,
        answer_usage, customers_cleared,
    )
}

_CHANGES = """
c AS (SELECT o_custkey AS cand, o_orderkey AS seq, epoch_us(o_orderdate) AS ts_us,
        CASE WHEN o_orderstatus = 'O' THEN 'detected' WHEN o_orderstatus = 'F' THEN 'filled'
             WHEN o_totalprice > 400000 THEN 'status' WHEN o_totalprice > 300000 THEN 'reminder'
             WHEN o_totalprice < 20000 THEN 'delete' ELSE 'applied' END AS op,
        'https://jobs.example.com/' || year(o_orderdate) AS url,
        CASE WHEN o_totalprice > 250000 THEN 'lever' ELSE 'generic' END AS ats,
        CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'Role "' || o_orderpriority || '" ' || o_orderkey END AS title,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'Long text ' || o_orderkey END AS jd,
        CAST(floor(o_totalprice / 10000) AS BIGINT) AS field_count,
        CASE WHEN o_totalprice > 450000 THEN 'interviewing' ELSE 'rejected' END AS status,
        CASE WHEN o_orderpriority = '2-HIGH' THEN 0 ELSE 7 END AS reminder_days,
        o_orderpriority AS priority
      FROM orders)"""

_APPS = f"""{_CHANGES},
gone AS (SELECT cand, url, max((ts_us, seq)) AS deleted_at FROM c WHERE op = 'delete' GROUP BY cand, url),
live AS (SELECT c.*, (c.ts_us, c.seq) AS o FROM c LEFT JOIN gone g ON g.cand = c.cand AND g.url = c.url
         WHERE op <> 'delete' AND (deleted_at IS NULL OR (c.ts_us, c.seq) > deleted_at)),
firsts AS (SELECT cand, url, seq, ats, ts_us, o FROM live WHERE op IN ('detected', 'filled', 'applied')
           QUALIFY row_number() OVER (PARTITION BY cand, url ORDER BY ts_us, seq) = 1),
titles AS (SELECT cand, url, title FROM live WHERE op IN ('detected', 'filled', 'applied') AND title <> ''
           QUALIFY row_number() OVER (PARTITION BY cand, url ORDER BY ts_us DESC, seq DESC) = 1),
jds AS (SELECT cand, url, jd FROM live WHERE op IN ('detected', 'filled', 'applied') AND jd IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY cand, url ORDER BY ts_us, seq) = 1),
fills AS (SELECT cand, url, ts_us, field_count, count(*) OVER (PARTITION BY cand, url) AS n FROM live
          WHERE op = 'filled' QUALIFY row_number() OVER (PARTITION BY cand, url ORDER BY ts_us DESC, seq DESC) = 1),
states AS (SELECT cand, url, o, CASE WHEN op = 'applied' THEN 'applied' ELSE status END AS status FROM live
           WHERE op IN ('status', 'applied')
           QUALIFY row_number() OVER (PARTITION BY cand, url ORDER BY ts_us DESC, seq DESC) = 1),
reminds AS (SELECT cand, url, o, CASE WHEN reminder_days > 0 THEN ts_us + reminder_days * 86400000000 END AS due
            FROM live WHERE op = 'reminder'
            QUALIFY row_number() OVER (PARTITION BY cand, url ORDER BY ts_us DESC, seq DESC) = 1),
apps AS (SELECT f.cand, f.cand || '-' || f.seq AS id, f.url, 'jobs.example.com' AS "domain", f.ats,
           coalesce(t.title, '') AS title, f.ts_us AS first_seen_us, l.ts_us AS last_filled_us,
           coalesce(l.n, 0) AS times_filled, coalesce(l.field_count, 0) AS field_count,
           coalesce(l.field_count // 2, 0) AS filled, coalesce(l.field_count // 4, 0) AS reviewed,
           coalesce(l.field_count // 8, 0) AS failed,
           coalesce(CASE WHEN s.o >= f.o THEN s.status END, 'saved') AS status,
           CASE WHEN r.o >= f.o THEN r.due END AS reminder_us, j.jd AS jd_snippet
         FROM firsts f
         LEFT JOIN titles t ON t.cand = f.cand AND t.url = f.url
         LEFT JOIN jds j ON j.cand = f.cand AND j.url = f.url
         LEFT JOIN fills l ON l.cand = f.cand AND l.url = f.url
         LEFT JOIN states s ON s.cand = f.cand AND s.url = f.url
         LEFT JOIN reminds r ON r.cand = f.cand AND r.url = f.url)"""

_STAMP = "coalesce(strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST({0} // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z', '')"

ORACLES = {
    "history_upsert": f"WITH {_APPS} SELECT * FROM apps",
    "history_page": f"""WITH {_CHANGES},
r AS (SELECT cand, seq AS id, row_number() OVER (PARTITION BY cand ORDER BY ts_us DESC, seq) AS rank,
             count(*) OVER (PARTITION BY cand) AS total FROM c),
p AS (SELECT *, least(1, CAST(greatest(ceil(total / 15.0), 1) AS BIGINT) - 1) AS page FROM r)
SELECT cand, id, rank, page FROM p WHERE rank > page * 15 AND rank <= (page + 1) * 15""",
    "history_status_counts": f"""WITH {_APPS}
SELECT status, count(*) AS n FROM apps GROUP BY status UNION ALL SELECT 'all', count(*) FROM apps""",
    "history_search": f"""WITH {_APPS}
SELECT cand, url, title FROM apps WHERE status = 'applied' AND (contains(lower(title), '1-urgent')
  OR contains("domain", '1-urgent') OR contains(ats, '1-urgent') OR coalesce(contains(lower(jd_snippet), '1-urgent'), false))""",
    "history_newest_first": f"WITH {_APPS} SELECT cand, id, first_seen_us FROM apps ORDER BY first_seen_us DESC, id",
    "history_csv": f"""WITH {_APPS}
SELECT id, '"' || concat_ws('","', replace(title, '"', '""'), "domain", url, ats, status,
   {_STAMP.format('first_seen_us')}, {_STAMP.format('last_filled_us')}, times_filled, filled,
   {_STAMP.format('reminder_us')}) || '"' AS line FROM apps""",
    "reminders_due": f"""WITH {_APPS}
SELECT cand, url, reminder_us, coalesce(nullif(title, ''), "domain")
   || '. You planned to follow up on this application today.' AS message
FROM apps WHERE reminder_us <= {NOW_US}""",
    "fill_log_ring": f"""WITH {_CHANGES}
SELECT priority AS cand, seq AS id, ts_us AS at_us FROM c
QUALIFY row_number() OVER (PARTITION BY priority ORDER BY ts_us DESC, seq DESC) <= 50""",
    "outcome_rates": """
WITH o AS (SELECT epoch_us(l_shipdate) // 86400000000 AS day,
   CASE WHEN l_discount > 0.05 THEN 'lexicon' WHEN l_discount > 0.02 THEN 'adapter' ELSE 'none' END AS source,
   CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'O' THEN 'filled'
        WHEN l_quantity > 25 THEN 'review' ELSE 'abstain' END AS outcome FROM lineitem)
SELECT day, source, count(*) AS fields, count(*) FILTER (outcome = 'filled') AS filled,
   count(*) FILTER (outcome = 'review') AS review, count(*) FILTER (outcome = 'abstain') AS abstain,
   count(*) FILTER (outcome = 'failed') AS failed FROM o GROUP BY day, source""",
    "outcome_rollup": """
WITH o AS (SELECT epoch_us(l_shipdate) // 86400000000 AS day, 'shop' || (l_suppkey % 7) AS domain, 'board' || (l_partkey % 3) AS ats,
   CASE WHEN l_discount > 0.05 THEN 'lexicon' WHEN l_discount > 0.02 THEN 'adapter' ELSE 'none' END AS source,
   CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'O' THEN 'filled'
        WHEN l_quantity > 25 THEN 'review' ELSE 'abstain' END AS outcome FROM lineitem)
SELECT day, coalesce(domain, 'all') AS domain, coalesce(ats, 'all') AS ats, coalesce(source, 'all') AS source,
   count(*) AS fields, count(*) FILTER (outcome = 'filled') AS filled, count(*) FILTER (outcome = 'review') AS review,
   count(*) FILTER (outcome = 'abstain') AS abstain, count(*) FILTER (outcome = 'failed') AS failed,
   (GROUPING(domain) + GROUPING(ats) + GROUPING(source))::BIGINT AS n_summed
FROM o GROUP BY day, ROLLUP (domain, ats, source)""",
    "documents_by_role": f"""WITH {_CHANGES}
SELECT cand, seq AS id, ts_us AS added_us, CASE WHEN ats = 'lever' THEN 'resume' ELSE 'coverLetter' END AS role FROM c
QUALIFY row_number() OVER (PARTITION BY cand, ats ORDER BY ts_us DESC, seq DESC) = 1""",
    "profile_last_good": f"""WITH {_CHANGES},
r AS (SELECT cand, seq, field_count % 3 <> 0 AS valid,
             row_number() OVER (PARTITION BY cand ORDER BY ts_us DESC, seq DESC) AS n FROM c)
SELECT cand, coalesce(max(seq) FILTER (n = 1 AND valid), max(seq) FILTER (n = 2 AND valid)) AS profile
FROM r GROUP BY cand""",
    "settings_merged": f"""WITH {_CHANGES}
SELECT cand, coalesce(arg_max(CASE op WHEN 'status' THEN 'DD/MM/YYYY' WHEN 'reminder' THEN 'YYYY-MM-DD' END,
                              (ts_us, seq)) FILTER (op IN ('status', 'reminder')), 'MM/DD/YYYY') AS date_format_hint,
       coalesce(arg_max(op = 'applied', (ts_us, seq)) FILTER (op IN ('delete', 'applied')), true) AS auto_detect
FROM c GROUP BY cand""",
    "answer_usage": """
WITH u AS (SELECT o_custkey AS id, epoch_us(o_orderdate) AS ts, o_orderkey AS seq,
                  CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS k FROM orders),
k AS (SELECT id, k, min((ts, seq)) AS since FROM u WHERE k IS NOT NULL AND k <> '5-LOW' GROUP BY id, k),
a AS (SELECT id, string_agg(k, ';' ORDER BY since) AS s FROM k GROUP BY id),
n AS (SELECT id, count(*) AS n, max(ts) AS last FROM u GROUP BY id)
SELECT c_custkey AS id, coalesce(n, 0) AS times_used, coalesce(last, 0) AS last_used_us, '5-LOW' || coalesce(';' || s, '') AS aliases
FROM customer LEFT JOIN n ON n.id = c_custkey LEFT JOIN a ON a.id = c_custkey""",
    "customers_cleared": f"""WITH {_CHANGES}
SELECT cand, seq AS id FROM c WHERE cand NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
}
