"""Application history, fill logs, answers usage, documents, profiles, settings.

Current state is always a fold of change rows: one aggregation per key with
map-side combine, ordered by (ts_us, seq).

Change rows: cand, seq, ts_us, op (detected, filled, applied, status,
reminder, delete), url, ats, title, jd, field_count, filled, reviewed,
failed, status, reminder_days, and optionally fills (how many fills a
compacted row stands for).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formweave.functions.dates import iso_utc_ms
from formweave.functions.urls import canonical_url, url_host

FILL_LOG_LIMIT = 50
PAGE_SIZE = 15
TITLE_LIMIT = 200
JD_LIMIT = 6000
STATUSES = ["saved", "applied", "interviewing", "offer", "rejected"]
CSV_HEADER = "title,company_domain,url,ats,status,first_seen,last_filled,times_filled,fields_filled,reminder"
UPSERTS = ["detected", "filled", "applied"]
US_PER_DAY = 86_400_000_000


def _order() -> Column:
    return F.struct("ts_us", "seq")


def _since_delete(rows: DataFrame) -> DataFrame:
    """Rows from the last delete of their URL on, that delete included.

    Deletes are rare and reduced to one row per URL; adaptive execution sees
    their size and decides on the join.
    """
    deleted = rows.filter("op = 'delete'").groupBy("cand", "url").agg(F.max(_order()).alias("deleted_at"))
    later = F.col("deleted_at").isNull() | (_order() >= F.col("deleted_at"))
    return rows.join(deleted, ["cand", "url"], "left").filter(later).drop("deleted_at")


def compact_changes(changes: DataFrame) -> DataFrame:
    """The few change rows per URL that give the same applications as all of them.

    Kept as the state of a stream: at most seven rows per (cand, url).  Fills
    are counted on their last row, so a delete must not arrive after fills
    that happened later than it.
    """
    rows = changes.withColumn("url_key", canonical_url(F.col("url")))
    if "fills" not in rows.columns:
        rows = rows.withColumn("fills", F.when(F.col("op") == "filled", F.lit(1)).otherwise(0).cast("long"))
    live = _since_delete(rows.withColumn("raw", F.col("url")).withColumn("url", F.col("url_key")))
    op, order = F.col("op"), _order()
    upsert = op.isin(UPSERTS)
    last = lambda cond: F.max(F.when(cond, order))
    first = lambda cond: F.min(F.when(cond, order))
    picks = live.groupBy("cand", "url").agg(
        F.array_compact(
            F.array(
                first(upsert), last(upsert & (F.col("title") != "")), first(upsert & (F.col("jd") != "")),
                last(op == "filled"), last(op.isin("status", "applied")), last(op == "reminder"), last(op == "delete"),
            )
        ).alias("keep"),
        last(op == "filled").alias("last_fill"),
        F.sum("fills").alias("all_fills"),
    )
    return (
        live.join(picks, ["cand", "url"])
        .filter(F.array_contains("keep", order))
        .withColumn("fills", F.when(order == F.col("last_fill"), F.col("all_fills")).otherwise(0))
        .withColumn("url", F.col("raw"))
        .drop("keep", "last_fill", "all_fills", "raw", "url_key")
    )


def applications(changes: DataFrame) -> DataFrame:
    """One row per (cand, canonical url).

    Identity fields come from the first upsert, title from the last non-empty
    one, the job text from the first non-empty one, counters from the last
    fill.  Status and reminder rows for a URL not yet upserted are ignored;
    a delete forgets everything before it.
    """
    rows = changes.withColumn("raw_url", F.col("url")).withColumn("url", canonical_url(F.col("url")))
    op, order = F.col("op"), _order()
    live = _since_delete(rows).filter(op != "delete")
    upsert, fill = op.isin(UPSERTS), op == "filled"
    fills = F.when(fill, F.col("fills") if "fills" in changes.columns else F.lit(1))
    sets_status = op.isin("status", "applied")
    new_status = F.when(op == "applied", F.lit("applied")).otherwise(F.col("status"))
    due = F.when(F.col("reminder_days") == 0, F.lit(None)).otherwise(
        F.col("ts_us") + F.col("reminder_days") * US_PER_DAY
    )
    first = F.struct("seq", "ats", "ts_us", url_host(F.col("raw_url")).alias("domain"))
    stats = F.struct("ts_us", "field_count", "filled", "reviewed", "failed")
    pick = lambda cond, value: F.when(cond, value)  # noqa: E731  a null order is skipped by min_by and max_by
    folded = live.groupBy("cand", "url").agg(
        F.min_by(first, pick(upsert, order)).alias("first"),
        F.max(pick(upsert, order)).alias("last_upsert"),
        F.min(pick(upsert, order)).alias("first_upsert"),
        F.max_by("title", pick(upsert & (F.col("title") != ""), order)).alias("title"),
        F.min_by("jd", pick(upsert & (F.col("jd") != ""), order)).alias("jd"),
        F.max_by(stats, pick(fill, order)).alias("stats"),
        F.coalesce(F.sum(fills), F.lit(0)).alias("times_filled"),
        F.max_by(F.struct(order.alias("at"), new_status.alias("value")), pick(sets_status, order)).alias("set"),
        F.max_by(F.struct(order.alias("at"), due.alias("value")), pick(op == "reminder", order)).alias("remind"),
    )
    after = lambda c: F.col(f"{c}.at") >= F.col("first_upsert")
    zero = lambda c: F.coalesce(F.col(f"stats.{c}"), F.lit(0)).alias(c)
    return folded.filter(F.col("first_upsert").isNotNull()).select(
        "cand",
        F.concat_ws("-", F.col("cand"), F.col("first.seq")).alias("id"),
        "url",
        F.col("first.domain").alias("domain"),
        F.col("first.ats").alias("ats"),
        F.substring(F.coalesce("title", F.lit("")), 1, TITLE_LIMIT).alias("title"),
        F.col("first.ts_us").alias("first_seen_us"),
        F.col("stats.ts_us").alias("last_filled_us"),
        "times_filled",
        zero("field_count"),
        zero("filled"),
        zero("reviewed"),
        zero("failed"),
        F.coalesce(F.when(after("set"), F.col("set.value")), F.lit("saved")).alias("status"),
        F.when(after("remind"), F.col("remind.value")).alias("reminder_us"),
        F.substring("jd", 1, JD_LIMIT).alias("jd_snippet"),
    )


def reminders_due(apps: DataFrame, now_us: int) -> DataFrame:
    """Applications whose follow-up time has come, with the text to show."""
    subject = F.coalesce(F.nullif("title", F.lit("")), F.col("domain"))
    message = F.concat(subject, F.lit(". You planned to follow up on this application today."))
    return apps.filter(F.col("reminder_us") <= now_us).select(
        "cand", "id", "url", "reminder_us", message.alias("message")
    )


def search(apps: DataFrame, query: str = "", status: str | None = None) -> DataFrame:
    """Case-insensitive substring over title, host, board and job text, and a status."""
    q = query.strip().lower()
    if status and status != "all":
        apps = apps.filter(F.col("status") == status)
    if not q:
        return apps
    hits = [F.coalesce(F.lower(c).contains(q), F.lit(False)) for c in ("title", "domain", "ats", "jd_snippet")]
    return apps.filter(hits[0] | hits[1] | hits[2] | hits[3])


def newest_first(rows: DataFrame, at: str = "first_seen_us", tie: str = "id") -> DataFrame:
    return rows.orderBy(F.col(at).desc(), F.col(tie))


def history_page(apps: DataFrame, page: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """One page of each candidate's list, newest first; a page past the end shows the last one.

    Only ranks up to the page's end are needed, so each map task keeps that
    many rows per candidate before the shuffle; list lengths come from a
    combining count.
    """
    newest = Window.partitionBy("cand").orderBy(F.col("first_seen_us").desc(), "id")
    top = apps.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= (page + 1) * size)
    totals = apps.groupBy("cand").agg(F.count("*").alias("total"))
    last = F.greatest(F.ceil(F.col("total") / size), F.lit(1)) - 1
    return (
        top.join(totals, "cand")
        .withColumn("page", F.least(F.lit(page), last))
        .filter((F.col("rank") > F.col("page") * size) & (F.col("rank") <= (F.col("page") + 1) * size))
    )


def status_counts(apps: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts per status and in total ('all')."""
    return (
        apps.select(*by, F.explode(F.array("status", F.lit("all"))).alias("status"))
        .groupBy(*by, "status")
        .agg(F.count("*").alias("n"))
    )


def fill_log(entries: DataFrame, limit: int = FILL_LOG_LIMIT) -> DataFrame:
    """The newest `limit` entries per candidate."""
    newest = Window.partitionBy("cand").orderBy(F.col("at_us").desc(), F.col("id").desc())
    return entries.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= limit).drop("_rank")


def outcome_rates(entries: DataFrame, *by: str, totals: bool = False) -> DataFrame:
    """Numbers of filled, review, abstain and failed outcomes per day and the given columns.

    With `totals` also per day and each shorter list of these columns, down
    to the day alone; columns summed over are null, and n_summed says how
    many of the last ones are (a null in the others is a value).  Outcomes
    without a time are the day null.
    """
    o = entries.select("at_us", "domain", "ats", F.explode("outcomes").alias("o")).select(
        F.floor(F.col("at_us") / US_PER_DAY).alias("day"), "domain", "ats",
        F.coalesce("o.source", F.lit("none")).alias("source"), F.col("o.outcome").alias("outcome"),
    )
    share = lambda v: F.count_if(F.col("outcome") == v).alias(v)
    counts = [F.count("*").alias("fields"), *[share(v) for v in ("filled", "review", "abstain", "failed")]]
    if not totals:
        return o.groupBy("day", *by).agg(*counts)
    # unlike a rollup's, all these sets hold the day
    sets = [["day", *by[:n]] for n in range(len(by), -1, -1)]
    summed = sum((F.grouping(c).cast("int") for c in by), F.lit(0))
    return o.groupingSets(sets, "day", *by).agg(*counts, summed.alias("n_summed"))


def csv_quote(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line() -> Column:
    stamp = lambda c: iso_utc_ms(F.floor(F.col(c) / 1000))
    cells = [
        F.col("title"), F.col("domain"), F.col("url"), F.col("ats"), F.col("status"),
        stamp("first_seen_us"), stamp("last_filled_us"), F.col("times_filled"), F.col("filled"),
        stamp("reminder_us"),
    ]
    return F.concat_ws(",", *[csv_quote(c) for c in cells])


def without(rows: DataFrame, removed: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not among the removed ones; with key `cand` alone it clears a candidate."""
    return rows.join(removed.select(*keys), list(keys), "left_anti")


def documents_by_role(documents: DataFrame) -> DataFrame:
    """The latest document per candidate and role."""
    latest = Window.partitionBy("cand", "role").orderBy(F.col("added_us").desc(), F.col("id").desc())
    return documents.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank")


def current_profiles(versions: DataFrame) -> DataFrame:
    """The last saved profile if valid, else the one before it, else an empty one (null).

    versions: cand, ts_us, seq (which of the same time is later), valid, profile.  At most two rows per candidate
    and map task are shuffled.
    """
    newest = Window.partitionBy("cand").orderBy(F.col("ts_us").desc(), F.col("seq").desc())
    two = versions.withColumn("_rank", F.row_number().over(newest)).filter("_rank <= 2")
    usable = F.when(F.col("valid"), F.col("_rank"))
    return two.groupBy("cand").agg(F.min_by("profile", usable).alias("profile"))


def merged_settings(patches: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Field-wise last non-null value over the defaults."""
    order = _order()
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order))
    return patches.groupBy("cand").agg(
        *[F.coalesce(last(c), F.lit(v)).alias(c) for c, v in defaults.items()]
    )


def answers_after_use(answers: DataFrame, uses: DataFrame) -> DataFrame:
    """Add usage counts, last use and the aliases learnt from confirmed fuzzy matches.

    uses: cand, answer_id, ts_us, seq, question_key, confirmed_fuzzy.  Aliases
    reduce to distinct keys with their first time before any list is built.
    """
    per_key = (
        uses.withColumn("learnt", F.when(F.col("confirmed_fuzzy"), F.col("question_key")))
        .groupBy("cand", "answer_id", "learnt")
        .agg(F.count("*").alias("n"), F.max("ts_us").alias("last_us"), F.min(_order()).alias("since"))
    )
    per_answer = per_key.groupBy("cand", "answer_id").agg(
        F.sum("n").alias("n"),
        F.max("last_us").alias("last_us"),
        F.array_sort(F.collect_list(F.when(F.col("learnt").isNotNull(), F.struct("since", "learnt")))).alias("keys"),
    )
    grown = F.array_distinct(F.concat("alias_keys", F.transform("keys", lambda k: k["learnt"])))
    aliases = F.filter(grown, lambda k: (k != F.col("normalized_key")) | F.array_contains("alias_keys", k))
    return (
        answers.join(per_answer, (answers.cand == per_answer.cand) & (answers.id == per_answer.answer_id), "left")
        .select(
            answers.cand, "id", "question_text", "normalized_key",
            F.when(F.col("n").isNull(), F.col("alias_keys")).otherwise(aliases).alias("alias_keys"),
            "answer",
            (F.col("times_used") + F.coalesce("n", F.lit(0))).alias("times_used"),
            F.coalesce("last_us", F.col("last_used_us")).alias("last_used_us"),
            "created_us",
        )
    )
