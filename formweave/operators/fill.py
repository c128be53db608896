"""From decisions to fill instructions, and from outcomes to statistics.

decisions as from mapping.map_fields; outcomes: cand, page_id, ref, ok,
verified, error; overrides: cand, page_id, ref, value, included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.operators.options import resolve_option
from formweave.operators.spread import growing

KEYS = ["cand", "page_id", "ref"]
OPTION = "struct<value:string,text:string>"
PAYLOAD = {
    "type": "string", "value": "string", "option_text": "string", "option_value": "string",
    "options": f"array<{OPTION}>", "checked": "boolean", "file_name": "string", "mime": "string",
}
FIELD_COLUMNS = ["frame_path", "selector", "member_selectors", "kind", "widget_hint"]


def _payload(kind: str, **given: Column) -> Column:
    given["type"] = F.lit(kind)
    return F.struct(
        *[given[n].cast(t).alias(n) if n in given else F.expr(f"CAST(NULL AS {t}) AS {n}") for n, t in PAYLOAD.items()]
    )


def _picked(option: Column) -> Column:
    return _payload("option", option_text=option["text"], option_value=option["value"])


def _with_fields(decisions: DataFrame, signals: DataFrame, *extra: str) -> DataFrame:
    """Decisions with the columns of their field; many candidates may share a page's signals."""
    on = KEYS if "cand" in signals.columns else KEYS[1:]
    return decisions.join(growing(signals.select(*on, *FIELD_COLUMNS, *extra)), on)


def _with_files(rows: DataFrame, documents: DataFrame) -> DataFrame:
    files = documents.select("cand", F.col("id").alias("document_id"), F.struct("file_name", "mime").alias("file"))
    return rows.join(growing(files), ["cand", "document_id"], "left")


def _instructions(rows: DataFrame, payload: Column) -> DataFrame:
    return (
        rows.withColumn("payload", payload)
        .filter("payload IS NOT NULL")
        .select(*KEYS, *FIELD_COLUMNS, "payload", (F.col("action") != "fill").alias("amber"))
    )


def _file_payload() -> Column:
    return F.when(F.col("file").isNotNull(), _payload("file", file_name=F.col("file.file_name"), mime=F.col("file.mime")))


def instructions(decisions: DataFrame, signals: DataFrame, documents: DataFrame) -> DataFrame:
    """What to put into each field: file, check, several options, one option or text, in this order."""
    c = F.col
    rows = _with_files(_with_fields(decisions, signals), documents)
    payload = (
        F.when(c("document_id").isNotNull(), _file_payload())
        .when(c("checked").isNotNull(), _payload("check", checked=c("checked")))
        .when(F.size("options_multi") > 0, _payload("multi", options=c("options_multi")))
        .when(c("option").isNotNull(), _picked(c("option")))
        .when(c("value") != "", _payload("text", value=c("value")))
    )
    return _instructions(rows, payload)


def fill_targets(decisions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Fills of both colours, and reviews the user included that have a value; adds override."""
    chosen = overrides.select(*KEYS, F.col("value").alias("override"), "included")
    rows = decisions.join(chosen, KEYS, "left")
    wanted = F.col("included") & (F.coalesce(F.col("override"), F.col("value"), F.lit("")) != "")
    return rows.filter(
        F.col("action").isin("fill", "fill-amber") | ((F.col("action") == "review") & F.coalesce(wanted, F.lit(False)))
    ).drop("included")


def reviewed_instructions(
    targets: DataFrame, signals: DataFrame, documents: DataFrame, attempted: DataFrame | None = None
) -> DataFrame:
    """Instructions for fill_targets: a user's value is resolved against the options again,
    fields already attempted (cand, page_id, frame_path, selector) are left out, and of
    several targets on one selector only the first is tried."""
    c = F.col
    rows = _with_files(_with_fields(targets, signals, "options"), documents)
    if attempted is not None:
        rows = rows.join(attempted.select("cand", "page_id", "frame_path", "selector"),
                         ["cand", "page_id", "frame_path", "selector"], "left_anti")
    text = F.coalesce(F.nullif(c("override"), F.lit("")), c("value"), F.lit(""))
    has_options = (F.size("options") > 0) & (c("kind") != "checkbox")
    kept = c("option").isNotNull() & (F.coalesce(c("override"), F.lit("")) == "")
    desired = F.coalesce(c("override"), c("option.text"), c("value"), F.lit(""))
    rows = rows.withColumn(
        "resolved", F.when(has_options & ~kept, resolve_option(desired, c("options"))["option"]).when(kept, c("option"))
    )
    payload = (
        F.when(c("document_id").isNotNull(), _file_payload())
        .when(c("checked").isNotNull(), _payload("check", checked=c("checked")))
        .when(F.size("options_multi") > 0, _payload("multi", options=c("options_multi")))
        .when(has_options, F.when(c("resolved").isNotNull(), _picked(c("resolved"))))
        .when(text != "", _payload("text", value=text))
    )
    once = _instructions(rows, payload)
    first = once.groupBy("cand", "page_id", "frame_path", "selector").agg(F.min("ref").alias("ref"))
    return once.join(first, [*KEYS, "frame_path", "selector"], "left_semi")


def classify_outcomes(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Adds outcome (filled, failed, review, abstain), ok, verified and error to every decision."""
    rows = decisions.join(outcomes.select(*KEYS, "ok", "verified", "error"), KEYS, "left")
    outcome = (
        F.when(F.col("ok"), "filled").when(~F.col("ok"), "failed")
        .when(F.col("action") == "review", "review").otherwise("abstain")
    )
    return rows.withColumn("outcome", outcome)


def action_counts(decisions: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """ready, review and abstain fields per page; with signals, hidden fields do not count as abstained."""
    abstains = F.col("action") == "abstain"
    rows = decisions
    if signals is not None:
        on = KEYS if "cand" in signals.columns else KEYS[1:]
        rows = decisions.join(signals.select(*on, "visible"), on)
        abstains = abstains & F.col("visible")
    return rows.groupBy("cand", "page_id").agg(
        F.count_if(F.col("action").isin("fill", "fill-amber")).alias("ready"),
        F.count_if(F.col("action") == "review").alias("review"),
        F.count_if(abstains).alias("abstained"),
    )


def fill_stats(classified: DataFrame) -> DataFrame:
    """Counters per page of classify_outcomes rows."""
    return classified.groupBy("cand", "page_id").agg(
        F.count("*").alias("field_count"),
        F.count_if(F.col("ok") & F.col("verified")).alias("filled"),
        F.count_if(F.col("action") == "review").alias("reviewed"),
        F.count_if(F.col("action") == "abstain").alias("abstained"),
        F.count_if(~F.col("ok")).alias("failed"),
    )


def answer_uses(classified: DataFrame, signals: DataFrame, overrides: DataFrame) -> DataFrame:
    """Saved answers that were applied unchanged: cand, answer_id, label, confirmed_fuzzy."""
    on = KEYS if "cand" in signals.columns else KEYS[1:]
    changed = overrides.filter("value <> ''").select(*KEYS)
    return (
        classified.filter("ok AND saved_answer_id IS NOT NULL")
        .join(changed, KEYS, "left_anti")
        .join(signals.select(*on, "label"), on)
        .select("cand", F.col("saved_answer_id").alias("answer_id"), "label",
                (F.col("source") == "answer-fuzzy").alias("confirmed_fuzzy"))
    )
