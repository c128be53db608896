"""Is a page a job application form?  A transparent score per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.functions.fields import lexicon_key
from formweave.functions.text import normalize_label
from formweave.functions.urls import URL_TOKENS

# Points and threshold of the classifier.
THRESHOLD = 6
COVERAGE = [(5, 3), (3, 2), (2, 1)]  # recognised fields, points
TOO_FEW = "fewer than 2 visible fields"
# end of fixed values


def classify_forms(pages: DataFrame, signals: DataFrame) -> DataFrame:
    """page_id, score, is_application, reasons for every page.

    pages: page_id, url, title.  Signals reduce to a few counters per page
    with map-side combine before they meet the pages.
    """
    label = F.coalesce(F.col("label"), F.lit(""))
    kind = F.col("kind")
    seen = (
        signals.filter(F.coalesce(F.col("visible"), F.lit(True)))
        .select(
            "page_id", "kind", "autocomplete", "accept", label.alias("label"), normalize_label(label).alias("norm"),
            normalize_label(F.coalesce(F.col("section_heading"), F.lit(""))).alias("section"),
        )
        .withColumn("key", lexicon_key("norm", "section"))
    )
    resume = (kind == "file") & (
        F.col("label").rlike(r"(?i)resume|cv|curriculum") | F.coalesce(F.col("accept").rlike(r"(?i)pdf|doc"), F.lit(False))
    )
    mail = (kind == "email") | F.coalesce(F.col("autocomplete") == "email", F.lit(False)) | F.col("label").rlike(r"(?i)e-?mail")
    sensitive = F.coalesce(F.col("key").startswith("eeo.") | F.col("key").startswith("preferences."), F.lit(False))
    counters = seen.groupBy("page_id").agg(
        F.count("*").alias("visible"),
        F.count_if(kind == "file").alias("files"),
        F.count_if(resume).alias("resumes"),
        F.count("key").alias("known"),
        F.count_if(sensitive).alias("sensitive"),
        F.count_if(mail).alias("mails"),
        F.count_if(F.col("label").rlike(r"(?i)password|card number|cvv|coupon")).alias("negatives"),
    )
    c = F.col
    points: list[tuple[Column, Column | int, Column]] = []

    def rule(when: Column, score: int, text: Column | str) -> Column:
        reason = F.lit(text) if isinstance(text, str) else text
        points.append(F.when(when, F.lit(score)).otherwise(0))
        return F.when(when, F.concat(F.lit(f"{score:+d} "), reason))

    covered = F.concat(c("known").cast("string"), F.lit(" recognized application fields"))
    coverage, above = [], F.lit(False)
    for at_least, score in COVERAGE:
        coverage.append(rule((c("known") >= at_least) & ~above, score, covered))
        above = c("known") >= at_least
    by_url = F.coalesce(c("url").rlike(URL_TOKENS), F.lit(False))
    by_title = F.coalesce(c("title").rlike(URL_TOKENS), F.lit(False))
    reasons = [
        rule(c("resumes") > 0, 3, "resume/CV upload field"),
        rule((c("resumes") == 0) & (c("files") > 0), 1, "file upload field"),
        F.coalesce(*coverage),
        rule(c("sensitive") > 0, 2, "work-authorization/EEO questions present"),
        rule(c("mails") > 0, 1, "email field"),
        rule(by_url, 2, "application-like URL"),
        rule(~by_url & by_title, 1, "application-like title"),
        rule(c("negatives") > 0, -4, "password/payment fields present"),
    ]
    total = points[0]
    for p in points[1:]:
        total = total + p
    few = F.coalesce(c("visible"), F.lit(0)) < 2
    return (
        pages.select("page_id", "url", "title")
        .join(counters, "page_id", "left")
        .withColumn("score", F.when(few, F.lit(0)).otherwise(total))
        .select(
            "page_id", "score", (c("score") >= THRESHOLD).alias("is_application"),
            F.when(few, F.array(F.lit(TOO_FEW))).otherwise(F.array_compact(F.array(*reasons))).alias("reasons"),
        )
    )
