"""Candidate profiles as (cand, key, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.functions.text import dial_for_country, dial_from_phone, trim_ws

WORK_KEYS = ["company", "title", "start", "description"]
EDUCATION_KEYS = ["school", "degree", "field", "start", "end", "gpa"]
# profile member -> canonical key of the explicit settings
EXPLICIT_KEYS = {
    **{k: f"preferences.{k}" for k in (
        "workAuth", "requiresSponsorship", "salary", "salaryMin", "salaryMax", "startDate", "relocation",
        "remote", "noticePeriod",
    )},
    **{k: f"eeo.{k}" for k in ("gender", "race", "hispanic", "veteran", "disability")},
}


def _entries() -> Column:
    """Array of (key, text, values, bool_value, explicit) of a profile; keys without a value are left out.

    The most recent work and education entries are the first ones.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    part = lambda group, name: text(F.col(f"{group}.{name}"))
    work, edu = F.get("work", F.lit(0)), F.get("education", F.lit(0))
    none_list, none_bool = F.lit(None).cast("array<string>"), F.lit(None).cast("boolean")

    def row(key: str, value: Column, explicit: bool = False, values: Column = none_list, flag: Column = none_bool):
        return F.struct(
            F.lit(key).alias("key"), value.alias("text"), values.alias("values"), flag.alias("bool_value"),
            F.lit(explicit).alias("explicit"),
        )

    plain = lambda key, value: row(key, trim_ws(value))
    first, last = part("basics", "firstName"), part("basics", "lastName")
    phone = part("basics", "phone")
    dial = F.coalesce(dial_from_phone(phone), dial_for_country(part("location", "country")))
    place = F.array_remove(F.array(*[part("location", p) for p in ("city", "region", "country")]), "")
    website = F.coalesce(F.nullif(part("links", "website"), F.lit("")), part("links", "portfolio"))
    rows = [
        plain("basics.firstName", first),
        plain("basics.lastName", last),
        plain("basics.fullName", F.concat_ws(" ", first, last)),
        plain("basics.email", part("basics", "email")),
        plain("basics.phone", phone),
        plain("basics.phoneCountryCode", F.concat(F.lit("+"), dial)),
        plain("basics.pronouns", part("basics", "pronouns")),
        *[plain(f"location.{p}", part("location", p)) for p in ("street", "city", "region", "country", "postalCode")],
        plain("location.full", F.array_join(place, ", ")),
        *[plain(f"links.{p}", part("links", p)) for p in ("linkedin", "github", "portfolio")],
        plain("links.website", website),
        *[plain(f"work.{p}", text(work[p])) for p in WORK_KEYS],
        plain("work.end", F.when(work["current"], F.lit("")).otherwise(text(work["end"]))),
        row("work.current", F.when(work.isNotNull(), F.when(work["current"], "Yes").otherwise("No")),
            flag=F.coalesce(work["current"], F.lit(False))),
        *[plain(f"education.{p}", text(edu[p])) for p in EDUCATION_KEYS],
        row("skills.list", F.array_join("skills", ", "), values=F.col("skills")),
        *[row(key, trim_ws(part("explicit", name)), explicit=True) for name, key in EXPLICIT_KEYS.items()],
    ]
    has_value = lambda e: (e["text"] != "") | (F.size(e["values"]) > 0)
    return F.filter(F.array(*rows), has_value)


def profile_values(profiles: DataFrame) -> DataFrame:
    """cand, key, text, values, bool_value, explicit; keys without a value have no row.

    A narrow step: each profile unfolds into at most 47 rows where it lies.
    """
    return profiles.select("cand", F.inline(_entries()))


def value_maps(profiles: DataFrame) -> DataFrame:
    """cand, by_key: a map of the rows of profile_values, so that a profile stays one row."""
    entry = lambda e: F.struct(e["key"], e.dropFields("key"))
    return profiles.select("cand", F.map_from_entries(F.transform(_entries(), entry)).alias("by_key"))


def ready(profiles: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Profiles with an e-mail or first name whose owner has not switched detection off."""
    named = (F.coalesce(F.col("basics.email"), F.lit("")) != "") | (F.coalesce(F.col("basics.firstName"), F.lit("")) != "")
    out = profiles.filter(named)
    if settings is None:
        return out
    off = settings.filter(~F.col("auto_detect")).select("cand")
    return out.join(off, "cand", "left_anti")
