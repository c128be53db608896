"""Resolving a wanted value against the options a field really offers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formweave.functions.text import bind, meaning_keys, normalize_label, tokens_of


def prepared(options: Column) -> Column:
    """Options with the forms the three tiers compare."""
    return F.transform(
        options,
        lambda o: F.struct(
            F.struct(o["value"].alias("value"), o["text"].alias("text")).alias("option"),
            F.concat(meaning_keys(o["text"]), meaning_keys(o["value"])).alias("keys"),
            normalize_label(o["text"]).alias("norm"),
            tokens_of(normalize_label(F.concat_ws(" ", o["text"], o["value"]))).alias("words"),
        ),
    )


def resolve_prepared(desired: Column, options: Column) -> Column:
    """struct(option, quality) or null.

    First an option of the same meaning; else the only option that contains
    or is contained in the value; else the only one holding all its words.
    """
    hit = lambda found, quality: F.struct(
        F.get(found, F.lit(0))["option"].alias("option"), F.lit(quality).alias("quality")
    )
    want = F.struct(
        meaning_keys(desired).alias("keys"),
        normalize_label(desired).alias("norm"),
        tokens_of(normalize_label(desired)).alias("words"),
    )

    def by_words(w: Column) -> Column:
        found = F.filter(options, lambda o: F.size(F.array_except(w["words"], o["words"])) == 0)
        return bind(found, lambda f: F.when(F.size(f) == 1, hit(f, "substring")))

    def by_part(w: Column) -> Column:
        found = F.filter(
            options,
            lambda o: (o["norm"] != "") & (F.contains(o["norm"], w["norm"]) | F.contains(w["norm"], o["norm"])),
        )
        return bind(found, lambda f: F.when(F.size(f) == 1, hit(f, "substring")))

    def by_meaning(w: Column) -> Column:
        found = F.filter(options, lambda o: F.arrays_overlap(o["keys"], w["keys"]))
        return bind(found, lambda f: F.when(F.size(f) > 0, hit(f, "exact")))

    return bind(want, lambda w: F.when(w["norm"] != "", F.coalesce(by_meaning(w), by_part(w), by_words(w))))


def resolve_option(desired: Column, options: Column) -> Column:
    return bind(prepared(options), lambda p: resolve_prepared(desired, p))


def resolve_each(wanted: Column, options: Column) -> Column:
    """struct(options, quality) for a list of wanted values, or null when none matches.

    Matched options keep the wanted order and appear once by value; the
    quality is exact only when every match is.
    """
    def found_in(p: Column) -> Column:
        return F.filter(F.transform(wanted, lambda w: resolve_prepared(w, p)), lambda m: m.isNotNull())

    def distinct(m: Column) -> Column:
        chosen = F.transform(m, lambda x: x["option"])
        values = F.transform(m, lambda x: x["option"]["value"])
        return F.filter(chosen, lambda o, i: F.array_position(values, o["value"]) == i + 1)

    return bind(
        bind(prepared(options), found_in),
        lambda m: F.when(
            F.size(m) > 0,
            F.struct(
                distinct(m).alias("options"),
                F.when(F.forall(m, lambda x: x["quality"] == "exact"), "exact").otherwise("substring").alias("quality"),
            ),
        ),
    )
