"""Saving answers: merge a question into an existing answer or add a new one.

Applying saves one after the other is order dependent, but most of that order
does not matter.  A question key is placed once, when first seen; later saves
of the key only replace text.  So saves reduce to one row per (cand, key)
first, similar keys are found by the lossless join, and only the choice of
which keys found an answer of their own ("leaders") is iterated: a key leads
unless an earlier leader is similar to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formweave.functions.text import normalize_label, trigram_jaccard
from formweave.operators.containment import bits_of, has_bit
from formweave.operators.retrieval import DEDUP_THRESHOLD, NUMBER_WORDS, answer_keys, similar_numbers, similar_pairs, text_number
from formweave.operators.spread import growing
from formweave.session import checkpoint_dir, release

KEY = ["cand", "key"]


def _leaders(pairs: DataFrame) -> DataFrame:
    """(cand, key, leads) for every key that has an earlier similar key.

    pairs: cand, key, other, fixed; `other` came before `key`; `fixed` others
    lead by definition.  Each round settles every key whose earlier
    neighbours are settled, so the rounds are as many as the longest chain of
    similar keys, not as the keys.  The settled table is cut from its lineage
    by a checkpoint in the session's shared folder.
    """
    edges = pairs.select(*KEY, "other", "fixed").checkpoint()
    waiting = edges.select(*KEY).distinct()
    settled = waiting.limit(0).withColumn("leads", F.lit(True))
    while True:
        known = settled.select("cand", F.col("key").alias("other"), "leads")
        # a neighbour that waits for nobody has no edges of its own and leads
        open_keys = waiting.join(settled, KEY, "left_anti")
        still_open = open_keys.select("cand", F.col("key").alias("other"), F.lit(True).alias("open"))
        state = (
            edges.join(open_keys, KEY, "left_semi")
            .join(known, ["cand", "other"], "left")
            .join(still_open, ["cand", "other"], "left")
            .withColumn("led", F.col("fixed") | (F.col("open").isNull() & F.coalesce(F.col("leads"), F.lit(True))))
            .withColumn("unsure", ~F.col("fixed") & F.col("open").isNotNull())
            .groupBy(*KEY)
            .agg(F.bool_or("led").alias("led"), F.bool_or("unsure").alias("unsure"))
        )
        fresh = state.filter("led OR NOT unsure").select(*KEY, (~F.col("led")).alias("leads")).checkpoint()
        if fresh.isEmpty():
            return settled
        settled = settled.unionByName(fresh)


def _similar_before(keyed: DataFrame, existing: DataFrame, threshold: float) -> DataFrame:
    """(cand, key, other, fixed, score, other_first): new keys with the similar keys that came before them, existing or new.

    All that is compared reads the one shuffle that makes the keys distinct;
    of texts only those that may be similar to another are sent again.
    """
    keys = keyed.groupBy(*KEY).agg(F.min(F.struct("ts_us", "seq")).alias("first"))
    # never null, but so no reader can do with less than the shuffle has, or filter before it
    fresh = keys.select("cand", F.when(F.col("first").isNotNull(), F.col("key")).alias("key"), "first")
    some_old = not existing.isEmpty()
    if some_old:
        fresh = fresh.join(growing(answer_keys(existing).select(*KEY)), KEY, "left_anti")
    near = similar_numbers(fresh.select(F.col("cand").alias("grp"), F.col("key").alias("text")), threshold)

    asked = bits_of(near.select(F.explode(F.array("a", "b")).alias("e")), NUMBER_WORDS)
    numbered = fresh.withColumn("a", text_number(F.col("cand"), F.col("key")))
    first = numbered.filter(has_bit(asked, F.col("a"), NUMBER_WORDS))
    other = first.select(F.col("a").alias("b"), F.col("cand").alias("_cand"), F.col("key").alias("other"), F.col("first").alias("other_first"))
    scored = (
        near.join(growing(first), "a").join(growing(other), "b").filter("cand = _cand AND key <> other")
        .withColumn("score", trigram_jaccard(F.col("key"), F.col("other"))).filter(F.col("score") >= threshold)
    )
    ends = lambda x, y: F.struct(F.col(x).alias("key"), F.col(y).alias("other"))
    turned = F.when(F.col("other_first") < F.col("first"), ends("key", "other")).when(F.col("first") < F.col("other_first"), ends("other", "key"))
    pairs = scored.withColumn("p", turned).filter("p IS NOT NULL").select(
        "cand", "p.key", "p.other", F.lit(False).alias("fixed"), "score", F.least("first", "other_first").alias("other_first")
    ).distinct()
    if some_old:
        side = lambda df, name: df.select(F.col("cand").alias("grp"), F.col(name).alias("text"))
        old = existing.select("cand", "normalized_key").distinct()
        when = pairs.schema["other_first"].dataType
        pairs = pairs.unionByName(
            similar_pairs(side(fresh, "key"), side(old, "normalized_key"), threshold, tokens=False).select(
                F.col("grp").alias("cand"), F.col("text").alias("key"), "other", F.lit(True).alias("fixed"), "score",
                F.lit(None).cast(when).alias("other_first"),
            )
        )
    return pairs.checkpoint()


def save_answers(saves: DataFrame, existing: DataFrame, threshold: float = DEDUP_THRESHOLD) -> DataFrame:
    """The answers table after all saves in (ts_us, seq) order.

    saves: cand, seq, ts_us, question, answer.  A save goes to the answer that
    carries its key or alias, else to the most similar one by trigrams, else
    it makes a new answer.  Answers scan existing ones first, by id, then new
    ones in the order they were made.

    A key's saves are brought together by 128 bits of its hashes.  A key alone
    in its answer is that answer; only the others are gathered by answer.
    """
    checkpoint_dir(saves.sparkSession)
    keyed = saves.withColumn("key", normalize_label(F.col("question"))).filter("cand IS NOT NULL AND question IS NOT NULL")
    pairs = _similar_before(keyed, existing, threshold)
    release(saves.sparkSession)
    settled = _leaders(pairs)
    release(saves.sparkSession)
    followers = settled.filter("NOT leads").select(*KEY)
    owners = existing.groupBy("cand", "normalized_key").agg(F.min("id").alias("id"))

    # followers join the most similar leader; existing answers come first on a tie
    not_leading = followers.select("cand", F.col("key").alias("other"))
    choice = (
        pairs.join(followers, KEY, "left_semi")
        .join(not_leading, ["cand", "other"], "left_anti")
        .join(owners.select("cand", F.col("normalized_key").alias("other"), F.col("id").alias("old_id")), ["cand", "other"], "left")
        .groupBy(*KEY)
        .agg(F.min(F.struct(
            (-F.col("score")).alias("s"), (~F.col("fixed")).alias("made"), "old_id", "other_first", "other"
        )).alias("c"))
    )
    new_id = lambda first: F.concat_ws("-", F.col("cand"), F.col(f"{first}.seq"))
    follows = choice.withColumn("first", F.col("c.other_first")).select(
        *KEY, F.coalesce(F.col("c.old_id"), new_id("first")).alias("home")
    )
    hashes = [F.xxhash64("key").alias("n1"), F.xxhash64(F.lit(1), "key").alias("n2")]
    mine = ["cand", "n1", "n2"]
    homes = answer_keys(existing).select(*KEY, F.col("id").alias("home")).unionByName(follows).select("cand", *hashes, "home")

    # the key is that of any of its questions, so it is not sent; all that follows reads one shuffle
    per_key = keyed.groupBy("cand", *hashes).agg(
        F.min(F.struct("ts_us", "seq")).alias("first"),
        F.max(F.struct("ts_us", "seq", "question", "answer")).alias("last"),
    ).filter("last IS NOT NULL")
    homed = per_key.join(growing(homes), mine, "left").withColumn("id", F.coalesce("home", new_id("first"))).drop("home")
    none = F.lit(None).cast("long")
    ids = homed.select(*mine, "id").unionByName(existing.select("cand", none.alias("n1"), none.alias("n2"), "id"))
    shared = ids.groupBy("cand", "id").agg(F.collect_list(F.struct("n1", "n2")).alias("k")).filter(F.size("k") > 1)
    crowded = shared.select("cand", F.explode("k").alias("k")).select("cand", "k.n1", "k.n2", F.lit(True).alias("crowded"))
    placed = homed.join(growing(crowded), mine, "left").withColumn("key", normalize_label(F.col("last.question")))

    alone = placed.filter("crowded IS NULL").select(
        "cand", "id", F.col("last.question").alias("question_text"), F.col("key").alias("normalized_key"),
        F.array().cast("array<string>").alias("alias_keys"), F.col("last.answer").alias("answer"),
        F.lit(0).cast("long").alias("times_used"), F.col("last.ts_us").alias("last_used_us"), F.col("first.ts_us").alias("created_us"),
    )
    # fold the keys of each other answer
    touched = (
        placed.filter("crowded")
        .groupBy("cand", "id")
        .agg(
            F.array_sort(F.collect_list(F.struct("first", "key"))).alias("keys"),
            F.max("last").alias("last"),
            F.min(F.struct("first", "key")).alias("origin"),
        )
    )
    merged = existing.join(touched, ["cand", "id"], "full")
    made = F.col("normalized_key").isNull()
    norm = F.coalesce(F.col("normalized_key"), F.col("origin.key"))
    aliases = F.array_distinct(
        F.concat(
            F.coalesce(F.col("alias_keys"), F.array().cast("array<string>")),
            F.filter(
                F.coalesce(F.transform("keys", lambda k: k["key"]), F.array().cast("array<string>")), lambda k: k != norm
            ),
        )
    )
    folded = merged.select(
        "cand", "id",
        F.coalesce("last.question", "question_text").alias("question_text"),
        norm.alias("normalized_key"),
        aliases.alias("alias_keys"),
        F.coalesce("last.answer", "answer").alias("answer"),
        F.coalesce(F.col("times_used"), F.lit(0)).cast("long").alias("times_used"),
        F.coalesce("last.ts_us", "last_used_us").alias("last_used_us"),
        F.when(made, F.col("origin.first.ts_us")).otherwise(F.col("created_us")).alias("created_us"),
    )
    return folded.unionByName(alone)


def saves_from_review(decisions, signals, overrides) -> DataFrame:
    """Answers the user ticked to save: cand, question, answer.

    overrides: cand, page_id, ref, value, save.
    """
    keys = ["cand", "page_id", "ref"]
    on = keys if "cand" in signals.columns else keys[1:]
    final = F.coalesce(F.nullif(F.col("override"), F.lit("")), F.col("value"), F.lit(""))
    return (
        decisions.join(overrides.filter("save").select(*keys, F.col("value").alias("override")), keys)
        .join(signals.select(*on, "label"), on)
        .withColumn("answer", final)
        .filter("answer <> '' AND label <> ''")
        .select("cand", F.col("label").alias("question"), "answer")
    )
