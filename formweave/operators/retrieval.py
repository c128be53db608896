"""Finding saved answers by question: exact keys, then set similarity.

The similarity join is lossless.  Two sets that are similar enough are equal
in one of the parts they are dealt into (`set_signatures`), so rows of parts
meet by a hash of the part's elements; sizes and parities of the sets then
leave few pairs that are not similar, and only these are scored, on their
texts.

Parts are counted by hash buckets on both sides: rows of buckets that the
other side has not are left out, and those of a frequent one are dealt out in
parts, on each side by its own count.  The counts are a scalar subquery:
nothing runs while a plan is built, and nothing comes to the driver but
2 * BUCKETS numbers.
"""

from __future__ import annotations

from functools import partial

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.functions.text import fuzzy_score, trigram_jaccard
from formweave.operators import set_signatures
from formweave.operators.containment import bits_of, has_bit
from formweave.operators.spread import growing, spread

# executors need not have the package
cloudpickle.register_pickle_by_value(set_signatures)

FUZZY_THRESHOLD = 0.85
DEDUP_THRESHOLD = 0.92
#: Hash buckets in which signatures are counted.
BUCKETS = 1 << 16
#: Numbers of 64 bits that tell which texts are asked for, by their number; a power of two.
NUMBER_WORDS = 1 << 18
#: Rows with one signature that meet in one task, of each side.
PART_ROWS = 4096


def _bucket(e: Column) -> Column:
    return e.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _counts(left: DataFrame, right: DataFrame) -> Column:
    """(left, right, usual_left, usual_right): the rows of each side by the bucket of their signature, and how many may meet in one task."""
    sums = lambda rows: rows.groupBy("id").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    long = lambda v, name: F.lit(v).cast("long").alias(name)
    seen = lambda rows, l, r: rows.select(_bucket(F.col("e")).cast("long").alias("id"), long(l, "l"), long(r, "r"))
    none = left.sparkSession.range(BUCKETS).select("id", long(0, "l"), long(0, "r"))
    counts = sums(sums(seen(left, 1, 0)).union(sums(seen(right, 0, 1))).union(none))
    # buckets fill with the tables, so a frequent signature is one that stands out
    usual = lambda c: F.greatest(F.lit(PART_ROWS), F.sum(c) * 8 / BUCKETS)
    each = counts.agg(F.sort_array(F.collect_list(F.struct("id", "l", "r"))).alias("all"), usual("l").alias("ul"), usual("r").alias("ur"))
    return each.select(F.struct(
        F.col("all.l").alias("left"), F.col("all.r").alias("right"), F.col("ul").alias("usual_left"), F.col("ur").alias("usual_right")
    )).scalar()


def _candidates(left: DataFrame, right: DataFrame, measures: int, t: float) -> DataFrame:
    """(a, b): ids of texts whose sets may be similar, each pair once."""
    rows = lambda side, near: side.select("id", "g", "text").mapInArrow(
        partial(set_signatures.signature_rows, measures=measures, t=t, near=near), set_signatures.SIGNATURES
    )
    l, r = rows(left, 0), rows(right, 1)
    counts = _counts(l, r)
    at = lambda side: F.get(counts[side], _bucket(F.col("e")))
    met = lambda side, other: side.filter(at(other) > 0)
    parts = lambda side: F.greatest(F.ceil(at(side) / counts[f"usual_{side}"]).cast("int"), F.lit(1))
    every = lambda side: F.explode(F.sequence(F.lit(0), parts(side) - 1))
    own = lambda side: F.pmod(F.hash("id"), parts(side))
    l = met(l, "right").select(
        "m", "e", own("left").alias("i"), every("right").alias("j"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("x").alias("xa"), F.col("y").alias("ya")
    )
    r = met(r, "left").select(
        "m", "e", every("left").alias("i"), own("right").alias("j"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("x").alias("xb"), F.col("y").alias("yb")
    )
    na, nb = F.col("na"), F.col("nb")
    differ = F.bit_count(F.col("xa").bitwiseXOR(F.col("xb"))) + F.bit_count(F.col("ya").bitwiseXOR(F.col("yb")))
    may = F.floor((na + nb) * ((1 - t) / (1 + t)) + 1e-6)
    near = l.join(growing(r), ["m", "e", "i", "j"]).filter((na >= nb * t - 1e-9) & (nb >= na * t - 1e-9) & (differ <= may))
    return near.select("a", "b").distinct()


def similar_pairs(left: DataFrame, right: DataFrame, t: float, tokens: bool = True) -> DataFrame:
    """(grp, text, other, score) with score >= t for distinct (grp, text) rows of both sides.

    The score is the trigram Jaccard, or its maximum with the word Jaccard
    when `tokens`.
    """
    # rows without a group or text are similar to none
    named = lambda side: side.select("grp", "text").filter("grp IS NOT NULL AND text IS NOT NULL").select(
        "grp", "text", F.xxhash64("grp", "text").alias("id"), F.xxhash64(F.lit(0), "grp").alias("g")
    )
    # what is dealt out here is read by counting, by the rows and for the scores
    left, right = (spread(named(side), "grp", "text") for side in (left, right))
    score = fuzzy_score if tokens else trigram_jaccard
    pairs = _candidates(left, right, 2 if tokens else 1, t)
    a = left.select(F.col("id").alias("a"), "grp", "text")
    b = right.select(F.col("id").alias("b"), F.col("grp").alias("_grp"), F.col("text").alias("other"))
    texts = pairs.join(growing(a), "a").join(growing(b), "b").filter("grp = _grp")
    scored = texts.select("grp", "text", "other", score(F.col("text"), F.col("other")).alias("score"))
    return scored.filter(F.col("score") >= t)


def similar_numbers(texts: DataFrame, t: float) -> DataFrame:
    """(a, b), a < b: numbers (`text_number`) of distinct (grp, text) rows whose trigram sets may be similar, each pair once.

    Parts of sets are sent in packs and met in the tasks.  Only texts that share a part get a size and
    parities, and those under a frequent part meet block by block.
    """
    rows = texts.select(text_number(F.col("grp"), F.col("text")).alias("a"), F.xxhash64(F.lit(0), "grp").alias("g"), "text")
    made = rows.mapInArrow(partial(set_signatures.pack_rows, t=t), "p int, b binary")
    shared = spread(made, "p").mapInArrow(set_signatures.shared_rows, "k bigint, a bigint, r bigint")
    some = rows.filter(has_bit(bits_of(shared.select(F.col("a").alias("e")), NUMBER_WORDS), F.col("a"), NUMBER_WORDS))
    sketches = some.mapInArrow(set_signatures.sketch_rows, "a bigint, n int, x bigint, y bigint")
    parts = F.ceil(F.col("r") / PART_ROWS).cast("int")
    blocks = (
        shared.select("k", "a", parts.alias("parts"), F.pmod(F.hash("a"), parts).alias("u"))
        .select("k", "a", "u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("v"))
        .join(growing(sketches), "a")
        .select("k", F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j"), "u", "a", "n", "x", "y")
    )
    met = spread(blocks, "k", "i", "j").mapInArrow(partial(set_signatures.pair_rows, t=t), "a bigint, b bigint")
    return met.distinct()


def text_number(grp: Column, text: Column) -> Column:
    """A text's number in its group; two texts may share one."""
    return F.xxhash64(grp, text).bitwiseAND(F.lit((1 << set_signatures.ID_BITS) - 1))


def answer_keys(answers: DataFrame) -> DataFrame:
    """(cand, key, id): every key or alias with the first answer that carries it."""
    keys = F.array_distinct(F.concat(F.array("normalized_key"), F.coalesce("alias_keys", F.array().cast("array<string>"))))
    return answers.select("cand", "id", F.explode(keys).alias("key")).groupBy("cand", "key").agg(F.min("id").alias("id"))


def _match(questions: DataFrame, answers: DataFrame, t: float, tokens: bool) -> DataFrame:
    # its shuffle is read by all that follows
    distinct = questions.filter("key <> ''").select("cand", "key").distinct()
    looked_up = distinct.join(growing(answer_keys(answers)), ["cand", "key"], "left")
    exact = looked_up.filter("id IS NOT NULL").select(
        "cand", "key", "id", F.lit("answer-exact").alias("source"), F.lit(1.0).alias("score")
    )
    left = looked_up.filter("id IS NULL").select(F.col("cand").alias("grp"), F.col("key").alias("text"))
    owners = answers.groupBy("cand", "normalized_key").agg(F.min("id").alias("id"))
    right = owners.select(F.col("cand").alias("grp"), F.col("normalized_key").alias("text"))
    # candidates of one question stay where they were found until reduced to
    # the best one; the first answer wins a tie
    best = (
        similar_pairs(left, right, t, tokens)
        .join(growing(owners), (F.col("grp") == F.col("cand")) & (F.col("other") == F.col("normalized_key")))
        .groupBy("grp", "text")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("id").alias("id"))).alias("best"))
    )
    fuzzy = best.select(
        F.col("grp").alias("cand"), F.col("text").alias("key"), F.col("best.id").alias("id"),
        F.lit("answer-fuzzy").alias("source"), (-F.col("best.s")).alias("score"),
    )
    return exact.unionByName(fuzzy)


def retrieve_answers(questions: DataFrame, answers: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """(cand, key, id, source, score): the saved answer for each normalised question.

    An exact key or alias wins; otherwise the best word or trigram Jaccard
    from the threshold up.  Questions are made distinct first, so repeated
    labels cost one lookup.
    """
    return _match(questions, answers, threshold, tokens=True)


def find_duplicates(questions: DataFrame, answers: DataFrame, threshold: float = DEDUP_THRESHOLD) -> DataFrame:
    """The saved answer a new question should merge into, by trigrams only."""
    return _match(questions, answers, threshold, tokens=False)
