"""Label normalisation, saved-answer retrieval and merging over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formweave import schemas
from formweave.functions import text as X
from formweave.operators import answers as A
from formweave.operators import options as O
from formweave.operators import retrieval as R
from formweave.operators.option_lists import resolve_in_lists
from formweave.operators.rule_tables import with_lexicon
from formweave.operators.spread import spread
from formweave.plans.common import table


def _all_texts(spark: SparkSession, d: str) -> DataFrame:
    named = lambda c: F.col(c).cast("string").alias("id")
    docs = table(spark, d, "documents").select(F.lit("d").alias("src"), named("doc_id"), "text")
    items = table(spark, d, "benchmark").select(F.lit("b").alias("src"), named("item_id"), "text")
    turns = table(spark, d, "conversations").select(
        F.lit("c").alias("src"), F.concat_ws("-", "conv_id", "turn").alias("id"), "text"
    )
    return docs.unionByName(items).unionByName(turns)


def label_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _all_texts(spark, d).select("src", "id", X.normalize_label(F.col("text")).alias("norm"))


def label_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the word and trigram sets of whole texts."""
    norm = spread(label_normalize(spark, d), "src", "id", "norm")
    return norm.select(
        "src", "id", F.size(X.tokens_of(F.col("norm"))).cast("long").alias("words"),
        F.size(X.trigrams_of(F.col("norm"))).cast("long").alias("trigrams"),
    )


def turn_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Word, trigram and combined similarity of each turn to the one before it."""
    before = F.lag("norm").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", X.normalize_label(F.col("text")).alias("norm"))
    pairs = turns.withColumn("prev", before).filter("prev IS NOT NULL")
    a, b = F.col("norm"), F.col("prev")
    return pairs.select(
        "conv_id", "turn", F.round(X.token_jaccard(a, b), 6).alias("words"),
        F.round(X.trigram_jaccard(a, b), 6).alias("trigrams"), F.round(X.fuzzy_score(a, b), 6).alias("score"),
    )


def _lines(df: DataFrame, *keep: str) -> DataFrame:
    lines = df.select(*keep, F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return lines.withColumn("key", X.normalize_label(F.col("raw"))).filter("key <> ''")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return _lines(docs, "doc_id").select(F.lit("c").alias("cand"), "key")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark lines as one candidate's saved answers, named by their key."""
    none = F.array().cast("array<string>")
    lines = _lines(table(spark, d, "benchmark"), "item_id")
    return lines.select(
        F.lit("c").alias("cand"), F.col("key").alias("id"), F.col("key").alias("normalized_key"), none.alias("alias_keys")
    ).distinct()


def answer_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document as a question, benchmark lines as saved answers."""
    hits = R.retrieve_answers(_questions(spark, d), _stored(spark, d))
    return hits.select("key", "id", "source", F.round("score", 6).alias("score"))


def answer_duplicates(spark: SparkSession, d: str) -> DataFrame:
    hits = R.find_duplicates(_questions(spark, d), _stored(spark, d))
    return hits.select("key", "id", "source", F.round("score", 6).alias("score"))


def _passage_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules from benchmark lines: the first by the whole line, one per pair of words; odd ones under lines that hold the next word."""
    lines = _lines(table(spark, d, "benchmark"), "item_id").select("item_id", "line", F.split("key", " ").alias("w"), "key")
    places = F.explode(F.sequence(F.lit(1), F.size("w"))).alias("n")
    at = lambda i: F.get("w", F.col("n") + i)
    some = lambda when, value: F.when(when, F.array(value)).otherwise(F.array().cast("array<string>"))
    return lines.select("item_id", "line", "w", F.col("key").alias("whole"), places).select(
        (F.col("item_id") * 1_000_000 + F.col("line") * 1000 + F.col("n")).alias("ord"),
        F.concat_ws("-", "item_id", "line", "n").alias("key"),
        some(F.col("n") == 1, F.col("whole")).alias("exact"),
        some((F.col("n") > 1) & at(-1).isNotNull(), F.concat(at(-2), F.lit(" "), at(-1))).alias("contains"),
        some((F.col("n") % 2 == 1) & at(0).isNotNull(), at(0)).alias("section_any"),
    )


def label_rules(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as labels under the line before, keyed by a table of rules."""
    before = F.coalesce(F.lag("key").over(Window.partitionBy("doc_id").orderBy("line")), F.lit(""))
    # the window needs a document's lines together, so its texts are sent once
    lines = _lines(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id")
    labels = lines.select("doc_id", F.col("line").cast("long").alias("line"), F.col("key").alias("norm"), before.alias("section_norm"))
    return with_lexicon(labels, _passage_rules(spark, d)).select("doc_id", "line", F.col("lexicon_key").alias("key"))


def question_answer_pairs(spark: SparkSession, d: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations")
    nxt = turns.withColumn("answer", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    return nxt.filter("role = 'user' AND next_role = 'assistant'").select(
        "conv_id", "turn", X.normalize_label(F.col("text")).alias("question"), "answer"
    )


def answers_saved(spark: SparkSession, d: str) -> DataFrame:
    """All document lines saved as questions, per source, in document order."""
    lines = _lines(table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id", "source")
    saves = lines.select(
        F.col("source").alias("cand"), F.concat_ws("-", "doc_id", F.lpad(F.col("line").cast("string"), 10, "0")).alias("seq"),
        F.col("doc_id").alias("ts_us"), F.col("raw").alias("question"), F.concat(F.lit("answer "), "doc_id").alias("answer"),
    )
    none = spark.createDataFrame([], schemas.ANSWERS)
    kept = A.save_answers(saves, none)
    return kept.select(
        "cand", "id", "normalized_key", F.size("alias_keys").cast("long").alias("aliases"), "answer", "created_us", "last_used_us"
    )


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
# spelling of the nation by number, as wanted values and as a drop-down shows them
WANTED = ["USA", "Deutschland", "UK", "South Africa", "Narnia"]
SHOWN = [("ZA", "South Africa (ZA)"), ("DE", "Germany"), ("x", "United States of America"), ("GB", "United Kingdom (UK)")]


def option_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Per customer a segment and a country resolved against drop-downs."""
    customers = spread(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey", "c_nationkey", "c_mktsegment")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("c_nationkey") % 5)
    seg = F.col("c_mktsegment")
    wanted = (
        F.when(F.col("c_nationkey") % 4 == 0, F.lower(seg))
        .when(F.col("c_nationkey") % 4 == 1, F.substring(seg, 1, 4))
        .when(F.col("c_nationkey") % 4 == 2, F.concat(F.lit("Segment "), seg))
        .otherwise("E")
    )
    option = lambda v, t: F.struct(F.lit(v).alias("value"), F.lit(t).alias("text"))
    segments = F.array(*[option(str(i), f"{s.title()} (seg.)") for i, s in enumerate(SEGMENTS)])
    countries = F.array(*[option(v, t) for v, t in SHOWN])
    rows = customers.withColumn("s", O.resolve_option(wanted, segments)).withColumn("c", O.resolve_option(pick(WANTED), countries))
    return rows.select(
        "c_custkey", F.col("s.option.value").alias("segment"), F.col("s.quality").alias("segment_quality"),
        F.col("c.option.value").alias("country"), F.col("c.quality").alias("country_quality"),
    )


def option_lists(spark: SparkSession, d: str) -> DataFrame:
    """Per order a spelling of its customer, resolved against the list of all customers of the market segment."""
    customers = table(spark, d, "customer")
    options = customers.select(
        F.col("c_mktsegment").alias("list_id"), F.col("c_custkey").alias("pos"), F.col("c_custkey").cast("string").alias("value"),
        F.concat("c_name", F.lit(" ("), "c_nationkey", F.lit(")")).alias("text"),
    )
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    digits = F.substring("c_name", 10, 9)
    spelt = F.get(
        F.array(
            F.col("c_name"), F.col("c_custkey").cast("string"), digits, F.concat(digits, F.lit(", customer")), F.lit("Customer"),
            F.concat("c_name", F.lit(" / "), "c_nationkey", F.lit(" please")), F.concat(F.lit("Client "), "c_custkey"),
        ),
        (F.col("o_orderkey") % 7).cast("int"),
    )
    wanted = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_mktsegment").alias("list_id"), spelt.alias("desired")
    )
    found = resolve_in_lists(wanted, options)
    return wanted.join(found, ["list_id", "desired"], "left").select("o_orderkey", "desired", F.col("option.value").alias("value"), "quality")


def meaning_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Do a customer's country and market mean the same as their neighbours' spellings?"""
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("c_nationkey") % len(values))
    left, right = pick(LEFT_SPELLINGS), pick(RIGHT_SPELLINGS)
    return table(spark, d, "customer").select(
        "c_custkey", X.same_meaning(left, right).alias("same"), X.country_key(left).alias("country"),
        X.state_key(right).alias("state"), X.dial_for_country(left).alias("dial"),
        X.dial_from_phone(F.concat(F.lit("+"), F.col("c_nationkey") + 20, F.lit(" (0) "), F.col("c_custkey"))).alias("phone_dial"),
    )


LEFT_SPELLINGS = ["U.S.", "No", "MA", "Türkiye", "Yes", "España (ES)", "B.Sc"]
RIGHT_SPELLINGS = ["United States of America", "Norway", "Massachusetts", "turkiye", "No", "Spain", "Bachelor's degree"]

QUERIES = {
    f.__name__: f
    for f in (
        label_normalize, label_sets, turn_similarity, answer_retrieval, answer_duplicates, question_answer_pairs,
        label_rules, answers_saved, option_resolution, option_lists, meaning_pairs,
    )
}

_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '\(required\)|\(optional\)', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_BARE = r"regexp_replace({0}, '\([^)]*\)', ' ', 'g')"
_TRI = (
    "list_distinct(list_concat(list_concat(regexp_extract_all(' ' || {0} || ' ', '(?s).{{3}}'), "
    "regexp_extract_all({0} || ' ', '(?s).{{3}}')), regexp_extract_all(substr({0} || ' ', 2), '(?s).{{3}}')))"
)
_TOK = "list_distinct(list_filter(string_split({0}, ' '), lambda x: x <> ''))"
_TEXTS = f"""
t AS (SELECT 'd' AS src, doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT 'b', item_id::VARCHAR, text FROM benchmark
      UNION ALL SELECT 'c', conv_id || '-' || turn, text FROM conversations),
n AS (SELECT src, id, {_NORM.format('text')} AS norm FROM t)"""


def _jaccard(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"


def _retrieval_sql(threshold: float, with_words: bool) -> str:
    words = f"greatest({_jaccard('q.t', 'a.t')}, {_jaccard('q.w', 'a.w')})" if with_words else _jaccard("q.t", "a.t")
    near = lambda s: f"(len(q.{s}) >= {threshold} * len(a.{s}) - 1e-9 AND len(a.{s}) >= {threshold} * len(q.{s}) - 1e-9)"
    close = f"({near('t')} OR {near('w')})" if with_words else near("t")
    return f"""WITH
ql AS (SELECT DISTINCT {_NORM.format('l')} AS k FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)),
al AS (SELECT DISTINCT {_NORM.format('l')} AS k FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM benchmark)),
a AS MATERIALIZED (SELECT k, {_TRI.format('k')} AS t, {_TOK.format('k')} AS w FROM al WHERE k <> ''),
q AS MATERIALIZED (SELECT k, {_TRI.format('k')} AS t, {_TOK.format('k')} AS w FROM ql
                   WHERE k <> '' AND k NOT IN (SELECT k FROM al)),
s AS (SELECT q.k AS key, a.k AS id, {words} AS score FROM q JOIN a ON {close})
SELECT k AS key, k AS id, 'answer-exact' AS source, CAST(1 AS DOUBLE) AS score FROM ql WHERE k <> '' AND k IN (SELECT k FROM al)
UNION ALL
SELECT key, id, 'answer-fuzzy', round(score, 6) FROM s WHERE score >= {threshold}
QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, id) = 1"""


def _saved_sql() -> str:
    """Keys in order of first save; the recursion walks only keys with an earlier similar one and keeps those that follow."""
    t = R.DEDUP_THRESHOLD
    return f"""WITH RECURSIVE
l AS (SELECT source AS cand, doc_id, unnest(string_split(text, chr(10))) AS raw,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
k AS (SELECT cand, doc_id AS ts, doc_id || '-' || lpad(CAST(line AS VARCHAR), 10, '0') AS seq, {_NORM.format('raw')} AS key FROM l),
f AS MATERIALIZED (SELECT cand, key, min((ts, seq)) AS first, max((ts, seq)) AS last, {_TRI.format('key')} AS t
      FROM k WHERE key <> '' GROUP BY cand, key),
p AS MATERIALIZED (SELECT a.cand, a.key, b.key AS other, b.first AS other_first, {_jaccard('a.t', 'b.t')} AS score
      FROM f a JOIN f b ON a.cand = b.cand AND b.first < a.first
        AND len(a.t) >= {t} * len(b.t) - 1e-9 AND len(b.t) >= {t} * len(a.t) - 1e-9
      WHERE score >= {t}),
d AS MATERIALIZED (SELECT p.cand, p.key, list(other) AS others, row_number() OVER (PARTITION BY p.cand ORDER BY any_value(f.first)) AS n
      FROM p JOIN f ON f.cand = p.cand AND f.key = p.key GROUP BY p.cand, p.key),
w(cand, n, following) AS (
  SELECT DISTINCT cand, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM d
  UNION ALL
  SELECT w.cand, d.n, CASE WHEN len(list_filter(d.others, lambda x: NOT list_contains(w.following, x))) > 0
                      THEN list_append(w.following, d.key) ELSE w.following END
  FROM w JOIN d ON d.cand = w.cand AND d.n = w.n + 1),
s AS (SELECT cand, unnest(arg_max(following, n)) AS key FROM w GROUP BY cand),
c AS (SELECT p.cand, p.key, arg_min(p.other, (-score, other_first, other)) AS leader FROM p
      WHERE (p.cand, p.key) IN (SELECT cand, key FROM s) AND (p.cand, p.other) NOT IN (SELECT cand, key FROM s) GROUP BY p.cand, p.key),
h AS (SELECT f.cand, f.key, f.last, coalesce(c.leader, f.key) AS leader FROM f LEFT JOIN c ON c.cand = f.cand AND c.key = f.key)
SELECT h.cand, h.cand || '-' || any_value(o.first[2]) AS id, h.leader AS normalized_key, count(*) - 1 AS aliases,
  'answer ' || max(h.last)[1] AS answer, any_value(o.first[1]) AS created_us, max(h.last)[1] AS last_used_us
FROM h JOIN f o ON o.cand = h.cand AND o.key = h.leader GROUP BY h.cand, h.leader"""


ORACLES = {
    "label_normalize": f"WITH {_TEXTS} SELECT src, id, norm FROM n",
    "label_sets": f"""WITH {_TEXTS}
SELECT src, id, len({_TOK.format('norm')}) AS words, len({_TRI.format('norm')}) AS trigrams FROM n""",
    "turn_similarity": f"""WITH n AS (SELECT conv_id, turn, {_NORM.format('text')} AS norm FROM conversations),
p AS (SELECT *, lag(norm) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM n),
s AS (SELECT conv_id, turn, {_TOK.format('norm')} AS wa, {_TOK.format('prev')} AS wb,
             {_TRI.format('norm')} AS ta, {_TRI.format('prev')} AS tb FROM p WHERE prev IS NOT NULL)
SELECT conv_id, turn, round({_jaccard('wa', 'wb')}, 6) AS words, round({_jaccard('ta', 'tb')}, 6) AS trigrams,
       round(greatest({_jaccard('wa', 'wb')}, {_jaccard('ta', 'tb')}), 6) AS score FROM s""",
    "answer_retrieval": _retrieval_sql(R.FUZZY_THRESHOLD, True),
    "answer_duplicates": _retrieval_sql(R.DEDUP_THRESHOLD, False),
    "label_rules": f"""WITH
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
n AS (SELECT doc_id, line, {_NORM.format('raw')} AS norm FROM l),
f AS MATERIALIZED (SELECT doc_id, line, norm, coalesce(lag(norm) OVER (PARTITION BY doc_id ORDER BY line), '') AS heading FROM n WHERE norm <> ''),
b AS (SELECT item_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM benchmark),
w AS (SELECT item_id, line, {_NORM.format('raw')} AS whole, string_split({_NORM.format('raw')}, ' ') AS w FROM b),
p AS (SELECT *, unnest(range(1, len(w) + 1)) AS n FROM w WHERE whole <> ''),
r AS MATERIALIZED (SELECT (item_id, line, n) AS ord, item_id || '-' || line || '-' || n AS key, CASE WHEN n = 1 THEN whole END AS exact,
        CASE WHEN n > 1 THEN w[n - 1] || ' ' || w[n] END AS phrase, CASE WHEN n % 2 = 1 THEN w[n + 1] END AS word FROM p),
k AS (SELECT doc_id, line, arg_min(key, ord) AS key FROM f JOIN r
      ON (norm = exact OR contains(norm, phrase)) AND (word IS NULL OR contains(heading, word)) GROUP BY doc_id, line)
SELECT f.doc_id, f.line, key FROM f LEFT JOIN k USING (doc_id, line)""",
    "answers_saved": _saved_sql(),
    "question_answer_pairs": f"""
WITH n AS (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations
           WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, {_NORM.format('text')} AS question, answer FROM n WHERE role = 'user' AND next_role = 'assistant'""",
    "option_resolution": """
SELECT c_custkey,
  CASE WHEN c_nationkey % 4 = 3 THEN NULL ELSE CAST(list_position(
    ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) - 1 AS VARCHAR) END AS segment,
  CASE c_nationkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'substring' WHEN 2 THEN NULL END AS segment_quality,
  ['x', 'DE', 'GB', 'ZA', NULL][c_nationkey % 5 + 1] AS country,
  CASE WHEN c_nationkey % 5 < 4 THEN 'exact' END AS country_quality
FROM customer""".replace(
        "CASE WHEN c_nationkey % 4 = 3 THEN NULL", "CASE WHEN c_nationkey % 4 >= 2 THEN NULL"
    ),
    "option_lists": f"""WITH
o AS (SELECT c_mktsegment AS list_id, c_custkey AS pos, CAST(c_custkey AS VARCHAR) AS value, c_name || ' (' || c_nationkey || ')' AS text FROM customer),
p AS MATERIALIZED (SELECT list_id, pos, value, {_NORM.format('text')} AS norm, {_TOK.format(_NORM.format("(text || ' ' || value)"))} AS words,
       [{_NORM.format('text')}, {_NORM.format(_BARE.format('text'))}, {_NORM.format('value')}] AS keys FROM o),
n AS (SELECT o_orderkey, c_mktsegment AS list_id, [c_name, CAST(c_custkey AS VARCHAR), substr(c_name, 10, 9), substr(c_name, 10, 9) || ', customer',
        'Customer', c_name || ' / ' || c_nationkey || ' please', 'Client ' || c_custkey][o_orderkey % 7 + 1] AS desired
      FROM orders JOIN customer ON o_custkey = c_custkey),
w AS MATERIALIZED (SELECT DISTINCT list_id, desired, {_NORM.format('desired')} AS norm, {_TOK.format(_NORM.format('desired'))} AS words,
       [{_NORM.format('desired')}, {_NORM.format(_BARE.format('desired'))}] AS keys FROM n),
m AS (SELECT w.list_id, w.desired, list_has_any(p.keys, w.keys) AS meant, contains(p.norm, w.norm) OR contains(w.norm, p.norm) AS part,
        list_has_all(p.words, w.words) AS worded, p.pos, p.value FROM w JOIN p ON p.list_id = w.list_id),
r AS (SELECT list_id, desired, arg_min(value, pos) FILTER (meant) AS exact,
        CASE WHEN count(*) FILTER (part) = 1 THEN max(value) FILTER (part) WHEN count(*) FILTER (worded) = 1 THEN max(value) FILTER (worded) END AS near
      FROM m GROUP BY list_id, desired)
SELECT o_orderkey, n.desired, coalesce(exact, near) AS value,
  CASE WHEN exact IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'substring' END AS quality
FROM n LEFT JOIN r ON r.list_id = n.list_id AND r.desired = n.desired""",
    "meaning_pairs": """
SELECT c_custkey, [true, true, true, true, false, true, false][c_nationkey % 7 + 1] AS same,
  ['US', 'NO', 'MA', 'TR', NULL, NULL, NULL][c_nationkey % 7 + 1] AS country,
  [NULL, NULL, 'US:MA', NULL, NULL, NULL, NULL][c_nationkey % 7 + 1] AS state,
  ['1', '47', '212', '90', NULL, NULL, NULL][c_nationkey % 7 + 1] AS dial,
  CASE WHEN c_nationkey + 20 IN (20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44) THEN CAST(c_nationkey + 20 AS VARCHAR)
       WHEN c_nationkey + 20 IN (21, 22, 23, 25, 26, 35, 37, 38, 42) THEN (
         SELECT d FROM (VALUES ('212'), ('221'), ('225'), ('233'), ('234'), ('237'), ('250'), ('251'), ('254'), ('255'),
           ('256'), ('258'), ('260'), ('263'), ('264'), ('265'), ('267'), ('351'), ('353'), ('354'), ('358'), ('359'),
           ('370'), ('371'), ('372'), ('374'), ('380'), ('381'), ('385'), ('386'), ('420'), ('421')) v(d)
         WHERE d = left(CAST(c_nationkey + 20 AS VARCHAR) || '0', 3)) END AS phone_dial
FROM customer""",
}
