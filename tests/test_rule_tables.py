"""Contained phrases against all pairs, and lexicons as tables against the literal one."""

from __future__ import annotations

import random

from people import fields

from formweave.functions import fields as R
from formweave.operators import containment, rule_tables
from formweave.operators.containment import contained_pairs
from formweave.operators.mapping import match_keys
from formweave.operators.rule_tables import RULES, lexicon_keys, lexicon_table
from formweave.plans import texts as texts_plans
from formweave.rules.lexicon import LexiconEntry, lexicon


def _pairs(spark, texts, phrases):
    found = contained_pairs(spark.createDataFrame(texts, "grp string, text string"), spark.createDataFrame(phrases, "grp string, phrase string"))
    return sorted(tuple(r) for r in found.collect())


def _all_pairs(texts, phrases):
    return sorted({(g, t, p) for g, t in texts for h, p in phrases if g and g == h and t and p and p in t})


def test_contained_pairs_are_all_pairs(spark):
    dice = random.Random(5)
    word = lambda: "".join(dice.choice("abé😀 ") for _ in range(dice.randint(0, 12)))
    texts = [(dice.choice(["x", "y", None]), dice.choice([word(), word(), None])) for _ in range(150)] + [("x", "ab ab" * 2000)]
    phrases = [(dice.choice(["x", "y", "z", None]), dice.choice([word()[:6], None])) for _ in range(150)]
    assert _pairs(spark, texts + texts, phrases + phrases) == _all_pairs(texts, phrases)


def test_frequent_windows_are_dealt_out_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(containment, "PART_ROWS", 7)
    texts = [("g", f"name {i} of") for i in range(60)]
    phrases = [("g", p) for p in ("name", "ame ", "me 1", "of", "n", "me", "am", "nam", "name 5")]
    assert _pairs(spark, texts, phrases) == _all_pairs(texts, phrases)


def test_no_texts_or_no_phrases(spark):
    assert _pairs(spark, [], [("g", "a")]) == []
    assert _pairs(spark, [("g", "a")], []) == []


def _labels():
    """Every spelling of the lexicon alone, inside others and under every section word."""
    words = sorted({w for e in lexicon() for w in e.section_any})
    spelt = [s for e in lexicon() for s in [*e.exact, *e.contains]]
    labels = [(s, "") for s in spelt] + [(f"your {s} please", "") for s in spelt] + [("", "education"), (None, "education"), ("zzz", None)]
    labels += [(s, f"my {w}s") for e in lexicon() if e.section_any for s in [*e.exact, *e.contains] for w in words]
    return labels


def test_table_of_the_literal_lexicon_gives_its_keys(spark):
    labels = spark.createDataFrame(_labels(), "norm string, section_norm string")
    literal = labels.withColumn("section_norm", R.F.coalesce("section_norm", R.F.lit(""))).select(
        "norm", "section_norm", R.lexicon_key("norm", "section_norm").alias("key")
    )
    expected = {tuple(r) for r in literal.filter("key IS NOT NULL").collect()}
    found = [tuple(r) for r in lexicon_keys(labels, lexicon_table(spark)).collect()]
    assert len(expected) > 200
    assert len(found) == len(set(found)) and set(found) == expected


def test_first_of_the_rules_that_fit(spark):
    rules = spark.createDataFrame(
        [(4, "late", [], ["pay"], []), (2, "gated", [], ["pay"], ["work", "job"]), (3, "whole", ["pay day"], [], []),
         (2, "hated", [], ["pay"], ["job"]), (0, "never", None, None, None), (1, "empty", [""], [""], [""])], RULES
    )
    labels = [("pay day", "old jobs"), ("pay day", "other"), ("pay days", "other"), ("pay", "workshop"), ("day", "job"), ("", "job")]
    found = lexicon_keys(spark.createDataFrame(labels * 2, "norm string, section_norm string"), rules)
    assert sorted(tuple(r) for r in found.collect()) == [
        ("pay", "workshop", "gated"), ("pay day", "old jobs", "gated"), ("pay day", "other", "whole"), ("pay days", "other", "late"),
    ]


def test_fifty_thousand_rules_map_fields_as_the_literal_lexicon(spark):
    others = [LexiconEntry(f"other.{i}", [f"place {i:05} x"], [f"item {i:05} x", f"thing {i % 300}y"], ["education"] if i % 2 else []) for i in range(50_000)]
    cases = {f"f{i}": {"label": n, "section_heading": s} for i, (n, s) in enumerate(_labels())}
    cases |= {"hidden": {"label": "Email", "visible": False}, "token": {"label": "Email", "autocomplete": "given-name"}}
    signals = fields(spark, cases).cache()
    keys = lambda lexicon: {r.ref: (r.rule_key, r.rule_source) for r in match_keys(signals, lexicon).select("ref", "rule_key", "rule_source").collect()}
    literal = keys(None)
    assert keys(lexicon_table(spark, [*lexicon(), *others])) == literal
    assert len(literal) == len(cases) and literal["hidden"] == (None, None) and literal["token"][1] == "autocomplete"

    few = {"one": {"label": "Your item 40000 x"}, "two": {"label": "Thing 8y"}, "gated": {"label": "Thing 7y"},
           "heading": {"label": "Thing 7y", "section_heading": "Education"}}
    signals = fields(spark, few)
    assert keys(lexicon_table(spark, [*lexicon(), *others])) == {
        "one": ("other.40000", "lexicon"), "two": ("other.8", "lexicon"), "gated": (None, None), "heading": ("other.7", "lexicon"),
    }


def test_windows_of_a_stretch_are_those_of_its_texts(monkeypatch):
    monkeypatch.setattr(containment, "STRETCH", 16)
    texts = ["of the cat", "", "é😀", "of", "a long text beyond the stretch", None, "of the cat"]
    batch = containment.pa.RecordBatch.from_arrays(
        [containment.pa.array([0] * 7), containment.pa.array(texts), containment.pa.array([5, 5, 5, 5, 5, 5, 6])], names=["grp", "text", "g"]
    )
    # the first and last rows are cut off, as a part of a larger batch
    rows = [r for out in containment._window_rows([batch.slice(1, 5)], "text", False) for r in out.to_pylist()]
    assert [r["text"] for r in rows] == texts[1:6]
    for r in rows:
        raw = (r["text"] or "").encode()
        assert len(set(r["e"])) == len(r["e"]) == len({raw[i : i + w] for w in containment.WIDTHS for i in range(len(raw) - w + 1)})
    widest = [r["e"] for out in containment._window_rows([batch], "text", True) for r in out.to_pylist()]
    every = [r["e"] for out in containment._window_rows([batch], "text", False) for r in out.to_pylist()]
    assert [len(e) for e in widest] == [3, 0, 1, 1, 23, 0, 3] and set(widest[3]) <= set(every[0])
    # equal texts of other groups have other windows
    assert not set(every[0]) & set(every[6])
    counted = [r for out in containment._count_rows([batch]) for r in out.to_pylist()]
    assert sum(r["n"] for r in counted) == sum(max(0, len((t or "").encode()) - w + 1) for t in texts for w in containment.WIDTHS)


def test_a_long_phrase_meets_only_texts_with_a_wide_window_of_it(spark):
    texts = [("g", f"{i:05} rent out the hen, other flowers") for i in range(200)] + [("g", "of the other"), ("g", "é of thé other")]
    phrases = [("g", "of the other"), ("g", "é of thé")]
    rows = containment.contained_pairs(spark.createDataFrame(texts, "grp string, text string"), spark.createDataFrame(phrases, "grp string, phrase string"))
    assert sorted(tuple(r) for r in rows.collect()) == _all_pairs(texts, phrases)
    widest = containment._windows(spark.createDataFrame(phrases, "grp string, phrase string"), "phrase", True)
    seen = containment._windows(spark.createDataFrame(texts, "grp string, text string"), "text", False)
    assert seen.join(widest, "e").select("text").distinct().count() < 10


def _random_lexicon(spark, dice):
    word = lambda: "".join(dice.choice("abé😀 ") for _ in range(dice.randint(0, 5)))
    some = lambda most: dice.choice([None, [word() for _ in range(dice.randint(0, most))]])
    return spark.createDataFrame([(dice.randint(0, 30), f"k{i}", some(2), some(2), some(2)) for i in range(80)], RULES)


def test_few_rules_are_looked_up_in_place_and_many_joined_with_the_same_keys(spark, monkeypatch):
    dice = random.Random(11)
    word = lambda: dice.choice(["", None, *("".join(dice.choice("abé😀 ") for _ in range(dice.randint(1, 14))) for _ in range(9))])
    rules = _random_lexicon(spark, dice)
    labels = spark.createDataFrame([(i % 300, word(), word()) for i in range(400)], "i int, norm string, section_norm string")
    rows = labels.unionByName(labels).unionByName(labels.selectExpr("i", "'ab abé' AS norm", "section_norm"))
    keys = lambda: sorted((tuple(r) for r in rule_tables.with_lexicon(rows, rules).collect()), key=str)
    here, first = keys(), sorted(map(tuple, lexicon_keys(rows, rules).collect()), key=str)
    assert "SortMergeJoin" not in _plan(rule_tables.with_lexicon(rows, rules))
    monkeypatch.setattr(rule_tables, "FEW_BYTES", 0)
    assert "SortMergeJoin" in _plan(rule_tables.with_lexicon(rows, rules))
    assert keys() == here and sorted(map(tuple, lexicon_keys(rows, rules).collect()), key=str) == first
    by_hand = {
        (n, s): min(
            ((r.ord, r.key) for r in rules.collect()
             if (n in [x for x in r.exact or [] if x] or any(x and x in n for x in r.contains or []))
             and (not r.section_any or any(x and x in (s or "") for x in r.section_any))), default=(None, None),
        )[1]
        for _, n, s in rows.distinct().collect() if n
    }
    assert len(here) == 1200 and all(k == (by_hand[n, s] if n else None) for _, n, s, k in here)
    assert len(set(by_hand.values())) > 10


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_documents_are_sent_once(spark, tmp_path):
    lines = ["First Name", "Of the cat and of the hen", "", "Other: of the hen", "cat and", "The hen"]
    docs = [(i, "\n".join(lines[i % 3 :] + [f"line {i}"])) for i in range(12)] + [(3, "of the hen"), (None, "cat and\nof the")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "The cat and of the hen\nof the")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = texts_plans.label_rules(spark, str(tmp_path))
    assert sum("Exchange" in line and "doc_id" in line for line in _plan(found).splitlines()) == 1 and "Join" not in _plan(found)
    rows = found.collect()
    assert len(rows) == sum(len([x for x in t.split("\n") if x]) for _, t in docs) and [r.key for r in rows if r.doc_id is None] == [None, "1-1-2"]


def test_texts_send_few_windows_by_number(spark):
    """Texts without a window of a phrase send nothing, however many windows all texts have; none is sent with its text."""
    dice = random.Random(3)
    word = lambda n: "".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    phrases = [word(12) for _ in range(3000)]
    texts = [" ".join(word(7) for _ in range(40)) for _ in range(300)] + [f"{word(90)} {p} {word(90)}" for p in phrases[:100]]
    numbered = containment.numbered(spark.createDataFrame([("g", t) for t in texts], "grp string, text string"))
    met = containment.candidates(numbered, spark.createDataFrame([("g", p) for p in phrases], "grp string, phrase string"))
    assert met.columns == ["a", "grp", "phrase"]
    assert 100 <= met.count() <= 110
