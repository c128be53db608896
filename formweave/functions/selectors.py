"""Simple CSS selectors as column expressions: a tag, ids, classes and attribute tests in any order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# of escapes by code point only those of digits, which begin an escaped id, are read; others are left to comparing spellings
_ESCAPE = r"(?:\\3[0-9] |\\[^0-9a-fA-F\s])"
_IDENT = rf"(?:[\w\u0080-\uffff-]|{_ESCAPE})+"
_QUOTED = rf"""(?:"(?:[^"\\]|{_ESCAPE})*"|'(?:[^'\\]|{_ESCAPE})*')"""
_ATTR = rf"\[\s*{_IDENT}\s*(?:[~|^$*]?=\s*(?:{_QUOTED}|{_IDENT})\s*)?\]"
_PART = rf"(?:#{_IDENT}|\.{_IDENT}|{_ATTR})"
_SIMPLE = rf"^\s*(?=\S)(?:\*|{_IDENT})?{_PART}*\s*$"
_TAG = rf"^\s*(\*|{_IDENT})?"


def is_simple(selector: Column) -> Column:
    """Can the selector be read here?  Combinators, lists, pseudo-classes, flags and code-point escapes can't."""
    return F.coalesce(selector.rlike(_SIMPLE), F.lit(False))


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(?:3([0-9]) |(.))", "$1$2")


def selector_tests(selector: Column) -> Column:
    """array of struct(attr, op, value) for a simple selector; the tag is attr '' and op '='; '' as op asks for presence."""
    test = lambda attr, op, value: F.struct(attr.alias("attr"), op.alias("op"), value.alias("value"))
    tag = F.lower(_plain(F.regexp_extract(selector, _TAG, 1)))
    rest = F.regexp_replace(selector, _TAG, "")

    def attribute(p: Column) -> Column:
        group = lambda n: F.regexp_extract(p, rf"^\[\s*({_IDENT})\s*(?:([~|^$*]?=)\s*({_QUOTED}|{_IDENT})\s*)?\]$", n)
        value = F.regexp_replace(group(3), r"""^(["'])(.*)\1$""", "$2")
        return test(F.lower(_plain(group(1))), group(2), _plain(value))

    def part(p: Column) -> Column:
        named = _plain(F.substr(p, F.lit(2)))
        return F.when(p.startswith("#"), test(F.lit("id"), F.lit("="), named)).when(
            p.startswith("."), test(F.lit("class"), F.lit("~="), named)
        ).otherwise(attribute(p))

    parts = F.transform(F.regexp_extract_all(rest, F.lit(_PART), F.lit(0)), part)
    own = F.filter(F.array(test(F.lit(""), F.lit("="), tag)), lambda t: ~t["value"].isin("", "*"))
    return F.concat(own, parts)


def passes(test: Column, attrs: Column) -> Column:
    """Does an element, as entries (key, value) with its tag under key '', pass one test?"""
    value = F.get(F.filter(attrs, lambda a: a["key"] == test["attr"]), F.lit(0))["value"]
    op, wanted = test["op"], test["value"]
    some = wanted != ""
    words = F.split(value, r"[ \t\n\f\r]+")
    found = (
        F.when(op == "", value.isNotNull())
        .when(op == "=", value == wanted)
        .when(op == "~=", some & F.array_contains(words, wanted))
        .when(op == "|=", (value == wanted) | F.startswith(value, F.concat(wanted, F.lit("-"))))
        .when(op == "^=", some & F.startswith(value, wanted))
        .when(op == "$=", some & F.endswith(value, wanted))
        .when(op == "*=", some & F.contains(value, wanted))
    )
    return F.coalesce(found, F.lit(False))


def element_keys(attrs: Column) -> Column:
    """Keys under which an element is looked up: each attribute by value and by its presence."""
    return F.flatten(F.transform(attrs, lambda a: F.array(F.concat(a["key"], F.lit("="), a["value"]), a["key"])))


def lookup_key(tests: Column) -> Column:
    """One key that every element has which passes all tests: an id, a name, another value, else an attribute's presence."""
    rank = lambda t: F.when(t["op"] != "=", 4).when(t["attr"] == "id", 0).when(t["attr"] == "name", 1).when(t["attr"] != "", 2).otherwise(3)
    key = lambda t: F.when(t["op"] == "=", F.concat(t["attr"], F.lit("="), t["value"])).otherwise(t["attr"])
    return F.array_min(F.transform(tests, lambda t: F.struct(rank(t).alias("rank"), key(t).alias("key"))))["key"]
