"""Small rule tables as literals inside expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_map(table: dict[str, str]) -> Column:
    """A string map the optimizer folds into a literal."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def lookup(table: dict[str, list[str]], key: Column) -> Column:
    """Values of `key` in a table of spellings, null when absent.

    A Spark map is searched entry by entry, so the table is split by first
    letter and only one short part is searched.
    """
    parts: dict[str, dict[str, list[str]]] = {}
    for spelling, values in table.items():
        parts.setdefault(spelling[:1], {})[spelling] = values
    nested = F.from_json(F.lit(json.dumps(parts)), "map<string,map<string,array<string>>>")
    return F.element_at(F.element_at(nested, F.substring(key, 1, 1)), key)
