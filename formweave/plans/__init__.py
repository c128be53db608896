"""Registered queries over the given tables and their SQL twins."""

from formweave.plans import cvs, forms, history, pages, texts, usage

MODULES = [usage, history, texts, pages, forms, cvs]


def queries():
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracles():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
