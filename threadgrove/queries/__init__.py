"""Checked queries, one module per part of the library."""

from importlib import import_module

from threadgrove.queries import base

MODULES = ["threads", "texts", "scores", "evaluation", "files"]


def _load():
    for m in MODULES:
        import_module(f"threadgrove.queries.{m}")


def all_queries():
    _load()
    return dict(base.QUERIES)


def all_sql():
    _load()
    return dict(base.SQL)
