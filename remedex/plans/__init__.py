"""Named queries over the test tables, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

import importlib
import pkgutil

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under ``name``, with its SQL if there is one."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def load_all() -> None:
    """Import every module of this folder, so that all queries are registered."""
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{m}")
