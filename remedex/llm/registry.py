"""Queries of the training-data operators: opN_<name> over whole tables, and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from remedex import llm

QUERIES: dict = {}
ORACLES: dict = {}

for _m in sorted(x.name for x in pkgutil.iter_modules(llm.__path__)):
    if _m.startswith("op") and _m[2:].split("_")[0].isdigit():
        _mod = importlib.import_module(f"remedex.llm.{_m}")
        QUERIES[_mod.NAME] = _mod.query
        if getattr(_mod, "ORACLE", None):
            ORACLES[_mod.NAME] = _mod.ORACLE
