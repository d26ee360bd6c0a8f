"""All registered queries and their SQL oracles."""

from __future__ import annotations

import importlib

_MODULES = [
    "flowforge.plans.q_labelling",
    "flowforge.plans.q_cleaning",
    "flowforge.plans.q_split",
    "flowforge.plans.q_stats",
    "flowforge.plans.q_metrics",
    "flowforge.plans.q_models",
    "flowforge.plans.q_files",
]


def _load():
    queries, oracle = {}, {}
    for name in _MODULES:
        mod = importlib.import_module(name)
        for k, v in mod.QUERIES.items():
            if k in queries:
                raise ValueError(f"duplicate query {k}")
            queries[k] = v
        oracle.update(getattr(mod, "ORACLE", {}))
    return queries, oracle


def all_queries():
    return _load()[0]


def all_oracles():
    return _load()[1]
