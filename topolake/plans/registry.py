"""All queries of the engine's own operators, by name."""

from __future__ import annotations

from . import features, functions, generators, provenance, rederived, relational, rounds, scoring, streams, text, topology

_MODULES = (topology, features, provenance, scoring, relational, text, generators, streams, rederived, rounds, functions)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
