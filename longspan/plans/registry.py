"""All registered queries."""

from __future__ import annotations

from longspan.plans import extraction, matrices, timelines

_PARTS = (extraction.R, timelines.R, matrices.R)


def queries():
    return {name: query for part in _PARTS for name, query in part.queries.items()}


def oracles():
    return {name: sql for part in _PARTS for name, sql in part.oracles.items()}
