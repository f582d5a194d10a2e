"""Every query of the engine by name, with its SQL where SQL can express it."""

from __future__ import annotations

from papyra.plans import network_queries, registry_queries, text_queries  # noqa: F401
from papyra.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
