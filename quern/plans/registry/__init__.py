"""Registered queries of the engine's own operators, each with its DuckDB counterpart where SQL has one."""

from quern.plans.registry import documents, forum, messages, retrieval, runs, scalars, streams, telemetry  # noqa: F401
from quern.plans.registry._views import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
