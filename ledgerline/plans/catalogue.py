"""The named queries and, where SQL can state the result, their SQL."""

from __future__ import annotations

from . import aggregates, archives, asof, boards, compositions, deals, entities, evidence, facts, flows, ingest, knowledge, marketplace, metrics, peers, registers, registry, releases, reltables, rendered, rules, scenarios, schedules, statement_rows, statements, timelines, valuations
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "archives", "asof", "boards", "compositions", "deals", "entities", "evidence", "facts", "flows", "ingest", "knowledge", "marketplace", "metrics", "peers", "registers", "registry", "releases", "reltables", "rendered", "rules", "scenarios", "schedules", "statement_rows", "statements", "timelines", "valuations"]
