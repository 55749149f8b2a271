"""Checked queries, one or more per operator/report of SURVEY section 2."""

from __future__ import annotations

from . import registry
from . import q_ash, q_catalog_rules, q_counters, q_details, q_grouping, q_hierarchy, q_io, q_locks_groups, q_lookup_text, q_memory, q_queue, q_rules, q_sessions, q_statements, q_storage, q_streaming  # noqa: F401  (registers)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLE)
