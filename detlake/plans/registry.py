"""The registered queries, each a function of (spark, table folder), and their SQL twins."""

from __future__ import annotations

from detlake.plans import audits, connectors, curation, detection, inventories


def queries():
    return detection.queries() | curation.queries() | inventories.queries() | connectors.queries() | audits.queries()


def oracle_sql():
    return detection.oracle_sql() | curation.oracle_sql() | inventories.oracle_sql() | connectors.oracle_sql() | audits.oracle_sql()
