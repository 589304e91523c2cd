"""All registered queries of the engine."""

from . import freshness, graph, joins, retrieval, scan, telemetry  # noqa: F401
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
