"""Registered queries (``queries()``) and their DuckDB oracles (``oracle_sql()``)."""

from . import (anomaly, decisions, detections, forecast, invariants, models, readings, security, sensors,  # noqa: F401
               timeseries)
from ._registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
