"""Registry of named queries: a Spark callable plus its DuckDB oracle text.

A registered query applies one library operator to the derived views of a
driver data directory and returns a DataFrame whose columns are normalised
(``finish``) so that the oracle can compare values across engines.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.fixtures import VIEW_SQL

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def r6(c: Column) -> Column:
    """Round to 6 decimals with the same IEEE steps DuckDB's oracle uses."""
    return F.when(F.abs(c) < 1e12, F.floor(c * 1e6 + 0.5) / 1e6).otherwise(c)


def finish(df: DataFrame) -> DataFrame:
    """Last step of every registered query: integers widened to BIGINT,
    floats to DOUBLE rounded to 6 decimals (applied once, at the end)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = r6(c.cast("double"))
        elif isinstance(f.dataType, T.DecimalType):
            c = r6(c.cast("double"))
        out.append(c.alias(f.name))
    return df.select(*out)


def _expand_r6(sql: str) -> str:
    """Expand the ``R6(expr)`` shorthand into the rounding expression."""
    out, i = [], 0
    for m in re.finditer(r"\bR6\(", sql):
        if m.start() < i:
            continue
        j, depth = m.end(), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        inner = _expand_r6(sql[m.end():j - 1])
        out.append(sql[i:m.start()])
        out.append(f"(case when abs({inner}) < 1e12 then floor(({inner}) * 1000000 + 0.5) / 1000000 "
                   f"else ({inner}) end)")
        i = j
    out.append(sql[i:])
    return "".join(out)


def compose_sql(views: tuple[str, ...], body: str) -> str:
    """Prefix the derived views a query needs as CTEs."""
    body = _expand_r6(body.strip())
    ctes = [f"{v} AS ({VIEW_SQL[v].strip()})" for v in views]
    if re.match(r"(?is)^with\s", body):
        rest = body[4:].lstrip()
        return "WITH " + ",\n".join(ctes + [rest]) if ctes else body
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


def query(name: str, views: tuple[str, ...] = ("readings",), sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        def run(spark, sf_dir):
            # corridor's convention: Unix seconds are read in UTC
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return finish(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = compose_sql(views, sql)
        return fn
    return deco
