"""The registry that every query module adds to: name -> callable(spark, sf_dir), and the DuckDB text that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}
c = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(x):
    """Numbers are rounded to six places, as sums may be added up in any order."""
    return F.round(x, 6)
