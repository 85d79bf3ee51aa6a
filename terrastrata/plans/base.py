"""How queries and their SQL are declared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import model

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: str = "") -> Callable[[Query], Query]:
    """Register a query under ``name``; ``tables`` names the virtual tables that ``sql`` reads."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ctes = ", ".join(model.SQL[t] for t in tables.split())
            own = sql.strip()
            if ctes:
                own = f"WITH {ctes}, {own[5:]}" if own.upper().startswith("WITH ") else f"WITH {ctes} {own}"
            ORACLES[name] = own
        return f

    return keep
