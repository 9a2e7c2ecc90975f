"""Registered queries: each applies operators to the driver tables and has a SQL twin."""

REGISTRY: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame and, where there is one, its DuckDB SQL."""

    def add(f):
        REGISTRY[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add
