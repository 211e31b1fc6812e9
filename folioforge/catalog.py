"""Query registry: name -> (callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under name, with the DuckDB SQL that returns the same rows."""

    def add(f: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = (f, oracle)
        return f

    return add


def load_all() -> dict[str, tuple[Query, str | None]]:
    import importlib
    import pkgutil

    from . import plans

    for m in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        importlib.import_module(f"{plans.__name__}.{m.name}")
    return REGISTRY
