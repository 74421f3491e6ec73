"""Independent SQL statements (DuckDB) that the registered queries are compared with."""

from importlib import import_module

MODULES = ["scores", "steps", "scenes", "samples", "requests", "sources", "streams"]


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out.update(import_module(f"{__name__}.{m}").SQL)
    return out
