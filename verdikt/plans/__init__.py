"""Input views and the registered queries."""

from importlib import import_module

MODULES = ["scores", "steps", "scenes", "samples", "requests", "sources", "streams"]


def load_all() -> None:
    for m in MODULES:
        import_module(f"{__name__}.{m}")
