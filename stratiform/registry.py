"""Registration of queries: a function of (spark, sf_dir) under its own name, with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None):
    def register(function: Callable) -> Callable:
        if function.__name__ in REGISTRY:
            raise ValueError(f"{function.__name__} is registered twice")
        REGISTRY[function.__name__] = (function, sql)
        return function

    return register
