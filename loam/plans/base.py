"""A register that keeps a query beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable


class Register:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        def add(function: Callable) -> Callable:
            self.queries[function.__name__] = function
            if sql:
                self.sql[function.__name__] = sql
            return function

        return add
