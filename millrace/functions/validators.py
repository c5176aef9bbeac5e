"""Checks of single values at the edge: chains of tests that stop at the first that fails."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

Check = Callable[[Any], str | None]


class Value:
    """A chain: ``Value("age").required().kind(int).between(0, 150).problem(x)`` is a text or None."""

    def __init__(self, name: str):
        self.name, self.checks, self.optional = name, [], True

    def _add(self, bad: Callable[[Any], bool], text: str) -> Value:
        self.checks.append(lambda v: f"{self.name} {text}" if bad(v) else None)
        return self

    def required(self) -> Value:
        self.optional = False
        return self

    def kind(self, *types: type) -> Value:
        return self._add(lambda v: not isinstance(v, types) or (isinstance(v, bool) and bool not in types), f"must be {' or '.join(t.__name__ for t in types)}")

    def length(self, least: int = 0, most: int | None = None) -> Value:
        return self._add(lambda v: len(v) < least or (most is not None and len(v) > most), f"must have {least} to {most if most is not None else 'any number of'} characters")

    def between(self, least: float | None = None, most: float | None = None) -> Value:
        return self._add(lambda v: (least is not None and v < least) or (most is not None and v > most), f"must be from {least} to {most}")

    def matches(self, pattern: str) -> Value:
        return self._add(lambda v: re.fullmatch(pattern, v) is None, "has a bad form")

    def one_of(self, *choices: Any) -> Value:
        return self._add(lambda v: v not in choices, f"must be one of {', '.join(map(str, choices))}")

    def custom(self, test: Callable[[Any], bool], text: str) -> Value:
        return self._add(lambda v: not test(v), text)

    def problem(self, v: Any) -> str | None:
        if v is None or v == "":
            return None if self.optional else f"{self.name} is required"
        return next((p for c in self.checks if (p := c(v))), None)


def problems(values: dict, rules: list[Value]) -> list[str]:
    """What is wrong with a mapping, in the order of the rules."""
    return [p for r in rules if (p := r.problem(values.get(r.name)))]


#: Connection requests.
CONNECTION = [
    Value("host").required().kind(str).length(1, 255).matches(r"[A-Za-z0-9](?:[A-Za-z0-9.:-]*[A-Za-z0-9])?").custom(lambda v: ".." not in v, "has a bad form"),
    Value("port").required().kind(int).between(1, 65535),
    Value("database").required().kind(str).length(1, 64).matches(r"[A-Za-z0-9_-]+"),
    Value("user").required().kind(str).length(1, 128).matches(r"[A-Za-z0-9_.@-]+"),
]
