"""Rule triggers as Column expressions in SQL's three-valued logic."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A condition: its key, and a value or, for AND, OR, NOT and scopes, more conditions.
Condition = tuple[str, "str | list"]


def compile_trigger(conditions: list[Condition], known: dict[str, Callable[[str], Column]]) -> Column:
    """True, false or null (unknown): all of the conditions. NOT holds where none of its conditions does.

    A key that is not known makes its condition unknown, so a rule that has it counts only where others decide.
    """

    def one(key: str, value) -> Column:
        if isinstance(value, list):
            inner = [one(k, v) for k, v in value]
            if key == "OR":
                return reduce(lambda a, b: a | b, inner, F.lit(False))
            if key == "NOT":
                return reduce(lambda a, b: a & b, (~c for c in inner), F.lit(True))
            if key in ("AND", "capital_scope"):
                return reduce(lambda a, b: a & b, inner, F.lit(True))
            return F.lit(None).cast("boolean")
        return known[key](value) if key in known else F.lit(None).cast("boolean")

    return reduce(lambda a, b: a & b, (one(k, v) for k, v in conditions), F.lit(True))


def unreadable(conditions: list[Condition], known: dict) -> set[str]:
    """The keys that a trigger uses and nobody can judge."""
    out: set[str] = set()
    for key, value in conditions:
        if isinstance(value, list):
            out |= (set() if key in ("AND", "OR", "NOT", "capital_scope") else {key}) | unreadable(value, known)
        elif key not in known:
            out.add(key)
    return out
