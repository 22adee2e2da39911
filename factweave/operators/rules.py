"""Declared rules as column expressions: predicates, first match by priority, tiers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Condition:
    """field: a column or a dotted path into a struct. Texts are compared without case unless case_sensitive."""

    field: str
    operator: str
    value: object = None
    case_sensitive: bool = False

    def column(self) -> Column:
        own, value = F.col(self.field), self.value
        text = own.cast("string")
        if not self.case_sensitive:
            text = F.lower(text)
            value = value.lower() if isinstance(value, str) else value
        number = own.try_cast("double")
        made = {
            "equals": lambda: text == str(value),
            "not_equals": lambda: text != str(value),
            "contains": lambda: F.contains(text, F.lit(str(value))),
            "not_contains": lambda: ~F.contains(text, F.lit(str(value))),
            "starts_with": lambda: F.startswith(text, F.lit(str(value))),
            "ends_with": lambda: F.endswith(text, F.lit(str(value))),
            "matches": lambda: own.cast("string").rlike(str(self.value)),
            "in": lambda: text.isin([str(v) if self.case_sensitive else str(v).lower() for v in self.value]),
            "greater_than": lambda: number > float(self.value),
            "less_than": lambda: number < float(self.value),
            "exists": lambda: own.isNotNull(),
            "not_exists": lambda: own.isNull(),
        }
        if self.operator not in made:
            raise ValueError(f"unknown operator: {self.operator}")
        found = made[self.operator]()
        return found if self.operator in ("exists", "not_exists") else F.coalesce(found, F.lit(False))


@dataclass(frozen=True)
class Rule:
    name: str
    priority: int
    conditions: Sequence[Condition]
    action: str
    match_any: bool = False

    def column(self) -> Column:
        parts = [c.column() for c in self.conditions]
        found = parts[0]
        for p in parts[1:]:
            found = found | p if self.match_any else found & p
        return found


def first_match(rules: Sequence[Rule], default: str = "ACCEPT") -> tuple[Column, Column]:
    """The action and the name of the first rule that fits, by descending priority and then by name."""
    ordered = sorted(rules, key=lambda r: (-r.priority, r.name))
    action = F.coalesce(*[F.when(r.column(), F.lit(r.action)) for r in ordered], F.lit(default))
    name = F.coalesce(*[F.when(r.column(), F.lit(r.name)) for r in ordered], F.lit("-"))
    return action, name
