"""Rule packs compiled to columns of three truth values: true, false and null for undecided.

A rule is a nested mapping with one operator each: all, any and not combine rules; gt, gte, lt, lte, eq and between compare
columns or numbers; cross_up and cross_down compare with the row before, rising and falling over n rows; count_true,
rolling_max and rolling_min look at the last n rows; context_gte and context_lte compare a given context value.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from marlstone.functions.series import by_day, cross_down, cross_up

COMPARE = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le, "eq": operator.eq}
#: Least and most arguments of each operator.
ARITY = {
    "all": (1, 100), "any": (1, 100), "not": (1, 1), "gt": (2, 2), "gte": (2, 2), "lt": (2, 2), "lte": (2, 2), "eq": (2, 2), "between": (3, 3),
    "cross_up": (2, 2), "cross_down": (2, 2), "rising": (2, 2), "falling": (2, 2), "count_true": (3, 3), "rolling_max": (2, 2),
    "rolling_min": (2, 2), "context_gte": (2, 2), "context_lte": (2, 2),
}
DEPTH, NODES = 12, 100
#: Operators whose second argument is a number of rows up to the present one.
WINDOWED = ("rising", "falling", "count_true", "rolling_max", "rolling_min")


@dataclass(frozen=True)
class RulePack:
    """Rules by name: (expression, score from 0 to 100)."""

    name: str
    rules: Mapping[str, tuple[dict, float]]
    version: str = "1.0.0"
    order: WindowSpec | None = None


def _arguments(expression: dict) -> tuple[str, list]:
    (name, given), *rest = expression.items()
    if rest:
        raise ValueError("a rule has one operator")
    return name, given if isinstance(given, list) else [given]


def _is_past(rows: object) -> bool:
    return type(rows) is int and rows >= 1


def looks_ahead(expression: object) -> list[str]:
    """The operators in a rule whose rows aren't 1 or more up to the present one: a count below 1 would reach later rows."""
    found, todo = [], [expression]
    while todo:
        e = todo.pop()
        if not isinstance(e, dict) or len(e) != 1:
            continue
        name, given = _arguments(e)
        if name in WINDOWED and len(given) > 1 and not _is_past(given[1]):
            found.append(f"{name} over {given[1]!r} rows")
        todo += [g for g in given if isinstance(g, dict)]
    return found


def problems(pack: RulePack, columns: set[str]) -> list[str]:
    """What is wrong with a pack for a frame of those columns; empty when it can be compiled."""
    found = [] if re.fullmatch(r"\d+\.\d+\.\d+", pack.version) else [f"version {pack.version!r} is not major.minor.patch"]
    for rule, (expression, score) in pack.rules.items():
        if not 0 <= score <= 100:
            found.append(f"{rule}: score {score} is not within 0 to 100")
        nodes = 0
        todo = [(expression, 1)]
        while todo:
            e, depth = todo.pop()
            nodes += 1
            if not isinstance(e, dict) or len(e) != 1:
                found.append(f"{rule}: {e!r} is no rule")
                continue
            name, given = _arguments(e)
            if depth > DEPTH:
                found.append(f"{rule}: deeper than {DEPTH}")
                break
            if name not in ARITY:
                found.append(f"{rule}: no operator {name}")
                continue
            if not ARITY[name][0] <= len(given) <= ARITY[name][1]:
                found.append(f"{rule}: {name} has {len(given)} arguments")
            elif name in WINDOWED and not _is_past(given[1]):
                found.append(f"{rule}: {name} looks at {given[1]!r} rows, not at 1 or more up to now")
            for k, g in enumerate(given):
                if isinstance(g, dict):
                    todo.append((g, depth + 1))
                elif isinstance(g, str) and not name.startswith("context_") and g not in columns:
                    found.append(f"{rule}: no column {g}")
                elif name.startswith("context_") and k == 0 and not isinstance(g, str):
                    found.append(f"{rule}: {name} needs a path")
        if nodes > NODES:
            found.append(f"{rule}: more than {NODES} nodes")
    return found


def _context(path: str, context: Mapping) -> float | None:
    value: object = context
    for part in path.split("."):
        value = value.get(part) if isinstance(value, Mapping) else None
    return value if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def compile_rule(expression: dict, context: Mapping, order: WindowSpec | None = None) -> Column:
    """A boolean column; null means undecided. Columns must hold null, not NaN, for missing values."""
    order = order or by_day()
    name, given = _arguments(expression)
    last = lambda n: order.rowsBetween(-(int(n) - 1), 0)

    def value(x: object) -> Column:
        if isinstance(x, dict):
            return compile_rule(x, context, order)
        return F.col(x) if isinstance(x, str) else F.lit(x)

    if name in ("all", "any"):
        return reduce(operator.and_ if name == "all" else operator.or_, map(value, given))
    if name == "not":
        return ~value(given[0])
    if name in COMPARE:
        return COMPARE[name](value(given[0]), value(given[1]))
    if name == "between":
        return value(given[0]).between(value(given[1]), value(given[2]))
    if name == "cross_up":
        return cross_up(value(given[0]), value(given[1]), order)
    if name == "cross_down":
        return cross_down(value(given[0]), value(given[1]), order)
    if name in ("rising", "falling"):
        now, before = value(given[0]), F.lag(value(given[0]), int(given[1])).over(order)
        return now > before if name == "rising" else now < before
    if name == "count_true":
        return F.sum(F.when(value(given[0]), 1).otherwise(0)).over(last(given[1])) >= given[2]
    if name in ("rolling_max", "rolling_min"):
        how = F.max if name == "rolling_max" else F.min
        return F.when(F.count(value(given[0])).over(last(given[1])) == int(given[1]), value(given[0]) == how(value(given[0])).over(last(given[1])))
    if name in ("context_gte", "context_lte"):
        got = _context(given[0], context)
        return F.lit(None).cast("boolean") if got is None else F.lit(got >= given[1] if name == "context_gte" else got <= given[1])
    raise ValueError(f"no operator {name}")


def compile_pack(pack: RulePack, context: Mapping) -> dict[str, tuple[Column, float]]:
    return {k: (compile_rule(e, context, pack.order), score) for k, (e, score) in pack.rules.items()}


