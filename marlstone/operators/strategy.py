"""Strategy definitions: checked, refused with named reasons, or compiled to columns of a frame of daily bars.

A definition speaks of what is known at a day's close: rules (see ``rules``) for the universe, entries and exits, a ranking of
weighted factors and a portfolio size. Its orders fill in the symbol's next session, never in the one that the signal is from.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import prices as X
from marlstone.functions.series import by_day
from marlstone.operators import rules

# The codes of refusals, in the order in which they are told.
RULES_MISSING, TIMELINE, RANKING, NOT_DSL, AHEAD, FAULTY = (
    "RULES_MISSING", "INVALID_EXECUTION_TIMELINE", "STRATEGY_REQUIRES_RANKING", "NON_DSL_EXPRESSION", "LOOKS_AHEAD", "FAULTY_RULE",
)
#: When an order may fill, and the execution model that does it.
FILLS = {"next_open": "NEXT_OPEN", "next_close": "NEXT_CLOSE", "vwap": "VWAP", "limit_price": "LIMIT_PRICE"}
#: Texts that no part of a definition may hold.
BANNED = ("python", "eval(", "exec(", "lookahead", "future_data")
#: Columns of bars that signals and fills are made from.
BAR = {"symbol", "d", "open", "high", "low", "close", "volume", "amount"}


@dataclass(frozen=True)
class Strategy:
    """``entry`` and ``universe`` hold when all their rules do, ``exit`` when any does; ``ranking`` has {factor, weight}."""

    name: str
    entry: Sequence[dict]
    exit: Sequence[dict]
    ranking: Sequence[dict]
    universe: Sequence[dict] = ()
    portfolio: Mapping = field(default_factory=lambda: {"top": 10})
    execution: Mapping = field(default_factory=lambda: {"signal_at": "close", "fill_at": "next_open"})

    @classmethod
    def of(cls, given: Mapping) -> Strategy:
        """From plain values. Unknown names, and rules that are no lists, are errors."""
        own = dict(given)
        for part in ("entry", "exit", "ranking", "universe"):
            if not isinstance(own.setdefault(part, []), list):
                raise TypeError(f"{part} is no list")
        return cls(**own)


def refusals(s: Strategy, columns: set[str]) -> dict[str, list[str]]:
    """Details by code of why a definition is refused for a frame of those columns; empty when it can be compiled."""
    found: dict[str, list[str]] = {}

    def no(code: str, detail: str) -> None:
        found.setdefault(code, []).append(detail)

    for part in ("entry", "exit"):
        if not getattr(s, part):
            no(RULES_MISSING, f"no {part} rules")
    if s.execution.get("signal_at") != "close" or s.execution.get("fill_at") not in FILLS:
        no(TIMELINE, f"signal at {s.execution.get('signal_at')}, fill at {s.execution.get('fill_at')}")
    if not s.ranking:
        no(RANKING, "no ranking")
    # Only what a user writes as rules is searched: the field "execution" itself holds "exec".
    written = json.dumps([list(s.universe), list(s.entry), list(s.exit), list(s.ranking)], ensure_ascii=False).lower()
    for word in BANNED:
        if word in written:
            no(NOT_DSL, f"holds {word!r}")
    for part in ("universe", "entry", "exit"):
        for k, e in enumerate(getattr(s, part)):
            ahead = rules.looks_ahead(e)
            for text in ahead:
                no(AHEAD, f"{part} {k}: {text}")
            faults = rules.problems(rules.RulePack(s.name, {f"{part} {k}": (e, 0)}), columns)
            for text in faults if not ahead else ():
                no(FAULTY, text)
    for k, r in enumerate(s.ranking):
        if not isinstance(r, Mapping) or set(r) != {"factor", "weight"} or r["factor"] not in columns or not _number(r["weight"]):
            no(FAULTY, f"ranking {k}: {r!r}")
    top = s.portfolio.get("top")
    if not isinstance(top, int) or isinstance(top, bool) or top < 1:
        no(FAULTY, f"portfolio: top is {top!r}")
    offset = s.execution.get("limit_offset", 0)
    if not _number(offset) or not -1 < offset:
        no(FAULTY, f"execution: limit_offset is {offset!r}")
    order = (RULES_MISSING, TIMELINE, RANKING, NOT_DSL, AHEAD, FAULTY)
    return {code: found[code] for code in order if code in found}


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


@dataclass(frozen=True)
class Compiled:
    name: str
    enters: Column
    exits: Column
    score: Column
    model: str
    limit: Column
    top: int


def compile_strategy(s: Strategy, columns: set[str], context: Mapping | None = None) -> Compiled:
    """Columns of a definition over a frame of those columns; a refused one raises its codes and details."""
    if why := refusals(s, columns):
        raise ValueError("; ".join(f"{code}: {', '.join(details)}" for code, details in why.items()))
    of = lambda e: F.coalesce(rules.compile_rule(e, context or {}), F.lit(False))
    enters = reduce(operator.and_, map(of, [*s.universe, *s.entry]))
    score = reduce(operator.add, (F.col(r["factor"]) * float(r["weight"]) for r in s.ranking))
    limit = F.col("close") * (1 + float(s.execution.get("limit_offset", 0)))
    return Compiled(s.name, enters, reduce(operator.or_, map(of, s.exit)), score, FILLS[s.execution["fill_at"]], limit, s.portfolio["top"])


def signals(frame: DataFrame, strategies: Sequence[Strategy], context: Mapping | None = None) -> DataFrame:
    """Orders of all strategies over ``frame`` (``BAR`` and the columns that they name; one row a symbol and day).

    strategy, symbol, d; ``enters`` with the place among the day's entries (1 to the strategy's top), ``exits``; model;
    fill_d and price of the symbol's next bar; reason where it has no price: NO_NEXT_SESSION, SUSPENDED, LIMIT_PRICE_NOT_REACHED
    or NO_PRICE. Rules without a decision count as not met; a null score doesn't enter; equal scores go by symbol.

    The rules of all strategies are columns of one pass over the bars, dealt by symbol once; only what fires is dealt by day.
    """
    if lacking := BAR - set(frame.columns):
        raise ValueError(f"the frame lacks {sorted(lacking)}")
    if len({s.name for s in strategies}) != len(strategies):
        raise ValueError("two strategies have one name")
    made = [compile_strategy(s, set(frame.columns), context) for s in strategies]
    ahead = lambda c: F.lead(c).over(by_day())
    nexts = {f"next_{c}": ahead(c) for c in ("d", "open", "high", "low", "close", "volume", "amount")}
    # Window functions can't be inside an array's struct of a generator: they become columns first.
    own = {}
    for k, m in enumerate(made):
        own |= {f"enters_{k}": m.enters & m.score.isNotNull(), f"exits_{k}": m.exits, f"score_{k}": m.score.cast("double"), f"limit_{k}": m.limit}
    fired = frame.select("symbol", "d", *(c.alias(n) for n, c in (nexts | own).items()))
    each = F.array(
        *(
            F.struct(F.lit(m.name).alias("strategy"), F.col(f"enters_{k}").alias("enters"), F.col(f"exits_{k}").alias("exits"), F.col(f"score_{k}").alias("score"), F.lit(m.model).alias("model"), F.col(f"limit_{k}").alias("limit"), F.lit(m.top).alias("top"))
            for k, m in enumerate(made)
        )
    )
    rows = fired.select("symbol", "d", *nexts, F.inline(F.filter(each, lambda x: x["enters"] | x["exits"])))
    day = Window.partitionBy("strategy", "d").orderBy(F.desc("enters"), F.desc("score"), "symbol")
    rows = rows.withColumn("place", F.when(F.col("enters"), F.row_number().over(day)))
    rows = rows.withColumn("enters", F.col("enters") & (F.col("place") <= F.col("top"))).where("enters OR exits")
    n = lambda c: F.col(f"next_{c}")
    price = X.execution_price(F.col("model"), n("open"), n("close"), n("high"), n("low"), n("amount"), n("volume"), F.col("limit"))
    price = F.when(~X.suspended(n("volume")) & (price > 0), price)
    reason = (
        F.when(n("d").isNull(), "NO_NEXT_SESSION")
        .when(X.suspended(n("volume")), "SUSPENDED")
        .when(F.col("price").isNull(), F.when(F.col("model") == "LIMIT_PRICE", "LIMIT_PRICE_NOT_REACHED").otherwise("NO_PRICE"))
    )
    rows = rows.withColumn("price", price)
    return rows.select("strategy", "symbol", "d", "enters", F.when(F.col("enters"), F.col("place")).alias("place"), "exits", "model", n("d").alias("fill_d"), "price", reason.alias("reason"))
