"""Price-limit rules, tradability and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From this day on a main-board share under special treatment has the board's own limit.
ST_CHANGE = "2026-07-06"
COMMISSION, LEAST_COMMISSION, STAMP, SLIPPAGE = 0.00025, 5.0, 0.0005, 0.001


def board(code: Column) -> Column:
    return F.when(code.startswith("688"), "star").when(code.rlike("^30[01]"), "growth").when(code.rlike("^(920|8|4)"), "north").otherwise("main")


def rate_of(quoted: Column) -> Column:
    """A quoted limit rate; above 1 it is percent, and what is not positive does not count."""
    return F.when(quoted > 1, quoted / 100).when(quoted > 0, quoted)


def limit_rate(board_: Column, special: Column, day: Column, quoted: Column, unlimited: Column) -> Column:
    """Daily limit: none at listing, else as quoted, else by board and special treatment. Null is no limit."""
    by_board = (
        F.when(board_.isin("star", "growth"), 0.20)
        .when(board_ == "north", 0.30)
        .when(special & (day < F.lit(ST_CHANGE).cast("date")), 0.05)
        .otherwise(0.10)
    )
    return F.when(~unlimited, F.coalesce(rate_of(quoted), by_board))


def round_to_tick(price: Column, tick: Column) -> Column:
    """Half up to a multiple of the tick, in decimals."""
    steps = F.round(price.cast("decimal(20,6)") / tick.cast("decimal(12,6)"), 0)
    return (steps * tick.cast("decimal(12,6)")).cast("double")


def tick_size(*quoted: Column) -> Column:
    return F.coalesce(*(F.when(x > 0, x) for x in quoted), F.lit(0.01))


def limit_prices(before: Column, rate: Column, tick: Column) -> tuple[Column, Column]:
    """Upper and lower limit; infinite where there is none."""
    up = F.when(rate.isNull(), float("inf")).otherwise(round_to_tick(before * (1 + rate), tick))
    down = F.when(rate.isNull(), float("-inf")).otherwise(round_to_tick(before * (1 - rate), tick))
    return up, down


def suspended(volume: Column) -> Column:
    return F.coalesce(F.when(~F.isnan(volume), volume), F.lit(0.0)) <= 0


def can_buy(price: Column, upper: Column) -> Column:
    return F.coalesce(price < upper, F.lit(False))


def can_sell(price: Column, lower: Column) -> Column:
    return F.coalesce(price > lower, F.lit(False))


def trade_cost(value: Column, sells: Column) -> Column:
    return F.greatest(value * COMMISSION, F.lit(LEAST_COMMISSION)) + F.when(sells, value * STAMP).otherwise(0.0) + value * SLIPPAGE


def execution_price(model: Column, next_open: Column, next_close: Column, high: Column, low: Column, amount: Column, volume: Column, limit: Column) -> Column:
    """Fill price by model; a limit order fills only within the bar's range."""
    typical = (high + low + next_close) / 3
    return (
        F.when(model == "NEXT_OPEN", next_open)
        .when(model == "NEXT_CLOSE", next_close)
        .when(model == "VWAP", F.when((volume > 0) & (amount > 0), amount / volume).otherwise(typical))
        .when((model == "LIMIT_PRICE") & limit.between(low, high), limit)
    )
