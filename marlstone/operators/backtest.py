"""Top-k portfolio backtest: a fold over days per strategy, with prices, limits and ranks prepared as columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import prices as X
from marlstone.operators.ordering import fold

LOT, LEAST_TRADE, INVESTED = 100, 1.0, 0.99
SCHEMA = "strategy long, d date, equity double, turnover double, holdings int, trades array<struct<symbol:long,side:string,shares:double,price:double,value:double,cost:double>>"


def cost_of(value: float, sells: bool) -> float:
    """The costs of ``prices.trade_cost`` for one trade inside the fold."""
    return max(value * X.COMMISSION, X.LEAST_COMMISSION) + (value * X.STAMP if sells else 0.0) + value * X.SLIPPAGE


def prepared(panel: DataFrame, limit: Column, *keys: str) -> DataFrame:
    """Adds to a panel (symbol, d, day, score, price, close, volume, and ``keys`` where it has several): tradable, buyable,
    sellable and each candidate's place of its day. Without a close before, there is no limit."""
    w = Window.partitionBy(*keys, "symbol").orderBy("d")
    before = F.lag("close").over(w)
    up, down = X.limit_prices(before, limit, F.lit(0.01))
    trades = ~X.suspended(F.col("volume")) & F.coalesce(F.col("price") > 0, F.lit(False))
    p = panel.withColumns({"tradable": trades, "buyable": before.isNull() | X.can_buy(F.col("price"), up), "sellable": before.isNull() | X.can_sell(F.col("price"), down)})
    place = F.row_number().over(Window.partitionBy(*keys, "d").orderBy(F.desc_nulls_last(F.when(F.col("tradable"), F.col("score"))), "symbol"))
    return p.withColumn("place", F.when(F.col("tradable") & F.col("score").isNotNull(), place))


def within_reach(panel: DataFrame, strategies: dict[int, tuple[int, int]]) -> DataFrame:
    """The rows of a prepared panel that each strategy (id: holdings, days between rebalances) can need, with columns strategy,
    top_k and interval.

    A symbol is bought first on a rebalance day on which it is buyable and among the ``top_k`` best of the buyable ones: what
    is held only pushes others back. Symbols that never are can't be held, nor keep another out, so the fold over the rest
    gives the same. Of every day the row of its least symbol stays, so that no day is lost.
    """
    every = F.array(*(F.struct(F.lit(k).cast("long").alias("strategy"), F.lit(n).alias("top_k"), F.lit(i).alias("interval")) for k, (n, i) in strategies.items()))
    rank = F.row_number().over(Window.partitionBy("d").orderBy("place"))
    can = panel.where("buyable and place is not null").select("symbol", "day", rank.alias("rank"))
    hit = can.select("symbol", F.explode(F.filter(every, lambda s: (F.col("day") % s["interval"] == 0) & (F.col("rank") <= s["top_k"]))).alias("x")).distinct()
    reach = hit.groupBy("symbol").agg(F.collect_set("x").alias("in_reach"))  # as many as there are strategies
    least = F.row_number().over(Window.partitionBy("d").orderBy("symbol")) == 1
    rows = panel.withColumn("least", least).join(reach, "symbol", "left")
    return rows.select(*panel.columns, F.explode(F.when(F.col("least"), every).otherwise(F.col("in_reach"))).alias("x")).select(*panel.columns, "x.*")


class Book:
    """Cash, lots by symbol in the order of buying, last closes."""

    def __init__(self, cash: float):
        self.cash, self.lots, self.last = cash, {}, {}

    def shares(self, s: int) -> float:
        return sum(q for q, _ in self.lots.get(s, ()))

    def sell(self, s: int, shares: float, price: float, day: int, trades: list) -> float:
        """Sell what was bought before today, first lots first; gives the value sold."""
        free = sum(q for q, bought in self.lots.get(s, ()) if bought < day)
        sold = left = min(shares, free)
        if sold <= 0:
            return 0.0
        rest = []
        for q, bought in self.lots[s]:
            take = min(q, left) if bought < day else 0.0
            left -= take
            if q - take > 1e-9:
                rest.append((q - take, bought))
        self.lots[s] = rest
        value = sold * price
        cost = cost_of(value, True)
        self.cash += value - cost
        trades.append((s, "sell", sold, price, value, cost))
        return value

    def buy(self, s: int, value: float, price: float, day: int, trades: list) -> float:
        """Buy whole lots for at most ``value`` and for the cash there is, with costs; gives the value bought."""
        value = min(value, self.cash)
        for _ in range(2):
            if value + cost_of(value, False) > self.cash + 1e-9:
                value = max(self.cash - cost_of(value, False), 0.0)
        shares = math.floor(value / price / LOT) * LOT
        if shares * price + cost_of(shares * price, False) > self.cash + 1e-9:
            shares = math.floor(max(self.cash - cost_of(shares * price, False), 0.0) / price / LOT) * LOT
        value = shares * price
        cost = cost_of(value, False)
        if value <= LEAST_TRADE or value + cost > self.cash + 1e-9:
            return 0.0
        self.cash -= value + cost
        self.lots.setdefault(s, []).append((float(shares), day))
        trades.append((s, "buy", float(shares), price, value, cost))
        return value


def rebalance(book: Book, rows: pd.DataFrame, day: int, top_k: int, trades: list) -> float:
    """Sell what left the target, thin what is too large, then fill up what is too small; gives the value traded."""
    own = rows.set_index("symbol")
    price, buyable, sellable, tradable = (own[c].to_dict() for c in ("price", "buyable", "sellable", "tradable"))
    candidates = own["place"].dropna().sort_values().index.tolist()
    # What cannot be bought takes no place unless it is held.
    target = [s for s in candidates if buyable[s] or book.shares(s) > 1e-9][:top_k]
    traded = 0.0
    for s in sorted(book.lots):
        if s not in target and book.shares(s) > 1e-9 and tradable.get(s) and sellable[s]:
            traded += book.sell(s, book.shares(s), price[s], day, trades)
    if not target:
        return traded

    def worth(s: int) -> float:
        p = price.get(s)
        return book.shares(s) * (p if p is not None and p > 0 else book.last.get(s, 0.0))

    each = INVESTED * (book.cash + sum(worth(s) for s in sorted(book.lots))) / len(target)
    for s in target:
        excess = worth(s) - each
        if excess > LEAST_TRADE and sellable[s]:
            traded += book.sell(s, excess / price[s], price[s], day, trades)
    for s in target:
        gap = each - worth(s)
        if gap > LEAST_TRADE and buyable[s]:
            traded += book.buy(s, gap, price[s], day, trades)
    return traded


def run_top_k(panel: DataFrame, cash: float = 1_000_000.0) -> DataFrame:
    """Equity, turnover, holdings and trades per strategy and day of a prepared panel with columns top_k and interval; every
    ``interval`` days the best ``top_k`` are held in equal parts. Lots bought today are sold tomorrow at the earliest."""

    def step(book: Book, rows: pd.DataFrame) -> list[tuple]:
        first = rows.iloc[0]
        day, trades = int(first["day"]), []
        closes = rows.loc[rows["close"] > 0, ["symbol", "close"]]
        book.last.update(zip(closes["symbol"].tolist(), closes["close"].tolist(), strict=True))
        traded = rebalance(book, rows, day, int(first["top_k"]), trades) if day % int(first["interval"]) == 0 else 0.0
        equity = book.cash + sum(book.shares(s) * book.last.get(s, 0.0) for s in sorted(book.lots))
        held = sum(1 for s in book.lots if book.shares(s) > 1e-9)
        names = ("symbol", "side", "shares", "price", "value", "cost")
        return [(first["strategy"], first["d"], equity, traded / equity if equity > 0 else 0.0, held, [dict(zip(names, t, strict=True)) for t in trades])]

    needed = ["strategy", "d", "day", "symbol", "price", "close", "tradable", "buyable", "sellable", "place", "top_k", "interval"]
    return fold(panel.select(*needed), "strategy", ["d", "symbol"], lambda _: Book(cash), step, SCHEMA)
