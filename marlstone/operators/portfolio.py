"""Portfolio construction in basis points: bands, exposure caps, risk budget and turnover as window passes.

Weights are whole basis points (a weight of 0.0345 is 345), so that every cut is exact. The trims of a sequential
pipeline are running sums here: of the members of a group in the order of cutting, each is cut by what the excess leaves
after all before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col

#: Score from which each band holds, its lowest and highest weight.
BANDS = (("high_conviction", 85, 600, 1000), ("normal", 72, 300, 600), ("starter", 60, 100, 300))
EXIT, REDUCE = 30, 45
CAPS = (("theme", 4000), ("sector", 5000), ("cluster", 5000))
BUDGETS = {"crowding": 9000, "rotation": 7500, "range": 6000, "high_position_retreat": 3500, "downtrend": 2000}
DEFAULT_BUDGET, SINGLE, LEAST_DELTA, TURNOVER = 5000, 1000, 100, 3000


def band_of(score: Column) -> Column:
    out = F.lit("watch")
    for name, least, _, _ in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def _bound(score: Column, which: int) -> Column:
    out = F.lit(0)
    for band in reversed(BANDS):
        out = F.when(score >= band[1], band[which]).otherwise(out)
    return out


def first_target(score: Column, held: Column) -> Column:
    """Target before caps: exit, reduce by half (half up), hold within the band, trim to its top, or its middle."""
    low, high = _bound(score, 2), _bound(score, 3)
    middle = F.least(F.floor((low + high + 1) / 2), F.lit(SINGLE))
    return (
        F.when(score.isNull(), held)
        .when((score < EXIT) & (held > 0), F.lit(0))
        .when((score < REDUCE) & (held > 0), F.floor((held + 1) / 2))
        .when(high == 0, held)
        .when(held > high, high)
        .when(held >= low, held)
        .otherwise(middle)
        .cast("long")
    )


def _first_cut(*by: str):
    """Members in the order of cutting: lowest score first, without a score before all."""
    return Window.partitionBy(*by).orderBy(F.coalesce("score", F.lit(-1.0)), "symbol")


def trim(df: DataFrame, by: list[str], cap: Column, applies: Column, code: str) -> DataFrame:
    """Cut targets until the sum over ``by`` is at most ``cap``."""
    whole = F.sum("target").over(Window.partitionBy(*by))
    before = F.coalesce(F.sum("target").over(_first_cut(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = F.when(applies, F.greatest(F.lit(0), F.least("target", whole - cap - before))).otherwise(F.lit(0))
    out = df.withColumn("_cut", cut)
    return out.withColumn("target", C("target") - C("_cut")).withColumn("codes", F.when(C("_cut") > 0, F.array_append("codes", F.lit(code))).otherwise(C("codes"))).drop("_cut")


def rebalance(df: DataFrame) -> DataFrame:
    """Drops changes below the least one, then the smallest changes until turnover is within its cap."""
    small = (C("target") != C("held")) & (F.abs(C("target") - C("held")) < LEAST_DELTA)
    df = df.withColumn("codes", F.when(small, F.array_append("codes", F.lit("DELTA_BELOW_MIN_REBALANCE"))).otherwise(C("codes"))).withColumn("target", F.when(small, C("held")).otherwise(C("target")))
    delta = F.abs(C("target") - C("held"))
    df = df.withColumn("_delta", delta)
    by = Window.partitionBy("portfolio")
    before = F.coalesce(F.sum("_delta").over(by.orderBy("_delta", "symbol").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    off = (C("_delta") > 0) & (F.sum("_delta").over(by) - before > TURNOVER)
    df = df.withColumn("_off", off)
    df = df.withColumn("codes", F.when(C("_off"), F.array_append("codes", F.lit("TURNOVER_CAP_TRIMMED"))).otherwise(C("codes")))
    return df.withColumn("target", F.when(C("_off"), C("held")).otherwise(C("target"))).drop("_delta", "_off")


def actions(states: DataFrame) -> DataFrame:
    """Actions of ``states`` (portfolio, symbol, score, held, theme, sector, cluster, regime): target, codes and action."""
    df = states.withColumn("target", first_target(C("score"), C("held"))).withColumn("codes", F.array().cast("array<string>"))
    for group, cap in CAPS:
        df = trim(df, ["portfolio", group], F.lit(cap), C(group).isNotNull(), f"{group.upper()}_CAP")
    budget = F.lit(DEFAULT_BUDGET)
    for regime, most in BUDGETS.items():
        budget = F.when(C("regime") == regime, most).otherwise(budget)
    df = rebalance(trim(df, ["portfolio"], budget, F.lit(True), "RISK_BUDGET_SCALED"))
    band = band_of(C("score"))
    action = (
        F.when(C("target") > C("held"), F.when(band == "watch", "normal").otherwise(band))
        .when(C("target") < C("held"), F.when(C("target") == 0, "exit").otherwise("reduce"))
        .when(C("held") > 0, "hold")
        .otherwise("watch")
    )
    return df.withColumn("action", F.when(C("score").isNull() & (C("target") > C("held")), "normal").otherwise(action))
