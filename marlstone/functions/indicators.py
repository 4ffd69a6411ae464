"""A registry of indicators: name, version, required columns, allowed parameters and a column builder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.series import change, full, rolling_mean, rolling_ratio, smoothed_any


@dataclass(frozen=True)
class Indicator:
    name: str
    version: str
    needs: frozenset[str]
    parameters: dict[str, tuple[int, int]]
    make: Callable[..., Column] | None

    def check(self, given: dict[str, int]) -> None:
        """All parameters must be there, each within its bounds."""
        if set(given) != set(self.parameters):
            raise ValueError(f"{self.name} takes {sorted(self.parameters)}")
        for k, v in given.items():
            low, high = self.parameters[k]
            if not isinstance(v, int) or not low <= v <= high:
                raise ValueError(f"{self.name}: {k} must be within {low} to {high}")
        if "fast" in given and given["fast"] >= given["slow"]:
            raise ValueError(f"{self.name}: fast must be below slow")

    def build(self, **given: int) -> Column:
        """The column for these parameters."""
        self.check(given)
        if self.make is None:
            raise ValueError(f"{self.name} isn't one column, use Registry.apply")
        return self.make(**given)


@dataclass
class Registry:
    known: dict[tuple[str, tuple[int, ...]], Indicator] = field(default_factory=dict)

    def add(self, indicator: Indicator) -> None:
        key = (indicator.name, tuple(map(int, indicator.version.split("."))))
        if key in self.known:
            raise ValueError(f"{indicator.name} {indicator.version} is registered")
        self.known[key] = indicator

    def get(self, name: str, version: str | None = None) -> Indicator:
        """That version, or the newest: 1.10.0 is newer than 1.9.0."""
        found = {v: i for (n, v), i in self.known.items() if n == name and (version is None or v == tuple(map(int, version.split("."))))}
        if not found:
            raise KeyError(f"no indicator {name} {version or ''}")
        return found[max(found)]

    def apply(self, df: DataFrame, asked: dict[str, tuple[str, dict]]) -> DataFrame:
        """Adds indicators under their aliases: ``{"fast": ("ema", {"window": 12})}``. One of several passes over the rows, or of
        several columns, comes from ``PASSES``; its columns are called alias_part."""
        if lack := self.missing([name for name, _ in asked.values()], set(df.columns)):
            raise ValueError(f"the frame lacks {lack}")
        for alias, (name, given) in asked.items():
            if name not in PASSES:
                df = df.withColumn(alias, self.get(name).build(**given))
        for alias, (name, given) in asked.items():
            if name in PASSES:
                self.get(name).check(given)
                df = PASSES[name](df, alias, **given)
        return df

    def missing(self, names: list[str], columns: set[str]) -> dict[str, set[str]]:
        """Columns that the named indicators need and a frame lacks."""
        return {n: lack for n in names if (lack := set(self.get(n).needs) - columns)}


INDICATORS = Registry()
WINDOW = {"window": (2, 1000)}
for _name, _column, _make in (
    ("sma", "close", lambda window: rolling_mean(F.col("close"), window)),
    ("volume_ma", "volume", lambda window: rolling_mean(F.col("volume"), window)),
    ("volume_ratio", "volume", lambda window: rolling_ratio(F.col("volume"), window)),
    ("rolling_high", "high", lambda window: full(F.col("high"), window, F.max)),
    ("return", "close", lambda window: change(F.col("close"), window)),
    ("rolling_std", "return", lambda window: full(F.col("return"), window, F.stddev_samp)),
    ("ema", "close", None),
):
    INDICATORS.add(Indicator(_name, "1.0.0", frozenset({"symbol", "d", _column}), WINDOW, _make))


def _ema(df: DataFrame, alias: str, window: int) -> DataFrame:
    return smoothed_any(df, "close", 2 / (window + 1), alias)


def _macd(df: DataFrame, alias: str, fast: int, slow: int, signal: int) -> DataFrame:
    dif, dea = f"{alias}_dif", f"{alias}_dea"
    df = smoothed_any(df, ["close", "close"], [2 / (fast + 1), 2 / (slow + 1)], ["_fast", "_slow"])
    df = smoothed_any(df.withColumn(dif, F.col("_fast") - F.col("_slow")).drop("_fast", "_slow"), dif, 2 / (signal + 1), dea)
    return df.withColumn(f"{alias}_hist", (F.col(dif) - F.col(dea)) * 2)


INDICATORS.add(Indicator("macd", "1.0.0", frozenset({"symbol", "d", "close"}), {"fast": (2, 200), "slow": (3, 400), "signal": (2, 200)}, None))
PASSES: dict[str, Callable[..., DataFrame]] = {"ema": _ema, "macd": _macd}
