"""Score formulas as columns. Inputs that are null give null unless a formula says otherwise."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def col(x: Number | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clip(x: Column, low: float, high: float) -> Column:
    """x within low and high; null stays null, which least and greatest alone would skip."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def r4(x: Column) -> Column:
    """Half up to four places, of the value to nine: a tie that binary arithmetic just misses still is one."""
    return F.round(F.round(x, 9), 4)


def ratio(part: Column, total: Column) -> Column:
    """part / total within 0 and 1; null where the total is not positive."""
    return F.round(F.when(total > 0, clip(part / total, 0, 1)), 6)


# ---- market scores


def breadth(up: Column, down: Column) -> Column:
    return r4(F.when(up + down > 0, up / (up + down)).otherwise(0.5))


def trend(r5: Column, r20: Column) -> Column:
    return r4(clip(0.5 + 2 * r5 + r20, 0, 1))


def crowding(theme: Column, limit_up: Column) -> Column:
    return r4(clip(0.7 * theme / 100 + 0.3 * F.least(limit_up / 50, F.lit(1.0)), 0, 1))


def rotation(theme: Column, breadth_: Column) -> Column:
    return r4(clip(1 - F.abs(theme / 100 - breadth_), 0, 1))


def range_bound(volatility: Column, breadth_: Column) -> Column:
    calm = F.when(volatility.isNotNull(), F.greatest(F.lit(0.0), 1 - 10 * F.abs(volatility - 0.02)))
    even = F.greatest(F.lit(0.0), 1 - 2 * F.abs(breadth_ - 0.5))
    return r4(clip(0.5 * calm + 0.5 * even, 0, 1))


def drawdown_risk(drawdown: Column, limit_down: Column) -> Column:
    return r4(clip(0.7 * F.least(4 * F.abs(drawdown), F.lit(1.0)) + 0.3 * F.least(limit_down / 30, F.lit(1.0)), 0, 1))


def retreat(loss: Column, limit_down_rate: Column, breakdown: Column, big_negative: Column) -> Column:
    """Weakness of yesterday's leaders; at RETREAT_LEVEL and above it counts as a retreat."""
    return r4(clip(0.35 * loss + 0.25 * limit_down_rate + 0.25 * breakdown + 0.15 * F.least(big_negative / 10, F.lit(1.0)), 0, 1))


RETREAT_LEVEL = 0.65


def snapshot_label(intraday: Column, r5: Column, r20: Column) -> Column:
    """Label of a market day from percent returns; the first that fits."""
    return (
        F.when((r20 >= 5) & (r5 >= 1) & (intraday >= 0), "strong_up")
        .when((r20 >= 2) & (r5 >= 0), "mild_up")
        .when((r20 <= -4) & (r5 <= -1), "weak")
        .when((r5 < 0) | (intraday < 0), "mild_down")
        .otherwise("flat")
    )


# ---- regimes

REGIMES = ("high_position_retreat", "downtrend", "crowding", "range", "rotation")


def ramp_up(x: Column, low: float, high: float) -> Column:
    return clip((x - low) / (high - low), 0, 1)


def ramp_down(x: Column, low: float, high: float) -> Column:
    return 1 - ramp_up(x, low, high)


def band(x: Column, low: float, high: float, soft: float) -> Column:
    """1 between low and high, falling to 0 over ``soft`` on both sides."""
    return F.least(ramp_up(x, low - soft, low), ramp_down(x, high, high + soft))


def regime_rule(s: Mapping[str, Column]) -> Column:
    """Regime by priority; UNKNOWN when any of its inputs is missing."""
    missing = s["retreat"].isNull() | s["drawdown"].isNull() | s["breadth"].isNull() | s["crowding"].isNull()
    return (
        F.when(missing, "UNKNOWN")
        .when(s["retreat"] >= RETREAT_LEVEL, REGIMES[0])
        .when((s["drawdown"] >= 0.6) & (s["breadth"] <= 0.35), REGIMES[1])
        .when(s["crowding"] >= 0.72, REGIMES[2])
        .when(s["breadth"].between(0.35, 0.6), REGIMES[3])
        .otherwise(REGIMES[4])
    )


#: Inputs of each regime's membership; a missing one adds an eighth to the unknown mass.
SLOTS = {"high_position_retreat": ("retreat",), "downtrend": ("drawdown", "breadth"), "crowding": ("crowding",), "range": ("breadth", "range"), "rotation": ("rotation", "breadth")}
BASE = 0.02


def memberships(s: Mapping[str, Column]) -> dict[str, Column]:
    """Fuzzy membership of each regime; a part whose input is missing counts as 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    parts = {
        "high_position_retreat": zero(ramp_up(s["retreat"], RETREAT_LEVEL - 0.25, RETREAT_LEVEL + 0.05)),
        "downtrend": 0.6 * zero(ramp_up(s["drawdown"], 0.40, 0.70)) + 0.4 * zero(ramp_down(s["breadth"], 0.25, 0.50)),
        "crowding": zero(ramp_up(s["crowding"], 0.57, 0.82)),
        "range": 0.5 * zero(band(s["breadth"], 0.35, 0.60, 0.10)) + 0.5 * zero(s["range"]),
        "rotation": 0.55 * zero(s["rotation"]) + 0.45 * zero(ramp_up(s["breadth"], 0.35, 0.60)),
    }
    return {k: v + BASE for k, v in parts.items()}


def unknown_mass(s: Mapping[str, Column]) -> Column:
    slots = [s[x] for own in SLOTS.values() for x in own]
    return sum((F.when(x.isNull(), 1.0).otherwise(0.0) for x in slots), F.lit(0.0)) / len(slots)


def regime_probabilities(s: Mapping[str, Column]) -> dict[str, Column]:
    """Memberships and unknown mass, normalised to 4 places."""
    own, unknown = memberships(s), unknown_mass(s)
    total = sum(own.values(), F.lit(0.0)) + unknown
    return {k: r4(v / total) for k, v in own.items()} | {"UNKNOWN": r4(unknown / total)}


def most_likely(p: Mapping[str, Column]) -> Column:
    """(p, name) of the largest; of equal ones the first named, and UNKNOWN only when it is larger than all."""
    return F.array_max(F.array(*(F.struct(c.alias("p"), F.lit(-k).alias("order"), F.lit(name).alias("name")) for k, (name, c) in enumerate(p.items()))))


def blend(p: Mapping[str, Column], hint: Mapping[str, Column], weight: float = 0.25) -> dict[str, Column]:
    """(1 - weight) p + weight hint, normalised again."""
    mixed = {k: (1 - weight) * c + weight * F.coalesce(hint.get(k, F.lit(None).cast("double")), F.lit(0.0)) for k, c in p.items()}
    total = sum(mixed.values(), F.lit(0.0))
    return {k: r4(F.when(total > 0, c / total).otherwise(0.0)) for k, c in mixed.items()}


# ---- signals, themes, opportunities


def weighted(parts: Iterable[tuple[float, Column]]) -> Column:
    return sum((w * c for w, c in parts), F.lit(0.0))


def theme_score(x: Mapping[str, Column]) -> Column:
    parts = [(0.25, "price"), (0.15, "volume"), (0.15, "flow"), (0.20, "news"), (0.15, "technical"), (0.10, "knowledge"), (-0.20, "risk")]
    return F.round(clip(weighted((w, F.coalesce(x[k], F.lit(0.0))) for w, k in parts), 0, 100), 2)


OPPORTUNITY = ((0.25, "theme_score"), (0.20, "technical_score"), (0.20, "factor_score"), (0.15, "regime_fit_score"), (0.10, "knowledge_score"), (-0.10, "risk_score"))


def opportunity_score(x: Mapping[str, Column]) -> Column:
    """Weighted components less risk; a missing one counts as 50."""
    return r4(clip(weighted((w, F.coalesce(x[k], F.lit(50.0))) for w, k in OPPORTUNITY), 0, 100))


def signal_score(base: Column, weight: Column) -> Column:
    return clip(base * (0.7 + F.coalesce(weight, F.lit(0.05))), 0, 100)


def adjusted_signal(raw: Column, regime: Column, theme: Column, liquid: Column) -> Column:
    """Deltas by regime, theme strength and liquidity."""
    by_regime = (
        F.when(regime == "rotation", F.when(raw <= 80, 5.0).otherwise(-5.0)).when(regime == REGIMES[0], -12.0).when(regime == "downtrend", -18.0).otherwise(0.0)
    )
    by_theme = F.when(theme >= 75, 5.0).when(theme <= 45, -5.0).otherwise(0.0)
    return clip(raw + by_regime + by_theme + F.when(liquid, 0.0).otherwise(-10.0), 0, 100)


def codes(checks: Mapping[str, Column]) -> Column:
    """Sorted array of the names whose check is true; null checks do not count."""
    return F.array_sort(F.filter(F.array(*(F.when(c, name) for name, c in checks.items())), lambda x: x.isNotNull()))
