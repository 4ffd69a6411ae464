"""Regime confirmation over days: a fold per market."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from marlstone.operators.ordering import fold

#: Days that a new regime needs, days that the old one must have lasted, and the rise in confidence a switch needs.
CONFIRMATION = {"high_position_retreat": 1, "downtrend": 2, "crowding": 2, "rotation": 2, "range": 3}
LEAST_DAYS, GAP, EMERGENCY = 2, 0.08, ("high_position_retreat", "downtrend")
SCHEMA = "market string, d date, confirmed string, candidate string, candidate_days int, confirmed_days int, confidence double, status string"


def confirm(days: DataFrame) -> DataFrame:
    """Confirmed regime per market and day from ``days`` (market, d, regime, p): the day's candidate and its confidence.
    Of several rows of one day the first in order of regime counts."""

    def step(s: dict, rows: pd.DataFrame) -> list[tuple]:
        r = rows.iloc[0]
        regime, p = r["regime"], float(r["p"])
        if not s:
            s.update(confirmed=regime, days=1, p=p, candidate=None, n=0)
            status = "stable"
        else:
            s["days"] += 1
            if regime == s["confirmed"]:
                s.update(candidate=None, n=0, p=p)
                status = "stable"
            else:
                s["n"] = s["n"] + 1 if regime == s["candidate"] else 1
                s["candidate"] = regime
                urgent = regime in EMERGENCY
                if s["n"] >= CONFIRMATION.get(regime, 2) and (urgent or (p >= s["p"] + GAP and s["days"] >= LEAST_DAYS)):
                    s.update(confirmed=regime, days=1, p=p, candidate=None, n=0)
                    status = "confirmed_switch"
                else:
                    status = "watch_switch"
        return [(r["market"], r["d"], s["confirmed"], s["candidate"], s["n"], s["days"], s["p"], status)]

    return fold(days.select("market", "d", "regime", "p"), "market", ["d", "regime"], lambda _: {}, step, SCHEMA)
