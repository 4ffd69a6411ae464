"""Financial statements in two times: the period that a report covers, and the day on which it was announced.

A report is (symbol, period_end, announced, figures); a later report of the same period restates it. What was known on a
day are, of each period, the figures announced last up to that day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.joins import as_of

#: The time that a scan's bounds are about.
TIMES = {"announce_time": "announced", "report_time": "period_end"}


def revisions(reports: DataFrame) -> DataFrame:
    """Reports with their number among those of their period, from 1, and the days on which they were the known ones:
    ``announced`` up to the day before ``superseded``, null for the last. Only reports of one period share a window."""
    w = Window.partitionBy("symbol", "period_end").orderBy("announced")
    return reports.withColumn("revision", F.row_number().over(w)).withColumn("superseded", F.lead("announced").over(w))


def scan(reports: DataFrame, start: str | None = None, end: str | None = None, by: str = "announce_time") -> DataFrame:
    """Revisions whose announcement or period, by ``by``, lies within ``start`` and ``end``, both included.

    Bounds on periods hold before the revisions are numbered and reach the scan. Bounds on announcements come after it, as a
    report's number and end depend on reports outside them.
    """
    if by not in TIMES:
        raise ValueError(f"{by}: scans are by {sorted(TIMES)}")
    at = F.col(TIMES[by])
    within = (at >= F.lit(start).cast("date") if start else F.lit(True)) & (at <= F.lit(end).cast("date") if end else F.lit(True))
    return revisions(reports.where(within)) if by == "report_time" else revisions(reports).where(within)


def known(asked: DataFrame, reports: DataFrame, at: str, fields: list[str]) -> DataFrame:
    """``asked`` (symbol, ``at``, ...) with the newest period announced by that day and its figures as known then."""
    return as_of(asked, reports, "symbol", at, "announced", ["period_end", "announced"], ["period_end", "announced", *fields])


def known_of_period(asked: DataFrame, reports: DataFrame, period: str, at: str, fields: dict[str, str]) -> DataFrame:
    """``asked`` with the figures of the period that its column ``period`` names, as known on day ``at``; null before the
    first announcement. ``fields`` maps figures to the names that they get. One shuffle by symbol and period."""
    key = F.struct(F.col("symbol").alias("s"), F.col(period).alias("p"))
    marks = reports.select(F.struct(F.col("symbol").alias("s"), F.col("period_end").alias("p")).alias("_of"), "announced", *(F.col(f).alias(n) for f, n in fields.items()))
    return as_of(asked.withColumn("_of", key), marks, "_of", at, "announced", ["announced"], list(fields.values())).drop("_of")
