"""Tolerant readings of numbers, flags, dates and symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_float(x: Column) -> Column:
    """A number, without thousands commas; 0 for null, empty or unreadable texts."""
    return F.coalesce(optional_float(x), F.lit(0.0))


def optional_float(x: Column) -> Column:
    """As ``safe_float``, but null where there is no number; a percent sign is dropped."""
    return F.trim(F.regexp_replace(x.cast("string"), "[,%]", "")).try_cast("double")


def optional_bool(x: Column) -> Column:
    low = F.lower(F.trim(x.cast("string")))
    return F.when(low.isin("true", "1", "yes", "y"), True).when(low.isin("false", "0", "no", "n"), False)


def parse_date(x: Column) -> Column:
    """yyyymmdd, yyyy-mm-dd or yyyy/mm/dd; null for anything else."""
    digits = F.regexp_replace(F.trim(x), "[-/]", "")
    return F.when(digits.rlike(r"^\d{8}$"), F.try_to_date(digits, "yyyyMMdd"))


def first_present(*xs: Column) -> Column:
    """The first text that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(x) != "", x) for x in xs))


def parse_price(x: Column) -> Column:
    """(status, value): MISSING for null or blank, INVALID for no positive number, else VALID."""
    text = F.trim(x.cast("string"))
    value = F.regexp_replace(text, ",", "").try_cast("double")
    good = (value > 0) & ~F.isnan(value) & (value < float("inf"))
    status = F.when(text.isNull() | (text == ""), "MISSING").when(good, "VALID").otherwise("INVALID")
    return F.struct(status.alias("status"), F.when(good, value).alias("value"))


def exchange_symbol(code: Column) -> Column:
    """A six-digit code with the suffix of its exchange; a code that has one keeps it."""
    plain = F.upper(F.trim(code))
    return (
        F.when(plain.contains("."), plain)
        .when(plain.rlike("^(6|9[^2])"), F.concat(plain, F.lit(".SH")))
        .when(plain.rlike("^(0|2|3)"), F.concat(plain, F.lit(".SZ")))
        .when(plain.rlike("^(4|8|92)"), F.concat(plain, F.lit(".BJ")))
        .otherwise(plain)
    )


def is_special_treatment(name: Column) -> Column:
    return F.coalesce(F.upper(name).contains("ST"), F.lit(False))


def period_name(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return F.when(low.isin("d", "1d", "day", "daily"), "1d").when(low.isin("w", "1w", "week", "weekly"), "1w").when(low.isin("m", "1mon", "month", "monthly"), "1mon").otherwise(low)


def adjust_name(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return F.when(low.isin("qfq", "front", "forward"), "front").when(low.isin("hfq", "back", "backward"), "back").otherwise("none")


def statutory_deadline(period_end: Column) -> Column:
    """Last legal disclosure day of a quarter's report; four months on (or that month's last day) for another period end."""
    y = F.year(period_end)
    q = F.date_format(period_end, "MM-dd")
    return (
        F.when(q == "03-31", F.make_date(y, F.lit(4), F.lit(30)))
        .when(q == "06-30", F.make_date(y, F.lit(8), F.lit(31)))
        .when(q == "09-30", F.make_date(y, F.lit(10), F.lit(31)))
        .when(q == "12-31", F.make_date(y + 1, F.lit(4), F.lit(30)))
        .otherwise(F.add_months(period_end, 4))
    )
