"""Seasons, key months and calendar weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days of the months without leap years, seasons in order and their days.
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}
SEASON_DAYS = {"DJF": 90, "MAM": 92, "JJA": 92, "SON": 91}
#: The months of the annual extremes by hemisphere.
KEY_MONTHS = {"north": (3, 9), "south": (2, 9)}


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").otherwise("SON")


def season_year(year: Column, month: Column) -> Column:
    """December belongs to the winter of the next year."""
    return F.when(month == 12, year + 1).otherwise(year)


def month_days(month: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTH_DAYS)), month)


SQL_SEASON = "CASE WHEN mo IN (12, 1, 2) THEN 'DJF' WHEN mo IN (3, 4, 5) THEN 'MAM' WHEN mo IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"
SQL_SEASON_YEAR = "(CASE WHEN mo = 12 THEN yr + 1 ELSE yr END)"
SQL_DAYS = f"([{', '.join(map(str, MONTH_DAYS))}])[mo]"
