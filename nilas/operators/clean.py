"""Cleaning, masks and unit detection. Missing values are nulls from here on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing_to_null(x: Column) -> Column:
    """NaN, absolute values over 1e19, -9999 and 255 are missing."""
    x = F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    return F.when((F.abs(x) <= 1e19) & ~x.isin(-9999.0, 255.0), x)


def zero_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def scaled(field: DataFrame, value: str, small: Column, factor: float, keys=("dataset",)) -> DataFrame:
    """value times factor in datasets where `small`, an aggregate, holds. The decision is a tiny table that is joined back, not collected."""
    choice = field.groupBy(*keys).agg(F.coalesce(small, F.lit(False)).alias("_small"))
    return field.join(F.broadcast(choice), list(keys)).withColumn(value, F.when(F.col("_small"), F.col(value) * factor).otherwise(F.col(value))).drop("_small")


def percent(field: DataFrame, value: str, keys=("dataset",)) -> DataFrame:
    """Fractions become percent where the largest value is under 10; what isn't in 0..100 is null."""
    out = scaled(field, value, F.max(value) < 10, 100.0, keys)
    return out.withColumn(value, F.when(F.col(value).between(0, 100), F.col(value)))


def percent_by_quantile(field: DataFrame, value: str, keys=("dataset",), days: int = 366) -> DataFrame:
    """Fractions become percent where the 99th percentile (interpolated) of the first days is at most 1.5.

    The percentile lies between the values of two ranks. If both are at most 1.5, or both over it, counts of the values tell; only where
    1.5 lies between the two are the largest value below and the smallest above it needed. No task holds a dataset's values.
    """
    first, limit = F.when(F.col("i") < days, F.col(value)), 1.5
    n, low = F.count(first), F.count(F.when(first <= limit, first))
    rank = 0.99 * (n - 1)
    below, above = F.max(F.when(first <= limit, first)), F.min(F.when(first > limit, first))
    between = below + (rank - F.floor(rank)) * (above - below) <= limit
    return scaled(field, value, F.when(low > F.ceil(rank), True).when(low <= F.floor(rank), False).otherwise(between), 100.0, keys)


def metres_per_second(field: DataFrame, keys=("dataset",)) -> DataFrame:
    """cm/s become m/s where the largest u is over 5."""
    return scaled(scaled(field, "v", F.max("u") > 5, 0.01, keys), "u", F.max("u") > 5, 0.01, keys)


def between(x: Column, low: float, high: float) -> Column:
    return F.when(x.between(low, high), x)


def in_sector(field: DataFrame, sectors: DataFrame) -> DataFrame:
    """One row for each sector of a cell: `All` and its own."""
    return field.join(sectors, "region")


def ocean_mask(share: Column) -> Column:
    return F.when(share >= 0.99, 1).otherwise(0)


def displacement_drift(dx_km: Column, seconds: Column) -> Column:
    return F.try_divide(dx_km * 1000, seconds)


def error_flag(error: Column) -> tuple[Column, Column]:
    """Errors over 1 carry a flag as 1: (error, flag)."""
    return F.when(error > 1, error - 1).otherwise(error), (error > 1).cast("int")


def snow_depth(total: Column, ice: Column, total_std: Column, ice_std: Column, sic: Column) -> dict[str, Column]:
    depth = total - ice
    return {"depth": depth, "std": F.sqrt(total_std * total_std + ice_std * ice_std), "effective": depth * sic / 100}


def first_of_time(field: DataFrame, keys, time: str = "time", tie: str | None = None) -> DataFrame:
    """Repeated timestamps: the first row stays."""
    w = Window.partitionBy(*keys, time).orderBy(tie or time)
    return field.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def clean_months(months: Column) -> Column:
    """Month vectors: rounded, in 1..12, each once in first-seen order."""
    whole = F.filter(months, lambda m: m.isNotNull() & ~F.isnan(m))
    return F.array_distinct(F.filter(F.transform(whole, lambda m: F.round(m).cast("int")), lambda m: m.between(1, 12)))


def number(text: Column) -> Column:
    """Cell text without %, * and thousands separators as a number; words for missing give null."""
    bare = F.trim(F.regexp_replace(text, "[%*,]", ""))
    return F.when(F.lower(bare).isin("", "nan", "none", "null", "--"), None).otherwise(bare).try_cast("double")


def label(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s_-]+", " ")


def dataset_class(name: Column) -> Column:
    own = label(name)
    return F.when(own.startswith("obs"), "obs").when(own.startswith("group") | own.startswith("ensemble"), "group").otherwise("model")


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text. Halves go away from zero, told after nine digits, so that the noise of a sum decides nothing."""
    return F.round(F.round(value, 9).cast("decimal(30,9)"), digits).cast(f"decimal(30,{digits})").cast("string")


def starred(value: Column, p: Column, digits: int = 3) -> Column:
    """Fixed-point text with a star where p < 0.05; a missing value is a dash."""
    return F.when(value.isNull(), "--").otherwise(F.concat(fixed(value, digits), F.when(p < 0.05, "*").otherwise("")))
