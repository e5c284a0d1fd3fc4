"""Alignment of datasets on time and cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["y", "x"]


def by_month(field: DataFrame, values: list[str], keys=CELL) -> DataFrame:
    """One row a month and cell: repeats in a month are averaged."""
    return field.groupBy("yr", "mo", *keys).agg(*(F.avg(v).alias(v) for v in values))


def aligned(left: DataFrame, right: DataFrame, values: list[str], on: list[str], how: str = "inner") -> DataFrame:
    """Rows of both sides with equal keys; the right side's values get the suffix 2."""
    return left.select(*on, *values).join(right.select(*on, *(F.col(v).alias(f"{v}2") for v in values)), on, how)


def first_and_last(left: DataFrame, right: DataFrame, values: list[str], keys: list[str], order: str = "time") -> DataFrame:
    """Alignment where keys repeat: the first row of the left side and the last of the right side win."""
    pick = lambda df, o: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(o))).where("_n = 1")
    return aligned(pick(left, F.col(order)), pick(right, F.col(order).desc()), values, keys)


def exact(left: DataFrame, right: DataFrame, values: list[str], keys: list[str], by: list[str], order: str = "time") -> DataFrame:
    """Alignment on the exact time with each dataset (`by`) of the right side; where keys repeat the first row of the left side and the last of the right side win, by partial aggregation."""
    one = left.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(order, *values)).alias("_l")).select(*keys, *(F.col(f"_l.{v}").alias(v) for v in values))
    two = right.groupBy(*keys, *by).agg(F.max_by(F.struct(*values), F.struct(order, *values)).alias("_r")).select(*keys, *by, *(F.col(f"_r.{v}").alias(f"{v}2") for v in values))
    return one.join(two, keys).select(*keys, *by, *values, *(f"{v}2" for v in values))


def three_way(first: DataFrame, second: DataFrame, third: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the first side whose keys are in the other two as well."""
    return first.join(second.select(*on).distinct(), on, "left_semi").join(third.select(*on).distinct(), on, "left_semi")


def both_zero_mask(a: Column, b: Column) -> Column:
    """Neither missing, and not both zero."""
    return a.isNotNull() & b.isNotNull() & ~((a == 0) & (b == 0))


def observed(obs: Column, model: Column, other: Column | None = None) -> Column:
    """Observation present and over zero, model (and a second observation) present."""
    ok = obs.isNotNull() & (obs > 0) & model.isNotNull()
    return ok if other is None else ok & other.isNotNull()


def masked(field: DataFrame, mask: DataFrame, values: list[str], on=CELL) -> DataFrame:
    """Values outside the mask become null; the mask is small and joined once."""
    marked = field.join(mask.select(*on).distinct().withColumn("_keep", F.lit(True)), on, "left")
    return marked.select(*(F.when(F.col("_keep"), F.col(c)).alias(c) if c in values else F.col(c) for c in field.columns))


def complete_members(rows: DataFrame, member: str, item: str, items: list[str], first: int | None = None, last: int | None = None, allow_incomplete: bool = True, least: int = 12) -> DataFrame:
    """Rows of the members that have every item, each with at least `least` months of each of the years first to last if these are given (columns yr, mo).

    With allow_incomplete=False an incomplete member is an error, found by a count when this is called.
    """
    own = rows.where(F.col(item).isin(*items))
    if first is not None and last is not None:
        years = own.where(F.col("yr").between(first, last)).groupBy(member, item, "yr").agg(F.count_distinct("mo").alias("_m")).where(F.col("_m") >= least)
        own = years.groupBy(member, item).agg(F.count("*").alias("_y")).where(F.col("_y") == last - first + 1)
    full = own.groupBy(member).agg(F.count_distinct(item).alias("_n")).where(F.col("_n") == len(items)).select(member)
    if not allow_incomplete and (missing := rows.select(member).distinct().join(full, member, "left_anti").count()):
        raise ValueError(f"{missing} members lack items or months")
    return rows.join(full, member, "left_semi")


def normalised(label: Column) -> Column:
    return F.lower(F.trim(label))


def membership(entries: DataFrame, models: DataFrame) -> DataFrame:
    """entries (group, member), models (position from 1, label) -> (group, dataset): a member is a model's label, compared without case and
    outer spaces, or its position; repeated members count once, unknown ones are dropped."""
    by_label = entries.join(models, normalised(F.col("member")) == normalised(F.col("label"))).select("group", F.col("label").alias("dataset"))
    index = F.when(F.col("member").rlike(r"^\s*[0-9]+\s*$"), F.trim("member").cast("int"))
    named = entries.join(models.select(normalised(F.col("label")).alias("_l")), normalised(F.col("member")) == F.col("_l"), "left_anti")
    by_index = named.withColumn("position", index).join(models, "position").select("group", F.col("label").alias("dataset"))
    return by_label.unionByName(by_index).distinct()


def coverage(field: DataFrame, valid: Column, needed: list[str], keys=("time", "y", "x")) -> DataFrame:
    """field with `matched`: whether its own value and those of all `needed` datasets are valid at its time and cell. A bitmap of the needed datasets is put together over the rows of each time and cell, which are as many as datasets."""
    bit = F.lit(0)
    for k, name in enumerate(needed):
        bit = F.when(F.col("dataset") == name, 1 << k).otherwise(bit)
    held = F.bit_or(F.when(valid, bit).otherwise(F.lit(0))).over(Window.partitionBy(*keys))
    return field.withColumn("matched", F.coalesce(valid, F.lit(False)) & (held == (1 << len(needed)) - 1))


def coverage_modes(field: DataFrame) -> DataFrame:
    """Rows of `coverage` once for own coverage and, where matched, once more for matched coverage."""
    modes = F.when(F.col("matched"), F.array(F.lit("own"), F.lit("matched"))).otherwise(F.array(F.lit("own")))
    return field.withColumn("coverage_mode", F.explode(modes))
