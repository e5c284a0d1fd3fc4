"""Area integrals and scalar physics of single datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nilas.functions.stats import weighted_mean


def volume(thickness: Column, area: Column) -> Column:
    """Volume in 10^3 km3; null where no cell is valid."""
    return F.sum(thickness / 1e3 * area / 1e6) / 1e3


def kinetic_energy(u: Column, v: Column) -> Column:
    return (u * u + v * v) / 2


def speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def signed_integrals(value: Column, area: Column) -> dict[str, Column]:
    """Positive, negative and net integrals over area, in km2 for fractions."""
    x = value * area / 1e6
    total = lambda ok: F.coalesce(F.sum(F.when(ok, x)), F.lit(0.0))
    return {"pos": total(value > 0), "neg": total(value < 0), "net": F.coalesce(F.sum(x), F.lit(0.0))}


def area_mean(value: Column, area: Column) -> Column:
    return weighted_mean(value, area)


def area_share(flag: Column, area: Column) -> Column:
    """Share of the area, in percent, where flag (0/1, null if unknown) is 1."""
    return 100 * weighted_mean(flag.cast("double"), area)


def sector_totals(flux_sums: DataFrame, keys) -> DataFrame:
    """Regional totals of kg/m2 over cells, in Gt."""
    return flux_sums.groupBy(*keys).agg((F.sum(F.col("value") * F.col("cell_area")) / 1e12).alias("value"))
