"""Error and skill between datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nilas.functions import calendar as cal
from nilas.functions.stats import bias, correlation, mae, rmse

LEVEL = 15.0


def day_weighted(monthly: DataFrame, values: list[str], keys) -> DataFrame:
    """Annual means of monthly metrics, weighted with month lengths."""
    w = cal.month_days(F.col("mo"))
    return monthly.groupBy(*keys).agg(*(F.try_divide(F.sum(F.col(v) * w), F.sum(F.when(F.col(v).isNotNull(), w))).alias(v) for v in values))


def monthly_difference(pairs: DataFrame, x: str, y: str, keys, w: Column | None = None) -> DataFrame:
    """Bias, mean absolute and root-mean-square difference of y to x by calendar month."""
    w = F.lit(1.0) if w is None else w
    a, b = F.col(x), F.col(y)
    return pairs.groupBy(*keys, "mo").agg(bias(b, a, w).alias("bias"), mae(b, a, w).alias("mae"), rmse(b, a, w).alias("rmse"))


def paired_skill(y: Column, x: Column) -> tuple[Column, Column]:
    """Correlation and RMSE over paired points, null under two pairs."""
    ok = y.isNotNull() & x.isNotNull()
    enough = F.count(F.when(ok, 1)) >= 2
    return F.when(enough, correlation(y, x)), F.when(enough, rmse(y, x, F.lit(1.0)))


def edge_error(pairs: DataFrame, reference: str, model: str, area: str, keys) -> DataFrame:
    """Integrated edge error in 10^6 km2: over O, under U, O + U and O - U. A missing concentration counts as no ice."""
    ice = lambda c: F.coalesce(F.col(c) >= LEVEL, F.lit(False))
    part = lambda ok: F.coalesce(F.sum(F.when(ok, F.col(area))), F.lit(0.0)) / 1e12
    out = pairs.groupBy(*keys).agg(part(ice(model) & ~ice(reference)).alias("over"), part(~ice(model) & ice(reference)).alias("under"))
    return out.withColumns({"total": F.col("over") + F.col("under"), "net": F.col("over") - F.col("under")})


def vector_correlation(pairs: DataFrame, keys, least: int = 11) -> DataFrame:
    """Squared vector correlation of (u1, v1) and (u2, v2), halved to 0..1, from at least `least` common samples.

    It is the trace of A^-1 C B^-1 C', with the covariances A of the first vector, B of the second and C between them. A^-1 is adj(A) / det(A).
    """
    one, two = ("u1", "v1"), ("u2", "v2")
    names = [*one, *two]
    ok = pairs.where(" AND ".join(f"{c} IS NOT NULL" for c in names))
    cov = ok.groupBy(*keys).agg(F.count("*").alias("n"), *(F.covar_samp(a, b).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]))
    c = lambda a, b: F.col(f"{min(a, b, key=names.index)}_{max(a, b, key=names.index)}")

    def adjugate(p):
        u, v = p
        return {(u, u): c(v, v), (v, v): c(u, u), (u, v): -c(u, v), (v, u): -c(u, v)}

    a, b = adjugate(one), adjugate(two)
    trace = sum(a[i, j] * c(j, k) * b[k, m] * c(i, m) for i in one for j in one for k in two for m in two)
    det = (c("u1", "u1") * c("v1", "v1") - c("u1", "v1") ** 2) * (c("u2", "u2") * c("v2", "v2") - c("u2", "v2") ** 2)
    return cov.select(*keys, F.when((F.col("n") >= least) & (F.abs(det) > 1e-14), trace / det / 2).alias("value"))


def mean_cosine(pairs: DataFrame, keys) -> DataFrame:
    """Mean cosine of the angle between two vector maps over cells where neither is zero; two cells at least."""
    norm = F.sqrt((F.col("u1") ** 2 + F.col("v1") ** 2) * (F.col("u2") ** 2 + F.col("v2") ** 2))
    cos = F.when(norm > 0, (F.col("u1") * F.col("u2") + F.col("v1") * F.col("v2")) / norm)
    return pairs.groupBy(*keys).agg(F.when(F.count(cos) >= 2, F.avg(cos)).alias("value"))


def area_correlation(pairs: DataFrame, x: str, y: str, w: str, keys, least: int) -> DataFrame:
    """Weighted Pearson correlation from centred moments, with at least `least` points."""
    ok = pairs.where(f"{x} IS NOT NULL AND {y} IS NOT NULL AND {w} IS NOT NULL")
    means = ok.groupBy(*keys).agg(F.count("*").alias("_n"), (F.sum(F.col(x) * F.col(w)) / F.sum(w)).alias("_x"), (F.sum(F.col(y) * F.col(w)) / F.sum(w)).alias("_y"))
    a, b = F.col(x) - F.col("_x"), F.col(y) - F.col("_y")
    m = ok.join(means, keys).groupBy(*keys, "_n").agg(F.sum(a * b * F.col(w)).alias("xy"), F.sum(a * a * F.col(w)).alias("xx"), F.sum(b * b * F.col(w)).alias("yy"))
    return m.select(*keys, F.when((F.col("_n") >= least) & (F.col("xx") > 1e-12) & (F.col("yy") > 1e-12), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("value"))


def uncertainty_ratio(model: Column, second: Column) -> Column:
    """|model error| over |error of a second observation|, denominators of 1e-9 at least."""
    return F.abs(model) / F.greatest(F.abs(second), F.lit(1e-9))
