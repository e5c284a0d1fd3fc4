"""Statistics as column expressions: Student t, regressions, weighted moments."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Part of the last digit that is added before rounding.
NUDGE = 0.031


def finite(x: Column) -> Column:
    """NaN is missing."""
    return F.nanvl(x, F.lit(None).cast("double"))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero. Values halfway between two results, which round either way after inexact sums, go up."""
    return F.round(finite(x) + F.lit(NUDGE * 10.0**-digits), digits) + F.lit(0.0)


def correlation(y: Column, x: Column) -> Column:
    """Pearson's r over pairs without nulls; null where a side doesn't vary."""
    both = y.isNotNull() & x.isNotNull()
    sy, sx = F.stddev_pop(F.when(both, y)), F.stddev_pop(F.when(both, x))
    return F.when((sy > 1e-12) & (sx > 1e-12), F.try_divide(F.covar_pop(F.when(both, y), F.when(both, x)), sy * sx))  # corr() itself fails without variance


def student_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation r over n pairs, n - 2 degrees of freedom; null without a degree of freedom.

    With sin(theta) = |r| the tail is a finite sum for whole degrees of freedom.
    """
    df = n.cast("int") - 2
    s, c2 = F.abs(r), F.greatest(1 - r * r, F.lit(0.0))
    odd = df % 2 == 1
    terms = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")

    def step(acc: Column, j: Column) -> Column:
        ratio = F.when(odd, (2 * j + 2) / (2 * j + 3)).otherwise((2 * j + 1) / (2 * j + 2))
        more = F.when(j < terms, acc["term"]).otherwise(0.0)
        return F.struct((acc["term"] * c2 * ratio).alias("term"), (acc["total"] + more).alias("total"))

    first = F.when(odd, F.sqrt(c2)).otherwise(F.lit(1.0))
    total = F.aggregate(F.sequence(F.lit(0), F.greatest(terms - 1, F.lit(0))), F.struct(first.alias("term"), F.lit(0.0).alias("total")), step, lambda acc: acc["total"])
    inside = F.when(odd, 2 / math.pi * (F.asin(F.least(s, F.lit(1.0))) + s * total)).otherwise(s * total)
    return F.when((df > 0) & r.isNotNull(), F.greatest(F.lit(0.0), 1 - inside))


def regression(y: str | Column, x: str | Column) -> Column:
    """Struct of slope, intercept, r, n, detrended population deviation and the slope's standard error, over pairs without nulls."""
    y, x = (F.col(c) if isinstance(c, str) else c for c in (y, x))
    r = correlation(y, x)
    slope = finite(F.regr_slope(y, x))
    rest = F.sqrt(F.greatest(F.lit(0.0), F.regr_syy(y, x) * (1 - F.coalesce(r * r, F.lit(0.0))) / F.regr_count(y, x)))
    n, sxx = F.regr_count(y, x), F.regr_sxx(y, x)
    stderr = F.when(slope.isNotNull() & (n > 2), rest * F.sqrt(n / ((n - 2) * sxx))).when(slope.isNotNull() & (n == 2), 0.0)
    return F.struct(slope.alias("slope"), finite(F.regr_intercept(y, x)).alias("intercept"), r.alias("r"), F.regr_count(y, x).alias("n"), rest.alias("rest"), stderr.alias("stderr"))


def bias(y: Column, x: Column, w: Column) -> Column:
    """Weighted mean of y - x over pairs without nulls."""
    ok = y.isNotNull() & x.isNotNull()
    return F.try_divide(F.sum(F.when(ok, (y - x) * w)), F.sum(F.when(ok, w)))


def mae(y: Column, x: Column, w: Column) -> Column:
    ok = y.isNotNull() & x.isNotNull()
    return F.try_divide(F.sum(F.when(ok, F.abs(y - x) * w)), F.sum(F.when(ok, w)))


def rmse(y: Column, x: Column, w: Column) -> Column:
    ok = y.isNotNull() & x.isNotNull()
    return F.sqrt(F.try_divide(F.sum(F.when(ok, (y - x) * (y - x) * w)), F.sum(F.when(ok, w))))


def product_correlation(y: Column, x: Column, w: Column) -> Column:
    """Pearson's r of y * w and x * w."""
    return correlation(y * w, x * w)


METRICS = {"bias": bias, "mae": mae, "rmse": rmse, "corr": product_correlation}


def metric(name: str, y: Column, x: Column, w: Column | None = None, mask: Column | None = None) -> Column:
    """A difference metric by name, with an optional weight and mask."""
    keep = lambda c: c if mask is None else F.when(mask, c)
    return METRICS[name](keep(y), keep(x), F.lit(1.0) if w is None else w)


def weighted_mean(x: Column, w: Column) -> Column:
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


# The same in SQL text.
def sql_corr(y: str, x: str) -> str:
    ok = f"{y} IS NOT NULL AND {x} IS NOT NULL"
    return f"(CASE WHEN stddev_pop(CASE WHEN {ok} THEN {y} END) > 1e-12 AND stddev_pop(CASE WHEN {ok} THEN {x} END) > 1e-12 THEN corr({y}, {x}) END)"


def sql_slope(y: str, x: str) -> str:
    return f"(CASE WHEN regr_count({y}, {x}) > 1 AND regr_sxx({y}, {x}) > 0 THEN regr_slope({y}, {x}) END)"


def sql_rest(y: str, x: str) -> str:
    return f"sqrt(greatest(0, regr_syy({y}, {x}) * (1 - coalesce(pow({sql_corr(y, x)}, 2), 0)) / regr_count({y}, {x})))"


def sql_stderr(y: str, x: str) -> str:
    n = f"regr_count({y}, {x})"
    return f"(CASE WHEN {n} > 2 AND regr_sxx({y}, {x}) > 0 THEN {sql_rest(y, x)} * sqrt({n} / (({n} - 2) * regr_sxx({y}, {x}))) WHEN {n} = 2 AND regr_sxx({y}, {x}) > 0 THEN 0.0 END)"


def sql_p(r: str, n: str) -> str:
    """Expression for student_p over columns r and n."""
    c = f"sqrt(greatest(0, 1 - {r} * {r}))"
    even = f"abs({r}) * coalesce(list_sum(list_transform(range(CAST(({n} - 2) // 2 AS BIGINT)), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow({c}, 2 * j))), 0)"
    odd = f"2 / pi() * (asin(least(abs({r}), 1)) + abs({r}) * coalesce(list_sum(list_transform(range(CAST(({n} - 3) // 2 AS BIGINT)), lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow({c}, 2 * j + 1))), 0))"
    return f"(CASE WHEN {n} > 2 AND {r} IS NOT NULL THEN greatest(0, 1 - CASE WHEN {n} % 2 = 1 THEN {odd} ELSE {even} END) END)"


def sql_bias(y: str, x: str, w: str = "1.0") -> str:
    ok = f"{y} IS NOT NULL AND {x} IS NOT NULL"
    return f"(sum(CASE WHEN {ok} THEN ({y} - {x}) * {w} END) / nullif(sum(CASE WHEN {ok} THEN {w} END), 0))"


def sql_mae(y: str, x: str, w: str = "1.0") -> str:
    ok = f"{y} IS NOT NULL AND {x} IS NOT NULL"
    return f"(sum(CASE WHEN {ok} THEN abs({y} - {x}) * {w} END) / nullif(sum(CASE WHEN {ok} THEN {w} END), 0))"


def sql_rmse(y: str, x: str, w: str = "1.0") -> str:
    ok = f"{y} IS NOT NULL AND {x} IS NOT NULL"
    return f"sqrt(sum(CASE WHEN {ok} THEN ({y} - {x}) * ({y} - {x}) * {w} END) / nullif(sum(CASE WHEN {ok} THEN {w} END), 0))"


def sql_round(x: str, digits: int = 6) -> str:
    return f"(round({x} + {NUDGE * 10.0**-digits!r}, {digits}) + 0.0)"


def sql_fixed(x: str, digits: int) -> str:
    """Fixed-point text, halves away from zero after nine digits."""
    return f"CAST(CAST(round(CAST(round({x}, 9) AS DECIMAL(30, 9)), {digits}) AS DECIMAL(30, {digits})) AS VARCHAR)"
