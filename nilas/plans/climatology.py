"""T and A: resampling, climatology, areas and other integrals."""

from __future__ import annotations

from pyspark.sql import functions as F

from nilas.functions import calendar as cal
from nilas.functions.stats import rounded as r
from nilas.functions.stats import sql_round as q
from nilas.operators import climatology as c
from nilas.plans.registry import query

CELL = ["dataset", "y", "x"]
SEASON, SEASON_YEAR, DAYS = cal.SQL_SEASON, cal.SQL_SEASON_YEAR, cal.SQL_DAYS
SEASON_DAYS = "CASE season WHEN 'DJF' THEN 90 WHEN 'SON' THEN 91 ELSE 92 END"
#: Areas of a time step in SQL.
AREAS = ", ".join(f"coalesce(sum(CASE WHEN {ok} THEN {x} END), 0) / 1e12 AS {n}" for n, ok, x in (("area", "sic > 15", "sic / 100 * cell_area"), ("extent", "sic > 15", "cell_area"), ("marginal", "sic > 15 AND sic < 90", "cell_area"), ("pack", "sic >= 90", "cell_area")))
#: Monthly series of areas by dataset and sector, and the seven periods of its extent.
SERIES = f"series AS (SELECT dataset, sector, time, yr, mo, {AREAS} FROM fieldg JOIN sectors USING (region) GROUP BY ALL)"


def sql_periods(series: str, value: str, keys: str) -> str:
    return f"""SELECT {keys}, 'annual' AS period, yr AS year, avg({value}) AS value FROM {series} GROUP BY {keys}, yr HAVING count(DISTINCT CASE WHEN {value} IS NOT NULL THEN mo END) = 12
    UNION ALL SELECT {keys}, season, season_year, sum({value} * w) / sum(w) FROM (SELECT *, {SEASON} AS season, {SEASON_YEAR} AS season_year, {DAYS} AS w FROM {series} WHERE {value} IS NOT NULL) GROUP BY {keys}, season, season_year HAVING count(*) >= 2
    UNION ALL SELECT {keys}, CASE WHEN mo = 3 THEN 'March' ELSE 'September' END, yr, {value} FROM {series} WHERE mo IN (3, 9) AND {value} IS NOT NULL"""


def series(v):
    return c.area_series(v.field_grid.join(v.sectors, "region"), ["dataset", "sector", "time", "yr", "mo"])


def out(df, *keys, value="value"):
    return df.select(*keys, r(F.col(value)).alias("value"))


query("T1_monthly_mean", f"SELECT dataset, y, x, CAST(date_trunc('month', time) AS DATE) AS time, {q('avg(sic)')} AS value FROM daily GROUP BY ALL")(lambda v: out(c.monthly_mean(v.daily, "sic"), *CELL, "time"))
query("T2_daily_mean", f"SELECT event_type, CAST(ts AS DATE) AS time, {q('avg(value)')} AS value FROM events GROUP BY ALL")(lambda v: out(c.daily_mean(v.table("events"), "ts", "value", ["event_type"]), "event_type", "time"))
query("T3_climatology_map", f"SELECT dataset, y, x, mo, {q('avg(sic)')} AS value FROM field GROUP BY ALL")(lambda v: out(c.climatology(v.field, "sic"), *CELL, "mo"))
query("T4_climatology_series", f"WITH {SERIES} SELECT dataset, sector, mo, {q('avg(extent)')} AS value FROM series GROUP BY ALL")(lambda v: out(c.climatology(series(v), "extent", ["dataset", "sector"]), "dataset", "sector", "mo"))
query("T5_anomaly_map", f"SELECT dataset, y, x, time, {q('thick - avg(thick) OVER (PARTITION BY dataset, y, x, mo)')} AS value FROM field")(lambda v: out(c.anomaly(v.field, "thick"), *CELL, "time", value="anomaly"))
query("T5_anomaly_series", f"WITH {SERIES} SELECT dataset, sector, time, {q('extent - avg(extent) OVER (PARTITION BY dataset, sector, mo)')} AS value FROM series")(lambda v: out(c.anomaly(series(v), "extent", ["dataset", "sector"]), "dataset", "sector", "time", value="anomaly"))
query("T6_all_months", f"WITH c AS (SELECT dataset, mo, avg(sic) AS value FROM field WHERE mo <> 7 GROUP BY ALL) SELECT dataset, CAST(m AS INT) AS mo, {q('value')} AS value FROM (SELECT DISTINCT dataset FROM c) CROSS JOIN range(1, 13) k(m) LEFT JOIN c ON c.dataset = dataset AND c.mo = m".replace("c.dataset = dataset", "c.dataset = d.dataset").replace("SELECT dataset, CAST(m", "SELECT d.dataset, CAST(m").replace("FROM c) CROSS", "FROM c) d CROSS"))(
    lambda v: out(c.all_months(c.climatology(v.field.where("mo <> 7"), "sic", ["dataset"]), ["dataset"]), "dataset", "mo")
)
query("T7_yearly_mean", f"SELECT dataset, y, x, yr, {q('avg(sic)')} AS value FROM field GROUP BY ALL HAVING count(DISTINCT mo) = 12")(lambda v: out(c.yearly_mean(v.field, "sic", CELL), *CELL, "yr"))
query("T8_season_year_mean", f"SELECT dataset, y, x, {SEASON} AS season, {SEASON_YEAR} AS season_year, {q(f'sum(sic * {DAYS}) / sum({DAYS})')} AS value FROM field GROUP BY ALL HAVING count(*) >= 2")(lambda v: out(c.season_mean(v.field, "sic", CELL), *CELL, "season", "season_year"))
query("T9_season_map", f"WITH m AS (SELECT dataset, y, x, mo, avg(thick) AS value FROM field GROUP BY ALL), s AS (SELECT dataset, y, x, {SEASON} AS season, sum(value * {DAYS}) AS s FROM m GROUP BY ALL) SELECT dataset, y, x, season, {q(f's / ({SEASON_DAYS})')} AS value FROM s")(
    lambda v: out(c.season_map(c.climatology(v.field, "thick")), *CELL, "season")
)
query("T10_season_anomaly", f"WITH a AS (SELECT *, sic - avg(sic) OVER (PARTITION BY dataset, y, x, mo) AS an FROM field) SELECT dataset, y, x, {SEASON} AS season, {SEASON_YEAR} AS season_year, {q('avg(an)')} AS value FROM a GROUP BY ALL HAVING count(*) >= 2")(
    lambda v: out(c.season_mean(c.anomaly(v.field, "sic"), "anomaly", CELL, weighted=False), *CELL, "season", "season_year")
)
query("T11_periods", f"WITH {SERIES}, p AS ({sql_periods('series', 'extent', 'dataset, sector')}) SELECT dataset, sector, period, year, {q('value')} AS value FROM p")(lambda v: out(c.periods(series(v), "extent", ["dataset", "sector"]), "dataset", "sector", "period", "year"))
query("T12_season_totals", f"WITH s AS (SELECT dataset, y, x, {SEASON} AS season, {SEASON_YEAR} AS sy, sum(u) AS v FROM daily GROUP BY ALL) SELECT dataset, y, x, season, {q('avg(v)')} AS value FROM s GROUP BY ALL")(lambda v: out(c.season_totals(v.daily, "u"), *CELL, "season"))
query("T13_month_totals", f"WITH s AS (SELECT dataset, y, x, yr, mo, sum(u) AS v FROM daily GROUP BY ALL) SELECT dataset, y, x, mo, {q('avg(v)')} AS value FROM s GROUP BY ALL")(lambda v: out(c.month_totals(v.daily, "u"), *CELL, "mo"))
query("T14_valid_day_totals", f"WITH s AS (SELECT dataset, y, x, {SEASON} AS season, {SEASON_YEAR} AS sy, sum(nullif(u, 0)) AS v, count(nullif(u, 0)) AS n FROM daily GROUP BY ALL HAVING n > 0) SELECT dataset, y, x, season, {q(f'avg(v / n * ({SEASON_DAYS}))')} AS value FROM s GROUP BY ALL")(
    lambda v: out(c.normalised_totals(v.daily.withColumn("u", F.nullif("u", F.lit(0.0))), "u"), *CELL, "season")
)
query("T15_season_mean_of_means", f"WITH s AS (SELECT dataset, y, x, {SEASON} AS season, {SEASON_YEAR} AS sy, avg(sic) AS v FROM daily GROUP BY ALL) SELECT dataset, y, x, season, {q('avg(v)')} AS value FROM s GROUP BY ALL")(lambda v: out(c.season_mean_of_means(v.daily, "sic"), *CELL, "season"))
query("T16_masked_season", f"SELECT dataset, y, x, {SEASON} AS season, {q('avg(CASE WHEN sic > 15 THEN sic END)')} AS value FROM field GROUP BY ALL")(lambda v: out(c.masked_season(v.field, "sic", 15), *CELL, "season"))
query("T17_plain_season", f"WITH m AS (SELECT dataset, y, x, mo, avg(sic) AS value FROM field GROUP BY ALL) SELECT dataset, y, x, {SEASON} AS season, {q('CASE WHEN count(value) = 3 THEN avg(value) END')} AS value FROM m GROUP BY ALL")(lambda v: out(c.plain_season(c.climatology(v.field, "sic")), *CELL, "season"))
FLUX = "fc AS (SELECT dataset, term, y, x, mo, avg(value * day(last_day(time)) * 86400) AS value FROM flux GROUP BY ALL)"
TERM = ["dataset", "term"]
query("T18_flux_climatology", f"WITH {FLUX} SELECT dataset, term, y, x, mo, {q('value')} AS value FROM fc")(lambda v: out(c.flux_climatology(v.flux, [*TERM, "y", "x"]), *TERM, "y", "x", "mo"))
query("T19_season_sum", f"WITH {FLUX} SELECT dataset, term, y, x, {SEASON} AS season, {q('sum(value)')} AS value FROM fc GROUP BY ALL")(lambda v: out(c.season_sum(c.flux_climatology(v.flux, [*TERM, "y", "x"]), [*TERM, "y", "x"]), *TERM, "y", "x", "season"))
query("T20_closed_cycle", f"WITH {FLUX}, m AS (SELECT dataset, term, mo, avg(value) AS value FROM fc GROUP BY ALL) SELECT dataset, term, mo, {q('value')} AS value FROM m UNION ALL SELECT dataset, term, 13, {q('value')} FROM m WHERE mo = 1")(
    lambda v: out(c.closed_cycle(c.flux_climatology(v.flux, [*TERM, "y", "x"]), TERM), *TERM, "mo")
)
query("T21_period_value", f"WITH {SERIES}, m AS (SELECT dataset, sector, mo, avg(extent) AS value FROM series GROUP BY ALL) SELECT dataset, sector, {q(f'sum(value * {DAYS}) / sum({DAYS})')} AS value FROM m GROUP BY ALL")(
    lambda v: out(c.period_value(c.climatology(series(v), "extent", ["dataset", "sector"]), ["dataset", "sector"]), "dataset", "sector")
)
query("T22_annual_domain_mean", f"WITH m AS (SELECT dataset, mo, avg(thick) AS value FROM field GROUP BY ALL) SELECT dataset, {q(f'sum(value * {DAYS}) / sum({DAYS})')} AS value FROM m GROUP BY ALL")(
    lambda v: out(c.period_value(c.climatology(v.field, "thick", ["dataset"]), ["dataset"]), "dataset")
)
