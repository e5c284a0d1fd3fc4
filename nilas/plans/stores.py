"""S4, S7 and S12: raw cubes, merged segments and the store that all modules write to."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from nilas.functions.stats import rounded as r
from nilas.functions.stats import sql_round as q
from nilas.plans.climatology import SERIES, series
from nilas.plans.registry import query
from nilas.plans.trends import SQL_V6, period_table
from nilas.sources import store
from nilas.sources.files import shared_folder


def scratch(v, label: str) -> str:
    """A new path in the shared folder of the cluster."""
    return f"{shared_folder(v.spark)}/{label}-{uuid.uuid4().hex}"


def raw_cubes(v):
    """Thickness of the first observation, written as yearly cubes and read back; cells without a value are null."""
    path = scratch(v, "cubes")
    own = v.field.where("dataset = 'obs1'").select(F.col("yr").alias("year"), F.col("mo").alias("month"), "y", "x", F.col("thick").alias("value"))
    ends = v.field.agg(F.max("y").alias("y"), F.max("x").alias("x")).first()
    ny, nx = (ends["y"] or 0) + 1, (ends["x"] or 0) + 1
    store.write_raw_cubes(own, path, ny, nx)
    return store.read_cube_slabs(v.spark, path, ny, nx).select("year", "month", "y", "x", r(F.col("value")).alias("value"))


query(
    "S4_raw_cubes",
    f"""WITH yrs AS (SELECT DISTINCT yr FROM field WHERE dataset = 'obs1'), ax AS (SELECT max(y) AS ny, max(x) AS nx FROM field),
    cube AS (SELECT yr, mo, y, x FROM yrs CROSS JOIN (SELECT unnest(range(1, 13)) AS mo) CROSS JOIN (SELECT unnest(range(ny + 1)) AS y FROM ax) CROSS JOIN (SELECT unnest(range(nx + 1)) AS x FROM ax))
    SELECT CAST(c.yr AS INT) AS year, CAST(c.mo AS INT) AS month, CAST(c.y AS INT) AS y, CAST(c.x AS INT) AS x, {q("f.thick")} AS value
    FROM cube c LEFT JOIN (SELECT * FROM field WHERE dataset = 'obs1') f ON f.yr = c.yr AND f.mo = c.mo AND f.y = c.y AND f.x = c.x""",
)(raw_cubes)


def overlapping(v):
    """Three segments that overlap: up to the middle year with that year, from the middle year on with half the concentration, and every third year again."""
    ends = v.field.agg(F.floor((F.min("yr") + F.max("yr")) / 2).alias("_mid"))
    f = v.field.crossJoin(ends)  # one row
    part = lambda name, where, sic: f.where(where).select("dataset", "time", "y", "x", F.lit(name).alias("segment"), F.expr(sic).alias("sic"))
    return part("seg_1", "yr <= _mid", "sic").unionByName(part("seg_2", "yr >= _mid", "sic / 2")).unionByName(part("seg_3", "yr % 3 = 0", "sic + 1"))


OVERLAPPING = """f AS (SELECT *, (SELECT floor((min(yr) + max(yr)) / 2) FROM field) AS mid FROM field),
    sg AS (SELECT dataset, time, y, x, 'seg_1' AS segment, sic FROM f WHERE yr <= mid UNION ALL SELECT dataset, time, y, x, 'seg_2', sic / 2 FROM f WHERE yr >= mid UNION ALL SELECT dataset, time, y, x, 'seg_3', sic + 1 FROM f WHERE yr % 3 = 0)"""
for _name, _prefer, _order in (("S7_merge_overlapping_first", "first", ""), ("S7_merge_overlapping_last", "last", " DESC")):
    query(
        _name,
        f"WITH {OVERLAPPING}, n AS (SELECT *, row_number() OVER (PARTITION BY dataset, time, y, x ORDER BY segment{_order}) AS n FROM sg) SELECT dataset, time, y, x, {q('sic')} AS sic FROM n WHERE n = 1",
    )(lambda v, prefer=_prefer: store.merge_segments(overlapping(v), ["dataset", "y", "x"], prefer=prefer).select("dataset", "time", "y", "x", r(F.col("sic")).alias("sic")))


def metric_series(v, name: str):
    return series(v).select("dataset", "sector", "time", F.lit(name).alias("metric"), r(F.col(name)).alias("value"))


def published(v) -> str:
    """A store that three modules have written, two of them more than once."""
    path = scratch(v, "store")
    store.publish(metric_series(v, "area"), path, "area")
    wrong = metric_series(v, "extent").withColumn("value", F.lit(-1.0))
    gone = wrong.where("dataset = 'model_b'").withColumn("dataset", F.lit("model_old"))
    store.publish(wrong.unionByName(gone), path, "extent")
    store.publish(metric_series(v, "extent").where("dataset <> 'obs1'"), path, "extent")  # one dataset still has its old records
    store.publish(metric_series(v, "extent"), path, "extent", whole=True)  # and the one that is no more goes
    store.publish(period_table(v), path, "periods")  # other columns
    return path


query(
    "S12_merged_store",
    f"WITH {SERIES} SELECT 'area' AS metric, dataset, sector, time, {q('area')} AS value FROM series UNION ALL SELECT 'extent', dataset, sector, time, {q('extent')} FROM series",
)(lambda v: store.read_store(v.spark, published(v), "module", "metric", "dataset", "sector", "time", "value").where("module <> 'periods'").drop("module"))
V6CTE = SQL_V6.strip()
query(
    "S12_store_index",
    f"""WITH {SERIES}, pt AS ({V6CTE}), k AS (SELECT count(DISTINCT dataset) AS datasets, count(*) AS records FROM series)
    SELECT 'south' AS hemisphere, 'area' AS module, datasets, records, 'metric,sector,time,value' AS filled FROM k UNION ALL SELECT 'south', 'extent', datasets, records, 'metric,sector,time,value' FROM k
    UNION ALL SELECT 'south', 'periods', count(DISTINCT dataset), count(*), 'detrended_std,mean,metric,p,period,sector,significant,trend' FROM pt""",
)(lambda v: store.store_index(store.read_store(v.spark, published(v))))
