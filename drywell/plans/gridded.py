"""Registered queries over cubes and predicted grids, with their oracles.

Stand-ins: the 25 nations are a coarse grid of five by five cells, a supplier's line items its monthly
values of two variables, and `part` the fine grid.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendars
from ..functions.store import fresh
from ..operators import gridded
from ..sources import assembly, raster
from .catalog import query, rounded, table

MONTHS = 83


def coarse_cells(spark, d) -> DataFrame:
    """(variable, row, col, t, value) of two variables, months from 1995-01, some missing."""
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    t = (calendars.month_index(F.year("l_shipdate"), F.month("l_shipdate")) - 1995 * 12).cast("int")
    values = li.groupBy(F.col("s_nationkey").alias("k"), t.alias("t")).agg(F.sum("l_quantity").alias("prec"), (F.avg("l_extendedprice") * 0.0123457).alias("temp"))
    all_ = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(MONTHS - 1))).alias("t"))
    both = all_.join(values, ["k", "t"], "left").select("k", "t", F.explode(F.array(*(F.struct(F.lit(n).alias("variable"), F.col(n).cast("double").alias("value")) for n in ("prec", "temp")))).alias("x"))
    return both.select("x.variable", F.floor(F.col("k") / 5).cast("int").alias("row"), (F.col("k") % 5).cast("int").alias("col"), "t", "x.value")


COARSE = f"""li AS (SELECT s_nationkey AS k, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t, CAST(sum(l_quantity) AS DOUBLE) AS prec, avg(l_extendedprice) * CAST(0.0123457 AS DOUBLE) AS temp
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    g AS (SELECT variable, n_nationkey // 5 AS "row", n_nationkey % 5 AS col, CAST(r.t AS INTEGER) AS t, CASE variable WHEN 'prec' THEN prec ELSE temp END AS value
        FROM nation CROSS JOIN range(0, {MONTHS}) r(t) CROSS JOIN (VALUES ('prec'), ('temp')) v(variable) LEFT JOIN li ON li.k = n_nationkey AND li.t = r.t)"""

# --- predicted grids -------------------------------------------------------------------------------

#: A model of fixed coefficients, by feature.
COEFFICIENTS = {
    "dyn_prec": 0.01, "dyn_prec_lag1": 0.02, "dyn_prec_roll2_mean": -0.005, "dyn_prec_roll2_sum": 0.003, "clim_dyn_prec": -0.004, "anom_dyn_prec": 0.05,
    "dyn_temp": 0.002, "anom_dyn_temp": -0.01, "clim_dyn_temp_roll2_mean": 0.001, "anom_dyn_temp_roll2_mean": 0.02,
    "static": 1.5, "lon": -0.3, "lat": 0.2, "month_sin": 2.0, "year": 0.001,
}
WANTED = {40: (1998, 5), 41: (1998, 6)}


def fixed_model(given: dict[str, np.ndarray]) -> np.ndarray:
    return sum(w * np.nan_to_num(given[n]) for n, w in COEFFICIENTS.items())


_ROLL = "CASE WHEN count(value) OVER f = 2 THEN {}(value) OVER f END"
_FEATURES = [f"{a}{b}" for b in ("", "_roll2_mean", "_roll2_sum") for a in ("", "clim_", "anom_")]


@query(f"""WITH {COARSE},
    h AS (SELECT *, lag(value, 1) OVER w AS lag1, {_ROLL.format("avg")} AS roll2_mean, {_ROLL.format("sum")} AS roll2_sum FROM g
        WINDOW w AS (PARTITION BY variable, "row", col ORDER BY t), f AS (PARTITION BY variable, "row", col ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
    c AS (SELECT *, {", ".join(f"avg({x}) OVER m AS clim_{x}" for x in ("value", "roll2_mean", "roll2_sum"))} FROM h WINDOW m AS (PARTITION BY variable, "row", col, t % 12)),
    layers AS (SELECT t, "row" AS y, col AS x, f.name AS feature, f.v AS value FROM (SELECT *, unnest([
        {{'name': 'dyn_' || variable, 'v': value}}, {{'name': 'dyn_' || variable || '_lag1', 'v': lag1}}, {{'name': 'dyn_' || variable || '_roll2_mean', 'v': roll2_mean}}, {{'name': 'dyn_' || variable || '_roll2_sum', 'v': roll2_sum}},
        {{'name': 'clim_dyn_' || variable, 'v': clim_value}}, {{'name': 'anom_dyn_' || variable, 'v': value - clim_value}},
        {{'name': 'clim_dyn_' || variable || '_roll2_mean', 'v': clim_roll2_mean}}, {{'name': 'anom_dyn_' || variable || '_roll2_mean', 'v': roll2_mean - clim_roll2_mean}}]) AS f FROM c WHERE t IN (40, 41))),
    filled AS (SELECT a.t, a.y, a.x, a.feature, a.value, coalesce(a.value, arg_min(b.value, (pow(a.y - b.y, 2) + pow(a.x - b.x, 2), b.y, b.x)) FILTER (WHERE b.value IS NOT NULL)) AS near
        FROM layers a JOIN layers b ON a.t = b.t AND a.feature = b.feature GROUP BY a.t, a.y, a.x, a.feature, a.value),
    land AS (SELECT CAST(p_partkey // 50 AS INTEGER) AS "row", CAST(p_partkey % 50 AS INTEGER) AS col, p_retailprice / 1000 AS static,
        CAST(0.04 AS DOUBLE) + (p_partkey % 50 + CAST(0.5 AS DOUBLE)) * CAST(0.09 AS DOUBLE) AS lon, CAST(4.1 AS DOUBLE) - (p_partkey // 50 + CAST(0.5 AS DOUBLE)) * CAST(0.1 AS DOUBLE) AS lat FROM part WHERE p_size % 7 > 0 AND p_partkey < 2000),
    plan AS (SELECT *, least(greatest(floor(lon), 0), 3) AS x0, least(greatest(floor(4 - lat), 0), 3) AS y0, least(greatest(round_even(lon, 0), 0), 4) AS xn, least(greatest(round_even(4 - lat, 0), 0), 4) AS yn FROM land),
    corners AS (SELECT plan."row", plan.col, xn, yn, x0 + i AS x, y0 + j AS y, (CASE WHEN i = 1 THEN least(greatest(lon - x0, 0), 1) ELSE 1 - least(greatest(lon - x0, 0), 1) END) * (CASE WHEN j = 1 THEN least(greatest(4 - lat - y0, 0), 1) ELSE 1 - least(greatest(4 - lat - y0, 0), 1) END) AS w
        FROM plan, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
    met AS (SELECT k."row", k.col, xn, yn, t, feature, sum(w * value) / sum(w) FILTER (WHERE value IS NOT NULL) AS value FROM corners k JOIN filled USING (x, y) WHERE w > 0 GROUP BY ALL),
    full_ AS (SELECT met."row", met.col, met.t, met.feature, coalesce(met.value, near) AS value FROM met JOIN filled ON filled.x = xn AND filled.y = yn AND filled.t = met.t AND filled.feature = met.feature),
    weights AS (SELECT unnest(map_keys(m)) AS feature, unnest(map_values(m)) AS weight FROM (SELECT MAP {{{", ".join(f"'{n}': CAST({w} AS DOUBLE)" for n, w in COEFFICIENTS.items())}}} AS m)),
    sums AS (SELECT "row", col, t, sum(weight * coalesce(value, 0)) AS s FROM full_ JOIN weights USING (feature) GROUP BY ALL)
    SELECT printf('spei_02mo_1998-%02d.tif', sums.t - 35) AS name, sums."row", sums.col,
        CAST(CAST(s + 1.5 * static - 0.3 * lon + 0.2 * lat + 2.0 * sin(2 * pi() * (sums.t - 35) / 12) + 0.001 * 1998 AS FLOAT) AS DOUBLE) AS value FROM sums JOIN land USING ("row", col)""")
def reconstructed_grids(spark, d):
    """Two months predicted tile by tile over the fine grid, assembled as rasters, and read back."""
    folder, p = fresh(spark, "reconstructed"), table(spark, d, "part").where("p_size % 7 > 0 AND p_partkey < 2000")
    land = p.select(F.expr("cast(p_partkey div 50 as int)").alias("row"), (F.col("p_partkey") % 50).cast("int").alias("col"), (F.col("p_retailprice") / 1000).alias("static"))
    frame = assembly.Frame(40, 50, (0.09, 0.0, 0.04, 0.0, -0.1, 4.1), tile=16, compression="lzw", predictor=3)
    layers = gridded.feature_layers(coarse_cells(spark, d), 2, list(WANTED))
    gridded.reconstruct(layers, land, fixed_model, list(COEFFICIENTS), folder, frame, [0.0, 1, 2, 3, 4], [4.0, 3, 2, 1, 0], 2, WANTED, months_a_task=1)
    return raster.pixels(spark, folder).where("value IS NOT NULL").select(F.element_at(F.split("path", "/"), -1).alias("name"), "row", "col", "value")


# --- stations from cubes ---------------------------------------------------------------------------


def write_cube(cells: DataFrame, path: str, name: str, lons: list[float], lats: list[float], units: str, times: list[float], calendar: str = "standard") -> None:
    """A classic NetCDF file of one variable from (row, col, t, value), written by one task: for small stand-ins."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        values = np.full((len(times), len(lats), len(lons)), -999.0, ">f8")
        known = own[own["value"].notna()]
        values[known["t"], known["row"], known["col"]] = known["value"]
        text = lambda s: struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
        word = lambda k, v: text(k) + struct.pack(">I", 2) + text(v)
        dims = b"".join(text(n) + struct.pack(">I", len(x)) for n, x in (("time", times), ("lat", lats), ("lon", lons)))
        parts = [np.array(x, ">f8").tobytes() for x in (times, lats, lons)] + [values.tobytes()]
        none = struct.pack(">II", 0, 0)

        def head(at: list[int]) -> bytes:
            out = b"CDF\1" + struct.pack(">I", 0) + struct.pack(">II", 10, 3) + dims + none + struct.pack(">II", 11, 4)
            for k, (n, attrs) in enumerate((("time", struct.pack(">II", 12, 2) + word("units", units) + word("calendar", calendar)), ("lat", none), ("lon", none))):
                out += text(n) + struct.pack(">II", 1, k) + attrs + struct.pack(">III", 6, len(parts[k]), at[k])
            fill = struct.pack(">II", 12, 1) + text("_FillValue") + struct.pack(">IId", 6, 1, -999.0)
            return out + text(name) + struct.pack(">IIII", 3, 0, 1, 2) + fill + struct.pack(">III", 6, len(parts[3]), at[3])

        start = len(head([0] * 4))
        fs, file = pafs.FileSystem.from_uri(path)
        fs.create_dir(file.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(file) as out:
            out.write(head([start + sum(map(len, parts[:k])) for k in range(4)]) + b"".join(parts))
        return pd.DataFrame({"n": [len(own)]})

    cells.groupBy("variable").applyInPandas(run, "n long").write.format("noop").mode("overwrite").save()


LATS, LONS = [40.0, 37.0, 35.5, 35.0, 31.0], [100.0, 101.0, 102.5, 106.0, 107.0]
#: Piecewise linear position on an uneven axis, as SQL.
_place = lambda axis, x: "CASE " + " ".join(f"WHEN {x} {'<' if axis[0] < axis[-1] else '>'} {b} THEN {k} + ({x} - {a}) / ({b} - {a})" for k, (a, b) in enumerate(zip(axis, axis[1:]))) + f" ELSE {len(axis) - 2} + ({x} - {axis[-2]}) / ({axis[-1]} - {axis[-2]}) END"


@query(f"""WITH {COARSE},
    s AS (SELECT CAST(s_suppkey AS VARCHAR) AS station_id, 99 + s_suppkey * 37 % 100 * CAST(0.09 AS DOUBLE) AS lon, 30 + s_suppkey * 53 % 100 * CAST(0.11 AS DOUBLE) AS lat FROM supplier WHERE s_suppkey % 11 > 0),
    pos AS (SELECT station_id, {_place(LONS, "lon")} AS px, {_place(LATS, "lat")} AS py FROM s),
    plan AS (SELECT *, least(greatest(floor(px), 0), 3) AS x0, least(greatest(floor(py), 0), 3) AS y0, least(greatest(round_even(px, 0), 0), 4) AS xn, least(greatest(round_even(py, 0), 0), 4) AS yn FROM pos),
    corners AS (SELECT station_id, xn, yn, x0 + i AS col, y0 + j AS "row", (CASE WHEN i = 1 THEN least(greatest(px - x0, 0), 1) ELSE 1 - least(greatest(px - x0, 0), 1) END) * (CASE WHEN j = 1 THEN least(greatest(py - y0, 0), 1) ELSE 1 - least(greatest(py - y0, 0), 1) END) AS w
        FROM plan, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
    met AS (SELECT station_id, xn, yn, variable, t, sum(w * value) / sum(w) FILTER (WHERE value IS NOT NULL) AS value FROM corners JOIN g USING ("row", col) WHERE w > 0 GROUP BY ALL),
    holes AS (SELECT DISTINCT variable, t, yn, xn FROM met WHERE value IS NULL),
    near AS (SELECT h.variable, h.t, h.yn, h.xn, arg_min(g.value, (pow(h.yn - g."row", 2) + pow(h.xn - g.col, 2), g."row", g.col)) AS filled FROM holes h JOIN g ON g.variable = h.variable AND g.t = h.t WHERE g.value IS NOT NULL GROUP BY ALL),
    v AS (SELECT station_id, met.variable, met.t, coalesce(met.value, filled) AS value, make_date(1995 + met.t // 12, met.t % 12 + 1, 1) AS m FROM met LEFT JOIN near ON near.variable = met.variable AND near.t = met.t AND near.yn = met.yn AND near.xn = met.xn)
    SELECT station_id, CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month, round(max(value * day(last_day(m)) * 24) FILTER (WHERE variable = 'prec'), 6) AS prec, round(max(value) FILTER (WHERE variable = 'temp'), 6) AS temp FROM v GROUP BY ALL""")
def cube_stations(spark, d):
    """Two cubes with uneven, descending axes and different time units, sampled at stations by coordinates."""
    folder, cells = fresh(spark, "cubes"), coarse_cells(spark, d)
    dates = [pd.Timestamp(1995 + t // 12, t % 12 + 1, 15) for t in range(MONTHS)]
    write_cube(cells.where("variable = 'prec'"), f"{folder}/prec_1.nc", "prec", LONS, LATS, "hours since 1900-01-01 06:00:00", [(x - pd.Timestamp(1900, 1, 1, 6)).total_seconds() / 3600 for x in dates])
    write_cube(cells.where("variable = 'temp'"), f"{folder}/temp_1.nc", "temp", LONS, LATS, "days since 1990-03-01", [float((x.year - 1990) * 365 + x.timetuple().tm_yday - (x.year % 4 == 0 and x.month > 2) - 60) for x in dates], "noleap")
    k = F.col("s_suppkey")
    stations = table(spark, d, "supplier").where(k % 11 > 0).select(k.cast("string").alias("station_id"), (99 + k * 37 % 100 * 0.09).alias("lon"), (30 + k * 53 % 100 * 0.11).alias("lat"))
    return rounded(gridded.sample_cube(spark, stations, [f"{folder}/{n}_1.nc" for n in ("prec", "temp")]))
