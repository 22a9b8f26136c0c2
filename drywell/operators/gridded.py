"""Cubes to station series, and monthly grids predicted tile by tile."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendars import monthly_total
from ..functions.clean import finite
from ..functions.geo import axis_position
from ..functions.store import settled
from ..sources import assembly, cube, raster
from ..sources.files import opened
from . import climatology, sampling
from .features import is_precipitation


def sample_cube(spark: SparkSession, stations: DataFrame, paths: list[str], totals: bool = True) -> DataFrame:
    """(station_id, year, month, a column for each cube's variable) at stations (station_id, lon, lat), bilinear by the cubes' own axes.

    Months come from each cube's time axis, positions from its coordinate values: descending and uneven
    axes too. Weights of missing corners go to the others; where all four are missing, the nearest
    valid cell of that month counts for the station's nearest cell. totals: rates of precipitation per
    hour become totals of the month. Cubes of other months are joined in full; stations without
    coordinates give no rows; variables of one name are an error.
    """
    places = stations.select("station_id", finite(F.col("lon")).alias("lon"), finite(F.col("lat")).alias("lat")).where("lon IS NOT NULL AND lat IS NOT NULL")
    names, long = [], None
    for path in paths:
        told = cube.describe(path)
        if told.name in names:
            raise ValueError(f"two cubes of {told.name}")
        names.append(told.name)
        points = places.select("station_id", axis_position(F.col("lon"), told.lons).alias("lon_pos"), axis_position(F.col("lat"), told.lats).alias("lat_pos"))
        corners = settled(sampling.corner_weights(points, len(told.lons), len(told.lats)))
        cells = cube.read_cube(spark, path).select("t", F.col("row").alias("lat_idx"), F.col("col").alias("lon_idx"), "value")
        nearest = corners.select(F.col("lat_nearest").alias("lat_idx"), F.col("lon_nearest").alias("lon_idx"), F.lit(True).alias("near")).distinct()
        marked = cells.join(nearest, ["lat_idx", "lon_idx"], "left")  # only the stations' own cells are ever filled
        filled = sampling.fill_nearest(marked, ("t",), want="near").select("t", "lat_idx", "lon_idx", "filled")
        months = spark.createDataFrame([(t, y, m) for t, (y, m, _) in enumerate(told.dates)], "t int, year int, month int")
        own = corners.select("station_id").distinct().join(F.broadcast(months))  # a row a step
        values = sampling.bilinear(corners, cells, "station_id", ("t",), filled)
        value = F.col("value")
        if totals:
            value = monthly_total(value, F.make_date("year", "month", F.lit(1)), told.name)
        own = own.join(values, ["station_id", "t"], "left").select("station_id", "year", "month", F.lit(told.name).alias("variable"), value.alias("value"))
        long = own if long is None else long.unionByName(own)
    if long is None:
        raise ValueError("no cubes")
    return long.groupBy("station_id", "year", "month").agg(*(F.max(F.when(F.col("variable") == n, F.col("value"))).alias(n) for n in names))


def feature_layers(cells: DataFrame, scale: int, months: list[int]) -> DataFrame:
    """(t, lat_idx, lon_idx, feature, value) of the months `months`, under the names that training tables have.

    cells: variable, row, col, t (months from 0, no gaps) and value. Windows, lags and climatologies
    run over all months; only the months asked for go on.
    """
    wide = climatology.grid_month_features(cells, scale)
    made = [c for c in wide.columns if "value" in c]
    named = lambda c: F.concat(F.lit(c[: c.index("value")] + "dyn_"), F.col("variable"), F.lit(c[c.index("value") + 5 :]))
    each = F.explode(F.array(*(F.struct(named(c).alias("feature"), F.col(c).alias("value")) for c in made)))
    long = wide.where(F.col("t").isin(months)).select("t", F.col("row").alias("lat_idx"), F.col("col").alias("lon_idx"), "variable", each.alias("x")).select("t", "lat_idx", "lon_idx", "variable", "x.*")
    sums = F.col("feature").endswith("_sum")
    return long.where(~sums | F.lower("variable").contains("prec") | (F.lower("variable") == "pr")).drop("variable")


def file_name(scale: int, year: int, month: int) -> str:
    return f"spei_{scale:02d}mo_{year}-{month:02d}.tif"


def open_months(folder: str, scale: int, months: dict[int, tuple[int, int]], existing: str) -> dict[int, tuple[int, int]]:
    """Months without a complete file. existing: 'refuse' raises at any file, 'skip' passes over complete ones and raises at others."""
    files, base = pafs.FileSystem.from_uri(folder)
    left = {}
    for t, (year, month) in months.items():
        path = f"{base}/{file_name(scale, year, month)}"
        if files.get_file_info(path).type == pafs.FileType.NotFound:
            left[t] = (year, month)
            continue
        if existing != "skip":
            raise FileExistsError(f"{path} is there already")
        try:
            with opened(f"{folder}/{file_name(scale, year, month)}") as f:
                whole = 'name="generation_complete">true<' in raster.Raster(f).tags.get(42112, "")
        except Exception:
            whole = False
        if not whole:
            raise RuntimeError(f"{path} isn't marked complete")
    return left


def sampled(window: np.ndarray, filled: np.ndarray, low: tuple[np.ndarray, np.ndarray], high: tuple[np.ndarray, np.ndarray], weight: tuple[np.ndarray, np.ndarray], near: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Bilinear values of one layer; weights of missing corners go to the others, without any the filled nearest cell counts."""
    (y0, x0), (y1, x1), (wy, wx) = low, high, weight
    total, used = np.zeros(len(y0)), np.zeros(len(y0))
    for y, x, w in ((y0, x0, (1 - wy) * (1 - wx)), (y0, x1, (1 - wy) * wx), (y1, x0, wy * (1 - wx)), (y1, x1, wy * wx)):
        v = window[y, x]
        has = np.isfinite(v) & (w > 0)
        total += np.where(has, v * w, 0.0)
        used += np.where(has, w, 0.0)
    return np.where(used > 0, total / np.where(used > 0, used, 1.0), filled[near])


def reconstruct(
    layers: DataFrame, land: DataFrame, predict: Callable[[dict[str, np.ndarray]], np.ndarray], names: list[str], folder: str, frame: assembly.Frame, lons: list[float], lats: list[float],
    scale: int, months: dict[int, tuple[int, int]], to_lonlat: Callable[[Column, Column], tuple[Column, Column]] | None = None, months_a_task: int = 12, existing: str = "refuse", tags: dict[str, str] | None = None,
) -> DataFrame:
    """Predicts a grid for each month and writes it as a raster under folder; the stored manifest (path, t, cells).

    layers: (t, lat_idx, lon_idx, feature, value) on the coarse grid of axes lons and lats (`feature_layers`).
    land: (row, col, static predictors...) of the cells to predict; all others are nodata, and tiles without
    land are never made. months: t to (year, month). predict gets arrays by feature name (month, year, lon, lat,
    month_sin, month_cos, static and sampled layers) and gives values, NaN for none; names are those that it
    needs, of which none may be missing. to_lonlat: place in the frame's projection to degrees; none: it is in degrees.

    A plan of (tile, run of months) tasks: a tile's land cells, stored with their positions on the coarse
    axes, meet the part of the coarse layers around them, once for `months_a_task` months; what comes out
    is encoded tiles, which `assembly` puts together. Missing coarse cells are filled from the nearest valid
    one of their month and layer. Of a cell that comes twice one counts; without land or months nothing is
    written.
    """
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    months = open_months(folder, scale, months, existing)
    a, _, x0, _, e, y0 = frame.transform
    x, y = F.lit(x0) + (F.col("col") + 0.5) * a, F.lit(y0) + (F.col("row") + 0.5) * e
    lon, lat = to_lonlat(x, y) if to_lonlat else (x, y)
    statics = [c for c in land.columns if c not in ("row", "col", "lon", "lat")]
    tile = (F.floor(F.col("row") / frame.tile) * frame.across + F.floor(F.col("col") / frame.tile)).cast("int")
    inside = F.col("row").between(0, frame.height - 1) & F.col("col").between(0, frame.width - 1)
    cells = land.where(inside).select(tile.alias("tile"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), lon.alias("lon"), lat.alias("lat"), *(finite(F.col(f"`{c}`").cast("double")).alias(c) for c in statics))
    cells = settled(cells.withColumn("lon_pos", axis_position(F.col("lon"), lons)).withColumn("lat_pos", axis_position(F.col("lat"), lats)))

    wanted = layers.where(F.col("t").isin(list(months)) & F.col("feature").isin(names))
    filled = settled(sampling.fill_nearest(wanted, ("t", "feature")))
    dynamic = sorted(r["feature"] for r in filled.select("feature").distinct().collect())  # of the names asked for
    missing = set(names) - {*dynamic, *statics, "year", "month", "month_sin", "month_cos", "lon", "lat"}
    if missing and months and len(dynamic):
        raise ValueError(f"missing features {sorted(missing)[:10]}")
    one = lambda c, n: F.max(F.when(F.col("feature") == n, F.col(c)))
    wide = filled.groupBy("t", "lat_idx", "lon_idx").agg(F.array(*(one("value", n) for n in dynamic)).cast("array<double>").alias("v"), F.array(*(one("filled", n) for n in dynamic)).cast("array<double>").alias("f"))
    # The coarse cells around each tile, one row of bounds a tile.
    low = lambda p, n: F.least(F.greatest(F.floor(p), F.lit(0)), F.lit(max(n - 2, 0))).cast("int")
    top = lambda p, n: F.least(low(p, n) + 1, F.lit(n - 1))
    py, px = F.col("lat_pos"), F.col("lon_pos")
    bounds = cells.groupBy("tile").agg(F.min(low(py, len(lats))).alias("y0"), F.max(top(py, len(lats))).alias("y1"), F.min(low(px, len(lons))).alias("x0"), F.max(top(px, len(lons))).alias("x1"))
    around = bounds.select("tile", F.explode(F.sequence("y0", "y1")).alias("lat_idx"), "x0", "x1").select("tile", "lat_idx", F.explode(F.sequence("x0", "x1")).alias("lon_idx"))
    order = sorted(months)
    part = F.array_position(F.array(*map(F.lit, order)), F.col("t")) - 1
    windows = around.join(wide, ["lat_idx", "lon_idx"]).select(F.col("tile").alias("of_tile"), F.floor(part / months_a_task).cast("int").alias("of_part"), "t", "lat_idx", "lon_idx", "v", "f")
    parts = [order[k : k + months_a_task] for k in range(0, len(order), months_a_task)]
    planned = cells.withColumn("part", F.explode(F.array(*map(F.lit, range(len(parts)))).cast("array<int>")))
    n_lat, n_lon = len(lats), len(lons)

    def run(key, own: pd.DataFrame, window: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"t": [], "tile": [], "data": [], "cells": []})
        pos = own["lat_pos"].to_numpy(float), own["lon_pos"].to_numpy(float)
        at = [np.clip(np.floor(p), 0, max(n - 2, 0)).astype(int) for p, n in zip(pos, (n_lat, n_lon))]
        next_ = [np.minimum(k + 1, n - 1) for k, n in zip(at, (n_lat, n_lon))]
        weight = tuple(np.clip(p - k, 0.0, 1.0) for p, k in zip(pos, at))
        near = [np.clip(np.rint(p), 0, n - 1).astype(int) for p, n in zip(pos, (n_lat, n_lon))]
        y, x = at[0].min(), at[1].min()
        shape = (next_[0].max() - y + 1, next_[1].max() - x + 1)
        shifted = lambda k: (k[0] - y, k[1] - x)
        fixed = {c: own[c].to_numpy(float) for c in ("lon", "lat", *statics)}
        out = []
        for t in parts[int(key[1])]:
            now = window[window["t"] == t]
            grid, fill = np.full((2, *shape, len(dynamic)), np.nan)
            if len(now):
                yy, xx = now["lat_idx"].to_numpy() - y, now["lon_idx"].to_numpy() - x
                grid[yy, xx], fill[yy, xx] = (np.array([[np.nan if q is None else q for q in r] for r in now[c]], float).reshape(len(now), len(dynamic)) for c in ("v", "f"))
            year, month = months[t]
            full = lambda v: np.full(len(own), float(v))
            given = {"year": full(year), "month": full(month), "month_sin": full(np.sin(2 * np.pi * month / 12)), "month_cos": full(np.cos(2 * np.pi * month / 12)), **fixed}
            given |= {n: sampled(grid[:, :, j], fill[:, :, j], shifted(at), shifted(next_), weight, shifted(near)) for j, n in enumerate(dynamic)}
            values = np.asarray(predict(given), np.float32)
            data = frame.block(own["row"].to_numpy() % frame.tile, own["col"].to_numpy() % frame.tile, values)
            out.append((t, int(key[0]), data, int(np.isfinite(values).sum())))
        return pd.DataFrame(out, columns=["t", "tile", "data", "cells"])

    tiles = planned.groupBy("tile", "part").cogroup(windows.groupBy("of_tile", "of_part")).applyInPandas(run, "t int, tile int, data binary, cells long")
    told = tags or {}
    month_tag = lambda t: {**told, "spei_timescale_months": str(scale), "year_month": f"{months[t][0]}-{months[t][1]:02d}"}
    return settled(assembly.assemble(tiles, ["t"], folder, lambda t: file_name(scale, *months[t]), frame, month_tag))


__all__ = ["feature_layers", "is_precipitation", "reconstruct", "sample_cube"]
