"""Values of regular grids at points: bilinear sampling, nearest valid cells, tiered searches, zonal statistics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import finite
from ..functions.geo import grid_plan
from ..functions.store import settled


def corner_weights(points: DataFrame, n_lon: int, n_lat: int, lon: str = "lon_pos", lat: str = "lat_pos") -> DataFrame:
    """points with the nearest cell and their four corners: a row per corner (lat_idx, lon_idx, w). Reusable for every layer of a grid."""
    x, y = grid_plan(F.col(lon), n_lon), grid_plan(F.col(lat), n_lat)
    rows = points.select("*", *(x[k].alias(f"_x{k}") for k in x), *(y[k].alias(f"_y{k}") for k in y))
    corner = lambda i, j: F.struct(
        F.least(F.col("_ylow") + i, F.lit(n_lat - 1)).alias("lat_idx"), F.least(F.col("_xlow") + j, F.lit(n_lon - 1)).alias("lon_idx"),
        ((F.col("_yweight") if i else 1 - F.col("_yweight")) * (F.col("_xweight") if j else 1 - F.col("_xweight"))).alias("w"),
    )
    rows = rows.select(*points.columns, F.col("_ynearest").alias("lat_nearest"), F.col("_xnearest").alias("lon_nearest"), F.explode(F.array(*(corner(i, j) for i in (0, 1) for j in (0, 1)))).alias("c"))
    return rows.select(*points.columns, "lat_nearest", "lon_nearest", "c.*")


def bilinear(corners: DataFrame, grid: DataFrame, id_col: str, layers: tuple[str, ...] = (), fallback: DataFrame | None = None) -> DataFrame:
    """(id, layers, value): weights of missing corners go to the others; without any, the fallback's nearest cell, else null.

    grid: lat_idx, lon_idx, layers, value. A corner without weight never makes a value. Corners meet
    the grid by an equi-join on the cell; each point sums four rows. fallback: lat_idx, lon_idx,
    layers, filled; one row per cell.
    """
    cells = grid.withColumn("value", finite(F.col("value")))
    near = [id_col, "lat_nearest", "lon_nearest"]
    met = corners.where("w > 0").join(cells, ["lat_idx", "lon_idx"])
    used = F.when(F.col("value").isNotNull(), F.col("w"))
    out = met.groupBy(*near, *layers).agg((F.sum(F.col("w") * F.col("value")) / F.sum(used)).alias("value"))
    if fallback is not None:
        fill = fallback.select(F.col("lat_idx").alias("lat_nearest"), F.col("lon_idx").alias("lon_nearest"), *layers, "filled")
        out = out.join(fill, ["lat_nearest", "lon_nearest", *layers], "left").withColumn("value", F.coalesce("value", "filled"))
    return out.select(id_col, *layers, "value")


def _dealt(df: DataFrame, axes: list[str], size: float, around: bool) -> DataFrame:
    """df with the cell `_c` of each row's place, or a row for each cell around it."""
    own = [F.floor(F.col(a) / size).cast("long") for a in axes]
    if not around:
        return df.withColumn("_c", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(own))))
    steps = reduce(lambda xs, _: [(*x, s) for x in xs for s in (-1, 0, 1)], axes, [()])
    return df.withColumn("_c", F.explode(F.array(*(F.struct(*((c + s).alias(f"k{i}") for i, (c, s) in enumerate(zip(own, x)))) for x in steps))))


def nearest(queries: DataFrame, targets: DataFrame, id_col: str, axes: list[str], size: float, take: list[str], ties: list[str], reach: float, same: tuple[str, ...] = ()) -> DataFrame:
    """(id, distance, take): the target nearest to each query by Euclidean distance, ties by `ties`; no row if none is within reach.

    Queries and targets meet only where they agree in `same`.

    Rings of cells instead of a cross join: with cells of one size, all targets within that size lie
    in the cells around; queries whose best is farther go on with cells of twice the size. Each round
    is an equi-join on the cell over the queries left.
    """
    found, left = None, queries.select(id_col, *axes, *same)
    targets = targets.select(*(F.col(a).alias(f"_t{i}") for i, a in enumerate(axes)), *dict.fromkeys([*take, *ties, *same]))
    t_axes = [f"_t{i}" for i in range(len(axes))]
    while True:
        d = F.sqrt(reduce(lambda a, b: a + b, ((F.col(a) - F.col(t)) ** 2 for a, t in zip(axes, t_axes))))
        met = _dealt(left, axes, size, True).join(_dealt(targets, t_axes, size, False), ["_c", *same]).withColumn("_d", d).where(F.col("_d") <= size)
        best = met.groupBy(id_col).agg(F.min(F.struct("_d", *ties, *take)).alias("_b")).select(id_col, F.col("_b._d").alias("distance"), *(F.col(f"_b.{c}").alias(c) for c in take))
        best = settled(best)
        found = best if found is None else found.unionByName(best)
        left = settled(left.join(best.select(id_col), id_col, "left_anti"))
        if size >= reach or left.isEmpty():
            return found
        size *= 2


def row_nearest(rows: pd.DataFrame, reach: float, row_of: np.ndarray | None = None) -> np.ndarray:
    """For each wanted place the number of the column in its grid row whose own nearest valid cell is the nearest of all, -1 if none is within reach.

    rows: lon_idx (ascending and distinct in a grid row), lat_idx, up and down (rows of the nearest
    valid cells of the column above and below, NaN if none), wanted; row_of: a number for each grid row,
    whose places come together (by default all are of one). Ties go to the smallest row, then column.
    Columns are looked at by their distance, for all places at once that a nearer one may still serve.
    """
    at, here = rows["lon_idx"].to_numpy(np.int64), rows["lat_idx"].to_numpy(float)
    row_of = np.zeros(len(at), np.int64) if row_of is None else row_of
    up, down = here - rows["up"].to_numpy(float), rows["down"].to_numpy(float) - here
    above = ~(up > down) & ~np.isnan(up) | np.isnan(down)  # of two as near, the smaller row
    high = np.where(np.isnan(up) & np.isnan(down), np.inf, np.where(above, up, down))
    row = np.where(above, rows["up"].to_numpy(float), rows["down"].to_numpy(float))
    want = np.flatnonzero(rows["wanted"].to_numpy(bool))
    best, found, found_row = np.full(len(want), reach * reach), np.full(len(want), -1), np.full(len(want), np.inf)
    open_ = np.arange(len(want))
    for k in range(len(at)):
        live = np.zeros(len(open_), bool)
        for other in {-k, k}:
            place = want[open_] + other
            inside = (place >= 0) & (place < len(at))
            place = np.clip(place, 0, len(at) - 1)
            inside &= row_of[place] == row_of[want[open_]]
            flat = (at[place] - at[want[open_]]).astype(float) ** 2
            live |= inside & (flat <= best[open_])
            d = np.where(inside, flat + high[place] ** 2, np.inf)
            better = (d < best[open_]) | ((d == best[open_]) & np.isfinite(d) & ((row[place] < found_row[open_]) | ((row[place] == found_row[open_]) & (at[place] < at[np.maximum(found[open_], 0)]))))
            own, place = open_[better], place[better]
            best[own], found[own], found_row[own] = d[better], place, row[place]
        open_ = open_[live]
        if not len(open_):
            break
    out = np.full(len(at), -1)
    out[want] = found
    return out


def fill_nearest(grid: DataFrame, layers: tuple[str, ...] = (), reach: float = 1 << 14, want: str | None = None) -> DataFrame:
    """grid with `filled`: the value, or that of the nearest valid cell of the layer in index space (ties: smallest row, then column).

    grid: lat_idx, lon_idx, layers, value, a row per cell at most. Two passes, whatever the holes: by
    column, windows find each cell's nearest valid cells above and below; by row, the nearest of
    those of all columns. Cells that the grid leaves out lend their place to the columns' nearest, but
    give no row. A layer without valid cells stays missing, and one without missing cells as it is.
    want: only missing cells for which this column is true are filled.
    """
    cells = grid.withColumn("value", finite(F.col("value"))).withColumn("_own", F.lit(True))
    wanted = F.col("value").isNull() & (F.coalesce(F.col(want), F.lit(False)) if want else F.lit(True))
    cells = cells.withColumn("_wanted", wanted)
    # Rows with holes get a place in every column of their layer's extent.
    extent = cells.groupBy(*layers).agg(F.min("lon_idx").alias("_from"), F.max("lon_idx").alias("_to"))
    holes = cells.where("_wanted").select(*layers, "lat_idx").distinct()
    holes = holes.join(extent, list(layers)) if layers else holes.crossJoin(extent)  # without layers one row
    places = holes.select(*layers, "lat_idx", F.explode(F.sequence("_from", "_to")).alias("lon_idx"))
    cells = cells.unionByName(places.join(cells.select(*layers, "lat_idx", "lon_idx"), [*layers, "lat_idx", "lon_idx"], "left_anti"), allowMissingColumns=True)
    # Both windows run from the start of their order: one that looked ahead to the end would go over the rest of the column for each row.
    column = W.partitionBy(*layers, "lon_idx").rowsBetween(W.unboundedPreceding, 0)
    valid = F.when(F.col("value").isNotNull(), F.struct("lat_idx", "value"))
    cells = cells.withColumn("_up", F.last(valid, True).over(column.orderBy("lat_idx"))).withColumn("_down", F.last(valid, True).over(column.orderBy(F.desc("lat_idx"))))
    rows = cells.select(*layers, "lat_idx", "lon_idx", F.coalesce("_wanted", F.lit(False)).alias("wanted"), F.col("_up.lat_idx").cast("double").alias("up"), F.col("_down.lat_idx").cast("double").alias("down"), F.col("_up.value").alias("up_value"), F.col("_down.value").alias("down_value"))

    at_row = [*layers, "lat_idx"]

    def filled(own: pd.DataFrame, row_of: np.ndarray) -> pd.DataFrame:
        found = row_nearest(own, reach, row_of)
        at = np.flatnonzero(found >= 0)
        of = own.iloc[found[at]]
        up, down = of["lat_idx"] - of["up"], of["down"] - of["lat_idx"]
        out = own.loc[at, [*at_row, "lon_idx"]].copy()
        out["_near"] = np.where((~(up > down) & up.notna()) | down.isna(), of["up_value"], of["down_value"])
        return out

    def run(batches):
        """Whole rows of the grid, many at a time; the last one of a batch waits for its rest."""
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if held[0][at_row].iloc[:1].equals(batch[at_row].iloc[-1:].set_axis(held[0].index[:1])):
                continue  # still one row of the grid
            own = pd.concat(held, ignore_index=True)
            row_of = own.groupby(at_row, dropna=False, sort=False).ngroup().to_numpy()
            cut = int(np.searchsorted(row_of, row_of[-1]))
            yield filled(own.iloc[:cut], row_of[:cut])
            held = [own.iloc[cut:].reset_index(drop=True)]
        if held:
            own = pd.concat(held, ignore_index=True)
            yield filled(own, own.groupby(at_row, dropna=False, sort=False).ngroup().to_numpy())

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*at_row, "lon_idx")) + ", _near double"
    near = rows.repartition(*at_row).sortWithinPartitions(*at_row, "lon_idx").mapInPandas(run, schema)
    whole = [*layers, "lat_idx", "lon_idx"]
    out = grid.withColumn("value", finite(F.col("value"))).join(near, whole, "left")
    return out.withColumn("filled", F.coalesce("value", "_near")).select(*grid.columns, "filled")


TIERS = (0, 2, 5, 10, 25, 50, 100, 200)


def nearest_tiered(points: DataFrame, grid: DataFrame, id_col: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """(id, value, distance): the nearest valid cell in the first square around a point's cell that has one.

    points: id, row, col. grid: lat_idx, lon_idx, value. Squares grow by tier, so a corner of a square can
    beat a nearer cell outside it; ties go to the smallest row, then column. Points that no tier
    serves have nulls. Each tier is an equi-join on tiles of its size, over the points left.
    """
    valid = grid.withColumn("value", finite(F.col("value"))).where("value IS NOT NULL").select("lat_idx", "lon_idx", "value")
    found, left = None, points.select(id_col, "row", "col")
    for r in tiers:
        size = max(1, r)
        near = _dealt(left, ["row", "col"], size, r > 0).join(_dealt(valid, ["lat_idx", "lon_idx"], size, False), "_c")
        near = near.where((F.abs(F.col("row") - F.col("lat_idx")) <= r) & (F.abs(F.col("col") - F.col("lon_idx")) <= r))
        d2 = (F.col("row") - F.col("lat_idx")) ** 2 + (F.col("col") - F.col("lon_idx")) ** 2
        best = near.groupBy(id_col).agg(F.min(F.struct(d2.alias("d2"), "lat_idx", "lon_idx", "value")).alias("b")).select(id_col, F.col("b.value").alias("value"), F.sqrt("b.d2").alias("distance"))
        best = settled(best)
        found = best if found is None else found.unionByName(best)
        left = settled(left.join(best.select(id_col), id_col, "left_anti"))
        if left.isEmpty():
            break
    return points.select(id_col).join(found, id_col, "left")


def fallback_audit(found: DataFrame, id_col: str, feature: str) -> DataFrame:
    """(id, feature, fallback_distance_pixels, used_fallback, missing_after_fallback) of tiered searches."""
    return found.select(id_col, F.lit(feature).alias("feature"), F.col("distance").alias("fallback_distance_pixels"), F.coalesce(F.col("distance") > 0, F.lit(False)).alias("used_fallback"), F.col("value").isNull().alias("missing_after_fallback"))


def zonal_terrain(pixels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, relief and deviation of the source pixels in each target cell."""
    v = finite(F.col(value))
    out = pixels.groupBy(*keys).agg(F.avg(v).alias("dem_elev_m"), (F.max(v) - F.min(v)).alias("dem_relief_1km"), F.avg(v * v).alias("_sq"))
    return out.withColumn("dem_std_1km", F.sqrt(F.greatest(F.col("_sq") - F.col("dem_elev_m") ** 2, F.lit(0.0)))).drop("_sq")


def average_to_coarse(pixels: DataFrame, factor_row: int, factor_col: int, layers: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Means of the fine pixels (row, col) in each coarse cell."""
    return pixels.groupBy(*layers, F.floor(F.col("row") / factor_row).cast("int").alias("row"), F.floor(F.col("col") / factor_col).cast("int").alias("col")).agg(F.avg(finite(F.col(value))).alias("value"))
