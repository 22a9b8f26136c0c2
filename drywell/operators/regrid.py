"""From one grid to another: tiles mosaicked, cut and warped to statistics, area averages, bilinear values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import finite
from .regions import cell_centre, grid_cells, ring_edges
from .sampling import bilinear, corner_weights

Projection = Callable[[Column, Column], tuple[Column, Column]]


def mosaic(tiles: DataFrame, per_degree: int) -> DataFrame:
    """(lat, lon, y, x, value): pixels of elevation tiles on one lattice, each place once; y and x are lat and lon in whole steps of 1 / per_degree.

    Neighbouring tiles share the pixels of their edges: of these the valid one of the last tile by name
    counts. Only edge pixels are grouped; inner ones pass without a shuffle. tiles: tile, lat, lon, row,
    col, value, row and col from 0 to per_degree.
    """
    rows = tiles.select("tile", "row", "col", F.round(F.col("lat") * per_degree).cast("long").alias("y"), F.round(F.col("lon") * per_degree).cast("long").alias("x"), finite(F.col("value")).alias("value"))
    edge = F.col("row").isin(0, per_degree) | F.col("col").isin(0, per_degree)
    shared = rows.where(edge).groupBy("y", "x").agg(F.max(F.when(F.col("value").isNotNull(), F.struct("tile", "value")))["value"].alias("value"))
    both = rows.where(~edge).select("y", "x", "value").unionByName(shared)
    return both.select((F.col("y") / per_degree).alias("lat"), (F.col("x") / per_degree).alias("lon"), "y", "x", "value")


def scan_lines(shapes: DataFrame, per_degree: int) -> DataFrame:
    """(y, xs): where the lattice's lines of latitude cross the rings of shapes (region_id, rings), in order."""
    edges = ring_edges(shapes)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("y", F.explode(F.sequence(F.ceil(low * per_degree), F.floor(high * per_degree))))
    at = F.col("y") / per_degree
    # A line through the upper end of an edge belongs to the next edge only.
    rows = rows.where((at >= low) & (at < high)).withColumn("x", F.col("x1") + (at - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    return rows.groupBy("y").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # a line's crossings


def cut(pixels: DataFrame, shapes: DataFrame, per_degree: int) -> DataFrame:
    """Pixels (y, lon, ...) whose place lies inside the rings, by the even-odd rule over all of them: a join on the line, no pixel meets a polygon."""
    lines = scan_lines(shapes, per_degree)
    inside = F.size(F.filter("xs", lambda x: x <= F.col("lon"))) % 2 == 1
    return pixels.join(lines, "y").where(inside).drop("xs")


def warp(pixels: DataFrame, transform: tuple, height: int, width: int, project: Projection) -> DataFrame:
    """(row, col, mean, max, min, rms, n) of the source pixels (lat, lon, value) whose projected place lies in each target cell.

    transform: (a, b, c, d, e, f) of the target, b and d 0. Sums and extremes are combined before the
    shuffle, which is on the target cell; missing pixels count nowhere, cells without pixels give no row.
    """
    a, _, c, _, e, f = transform
    x, y = project(F.col("lon"), F.col("lat"))
    placed = pixels.select(F.floor((y - f) / e).alias("row"), F.floor((x - c) / a).alias("col"), F.col("value").cast("double").alias("value"))
    placed = placed.where(F.col("value").isNotNull() & F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    v = F.col("value")
    return placed.groupBy(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).agg(F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.sqrt(F.avg(v * v)).alias("rms"), F.count(v).alias("n"))


def terrain(tiles: DataFrame, per_degree: int, transform: tuple, height: int, width: int, project: Projection, shapes: DataFrame | None = None) -> DataFrame:
    """(row, col, dem_elev_m, dem_relief_1km, dem_std_1km) of elevation tiles on a projected grid, cut to shapes (region_id, rings in degrees)."""
    pixels = mosaic(tiles, per_degree)
    if shapes is not None:
        pixels = cut(pixels, shapes, per_degree)
    cells = warp(pixels, transform, height, width, project)
    spread = F.sqrt(F.greatest(F.col("rms") ** 2 - F.col("mean") ** 2, F.lit(0.0)))
    return cells.select("row", "col", F.col("mean").alias("dem_elev_m"), (F.col("max") - F.col("min")).alias("dem_relief_1km"), spread.alias("dem_std_1km"))


def _overlaps(index: str, origin: float, step: float, to_origin: float, to_step: float, n: int) -> Column:
    """[(target index, length of the overlap)] of a source cell on one axis, as an array."""
    a = (F.col(index) * step + origin - to_origin) / to_step
    b = ((F.col(index) + 1) * step + origin - to_origin) / to_step
    low, high = F.least(a, b), F.greatest(a, b)
    first, last = F.greatest(F.floor(low), F.lit(0)), F.least(F.ceil(high) - 1, F.lit(n - 1))
    each = F.transform(F.sequence(first, last), lambda k: F.struct(k.cast("int").alias("k"), (F.least(high, k + 1) - F.greatest(low, k)).alias("w")))
    return F.when(first <= last, each)


def area_average(pixels: DataFrame, source: tuple, target: tuple, height: int, width: int, layers: tuple[str, ...] = ()) -> DataFrame:
    """(layers, row, col, value, share): the mean of source pixels by the area that they share with each target cell, and the share of the cell that valid pixels cover.

    source and target: transforms (a, b, c, d, e, f) of the same projection, any ratio of their steps.
    A pixel goes to the few cells that it touches, with the product of its overlaps on both axes;
    missing pixels have no weight. No join: overlaps follow from a pixel's own indexes.
    """
    (a, _, c, _, e, f), (ta, _, tc, _, te, tf) = source, target
    rows = pixels.select(*layers, "row", "col", finite(F.col("value")).alias("value")).where("value IS NOT NULL")
    rows = rows.select(*layers, "value", "col", F.explode(_overlaps("row", f, e, tf, te, height)).alias("y"))
    rows = rows.select(*layers, "value", "y", F.explode(_overlaps("col", c, a, tc, ta, width)).alias("x"))
    w = F.col("y.w") * F.col("x.w")
    rows = rows.select(*layers, F.col("y.k").alias("row"), F.col("x.k").alias("col"), w.alias("w"), "value").where("w > 1e-12")
    return rows.groupBy(*layers, "row", "col").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"), F.sum("w").alias("share"))


def bilinear_onto(pixels: DataFrame, source: tuple, source_shape: tuple[int, int], target: tuple, target_shape: tuple[int, int], to_source: Projection | None = None, layers: tuple[str, ...] = ()) -> DataFrame:
    """(layers, row, col, value) of each target cell whose centre lies on the source grid, between the four pixels around it.

    to_source: places of the target's projection in the source's; none: they are the same. Weights of
    missing pixels go to the others; without any the value is null. Corners are worked out once for all
    layers and meet the source by an equi-join on the pixel.
    """
    spark = pixels.sparkSession
    (a, _, c, _, e, f), (height, width) = source, source_shape
    cells = grid_cells(spark, target_shape[1], target_shape[0])
    x, y = cell_centre(F.col("row"), F.col("col"), *target)
    if to_source:
        x, y = to_source(x, y)
    cells = cells.withColumn("lon_pos", (x - c) / a - 0.5).withColumn("lat_pos", (y - f) / e - 0.5)
    cells = cells.where(F.col("lon_pos").between(-0.5, width - 0.5) & F.col("lat_pos").between(-0.5, height - 0.5))
    cells = cells.select(F.struct("row", "col").alias("cell"), "lon_pos", "lat_pos")
    grid = pixels.select(*layers, F.col("row").alias("lat_idx"), F.col("col").alias("lon_idx"), "value")
    found = bilinear(corner_weights(cells, width, height), grid, "cell", layers)
    return found.select(*layers, "cell.row", "cell.col", "value")
