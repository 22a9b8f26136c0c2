"""Polygons to pixels: a scan-line rasteriser made of explodes and one grouping, no polygon join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ring_edges(polygons: DataFrame, id_col: str = "region_id", rings: str = "rings") -> DataFrame:
    """(id, x1, y1, x2, y2) of all rings, holes too. rings: array of rings, a ring an array of [x, y]."""
    ring = polygons.select(id_col, F.explode(rings).alias("r"))
    n = F.size("r")
    at = ring.where(n > 2).select(id_col, "r", F.posexplode("r").alias("i", "p"))
    q = F.element_at("r", (F.pmod(F.col("i") + 1, F.size("r")) + 1).cast("int"))
    edges = at.select(id_col, F.col("p")[0].alias("x1"), F.col("p")[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2"))
    return edges.where("y1 <> y2")


def rasterize(edges: DataFrame, x0: float, y0: float, dx: float, dy: float, width: int, height: int, id_col: str = "region_id") -> DataFrame:
    """(row, col, region_id) of pixels whose centre lies in a region, by the even-odd rule; where regions overlap the largest id wins.

    Pixel (0, 0) has its corner at (x0, y0); dy is negative for rows that go down. An edge gives its
    crossing with each row's centre line; a row's crossings of one region, in order, bound its spans.
    """
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    place = lambda y: (y - y0) / dy - 0.5
    a, b = place(lo), place(hi)
    first, last = F.ceil(F.least(a, b)), F.floor(F.greatest(a, b))
    # A centre line through the upper end of an edge belongs to the next edge only.
    first = F.greatest(first, F.lit(0)).cast("int")
    last = F.least(last, F.lit(height - 1)).cast("int")
    rows = edges.withColumn("_a", first).withColumn("_b", last).where("_a <= _b").withColumn("row", F.explode(F.sequence("_a", "_b")))
    y = (F.col("row") + 0.5) * dy + y0
    rows = rows.where((y >= lo) & (y < hi)).withColumn("x", F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    spans = rows.groupBy(id_col, "row").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    spans = spans.select(id_col, "row", F.explode(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1)).alias("k"), "xs")
    col = lambda x: F.ceil((x - x0) / dx - 0.5)
    left, right = F.element_at("xs", F.col("k") * 2 + 1), F.element_at("xs", F.col("k") * 2 + 2)
    spans = spans.select(id_col, "row", F.greatest(col(left), F.lit(0)).cast("int").alias("_a"), F.least(col(right) - 1, F.lit(width - 1)).cast("int").alias("_b")).where("_a <= _b")
    pixels = spans.select(id_col, "row", F.explode(F.sequence("_a", "_b")).alias("col"))
    return pixels.groupBy("row", "col").agg(F.max(id_col).alias(id_col))


def grid_cells(spark, width: int, height: int) -> DataFrame:
    """(row, col) of every cell of a grid."""
    return spark.range(width * height).select(F.expr(f"cast(id div {width} as int)").alias("row"), (F.col("id") % width).cast("int").alias("col"))


def cell_centre(row: Column, col: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> tuple[Column, Column]:
    """x and y of a cell's centre by the affine geometry x = a*col + b*row + c, y = d*col + e*row + f."""
    u, v = col + 0.5, row + 0.5
    return a * u + b * v + c, d * u + e * v + f


def fill_land(values: DataFrame, land: DataFrame) -> DataFrame:
    """Missing land cells with the nearest valid cell's value, on land or off it; cells off the land are not searched for. values: row, col, value."""
    from .sampling import fill_nearest

    on_land = land.select("row", "col").withColumn("_land", F.lit(True))
    grid = values.select("row", "col", "value").join(on_land, ["row", "col"], "full").select(F.col("row").alias("lat_idx"), F.col("col").alias("lon_idx"), "value", "_land")
    filled = fill_nearest(grid, want="_land").where("_land")
    return filled.select(F.col("lat_idx").alias("row"), F.col("lon_idx").alias("col"), F.col("filled").alias("value"))
