"""One catalogue of products, whether a month is a raster, a member of an archive or a step of a cube; and their pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cube, files, raster


def cube_months(spark: SparkSession, path: str, product: str, scale: int) -> DataFrame:
    """(product, scale, month, path, band) of a cube's steps, bands from 1, by its own time axis."""
    dates = cube.describe(path).dates
    return spark.createDataFrame([(product.lower(), scale, f"{y}-{m:02d}", path, k + 1) for k, (y, m, _) in enumerate(dates)], "product string, scale int, month string, path string, band int")


def catalogue(listed: DataFrame, members: DataFrame | None = None, cubes: DataFrame | None = None) -> DataFrame:
    """(product, scale, month, path, band): rasters by name (listed: path), members of archives (archive, member, offset, size) whose product no raster or cube has, and steps of cubes. A raster's band is 1.

    A product that has a cube is read from it, not from rasters of its name.
    """
    named = files.products(listed)
    own = named.withColumn("band", F.lit(1))
    if cubes is not None:
        own = own.join(cubes.select("product").distinct(), "product", "left_anti").select("product", "scale", "month", "path", "band").unionByName(cubes.select("product", "scale", "month", "path", "band"))
    if members is not None:
        inner = members.select(F.col("member").alias("path"), files.member_path(F.col("archive"), F.col("offset"), F.col("size")).alias("_at"))
        found = files.products(inner.select("path")).join(inner, "path").select("product", "scale", "month", F.col("_at").alias("path"), F.lit(1).alias("band"))
        own = own.unionByName(found.join(own.select("product").distinct(), "product", "left_anti"))
    return own.select("product", "scale", "month", "path", "band")


def product_pixels(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """(product, scale, month, row, col, value) of the months of a catalogue; of cubes only the steps that it lists, from the first to the last, are read."""
    tiffs = listed.where(F.lower("path").rlike(r"\.tif(#|$)|#\d+\+\d+$")).select("product", "scale", "month", "path")
    found = raster.pixels_of(tiffs.select("path").distinct()).join(tiffs, "path").select("product", "scale", "month", "row", "col", "value")
    cubes = listed.join(tiffs.select("path").distinct(), "path", "left_anti")
    for r in cubes.groupBy("path").agg(F.min("band").alias("a"), F.max("band").alias("b")).collect():  # a row a cube
        steps = cubes.where(F.col("path") == r["path"]).select("product", "scale", "month", (F.col("band") - 1).alias("t"))
        cells = cube.read_cube(spark, r["path"], first=r["a"] - 1, last=r["b"])
        found = found.unionByName(cells.join(F.broadcast(steps), "t").select("product", "scale", "month", "row", "col", "value"))  # a row a step
    return found
