"""Registered queries from one grid to another, with their oracles. Stand-ins: `part` in two tiles, the nations as shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import regrid
from .catalog import query, rounded, table

#: Tiles of 41 x 41 pixels that share an edge: the west one of even keys, the east one of odd ones.
STEPS = 40
_TILE = """px AS (SELECT CASE p_partkey // 1681 % 2 WHEN 0 THEN 'n10e020' ELSE 'n10e021' END AS tile, CAST(p_partkey % 41 AS INTEGER) AS "row", CAST(p_partkey // 41 % 41 AS INTEGER) AS col, p_partkey // 3362 AS k,
        CASE WHEN p_size % 9 > 0 THEN p_retailprice END AS value FROM part),
    one AS (SELECT tile, "row", col, max(value) AS value FROM px GROUP BY ALL),
    lattice AS (SELECT 440 - "row" AS y, (CASE tile WHEN 'n10e020' THEN 800 ELSE 840 END) + col AS x, arg_max(value, tile) FILTER (WHERE value IS NOT NULL) AS value FROM one GROUP BY ALL)"""
_SHAPES = """shapes AS (SELECT n_nationkey AS id, 20.05 + n_nationkey % 5 * CAST(0.4 AS DOUBLE) AS x, 10.03 + n_nationkey // 5 * CAST(0.2 AS DOUBLE) AS y, 0.15 + n_nationkey % 3 * CAST(0.09 AS DOUBLE) AS s, 0.1 + n_nationkey % 2 * CAST(0.06 AS DOUBLE) AS t FROM nation)"""


def tiles(spark, d) -> DataFrame:
    p = table(spark, d, "part").select((F.col("p_partkey") % 41).cast("int").alias("row"), F.expr("cast(p_partkey div 41 % 41 as int)").alias("col"), F.when(F.expr("p_partkey div 1681 % 2 = 0"), "n10e020").otherwise("n10e021").alias("tile"), F.when(F.col("p_size") % 9 > 0, F.col("p_retailprice")).alias("value"))
    one = p.groupBy("tile", "row", "col").agg(F.max("value").alias("value"))
    return one.withColumn("lat", 11 - F.col("row") / STEPS).withColumn("lon", F.when(F.col("tile") == "n10e020", 20).otherwise(21) + F.col("col") / STEPS)


def shapes(spark, d) -> DataFrame:
    """A rectangle for each nation, with a hole in its middle."""
    n = F.col("n_nationkey")
    x, y, s, t = 20.05 + n % 5 * 0.4, 10.03 + F.floor(n / 5) * 0.2, 0.15 + n % 3 * 0.09, 0.1 + n % 2 * 0.06
    ring = lambda a, b, c, e: F.array(*(F.array(p, q) for p, q in ((a, b), (c, b), (c, e), (a, e), (a, b))))
    return table(spark, d, "nation").select(n.alias("region_id"), F.array(ring(x, y, x + s, y + t), ring(x + 0.05, y + 0.03, x + s - 0.05, y + t - 0.03)).alias("rings"))


@query(f"""WITH {_TILE}, {_SHAPES},
    inside AS (SELECT l.y / CAST(40 AS DOUBLE) AS lat, l.x / CAST(40 AS DOUBLE) AS lon, value FROM lattice l WHERE (SELECT count(*) FROM shapes WHERE l.x / CAST(40 AS DOUBLE) >= x AND l.x / CAST(40 AS DOUBLE) < x + s AND l.y / CAST(40 AS DOUBLE) >= y AND l.y / CAST(40 AS DOUBLE) < y + t
        AND NOT (l.x / CAST(40 AS DOUBLE) >= x + 0.05 AND l.x / CAST(40 AS DOUBLE) < x + s - 0.05 AND l.y / CAST(40 AS DOUBLE) >= y + 0.03 AND l.y / CAST(40 AS DOUBLE) < y + t - 0.03)) = 1),
    placed AS (SELECT CAST(floor((lat - 11.02) / -CAST(0.11 AS DOUBLE)) AS INTEGER) AS "row", CAST(floor((lon * cos(radians(lat)) - 19.6) / CAST(0.13 AS DOUBLE)) AS INTEGER) AS col, value FROM inside WHERE value IS NOT NULL)
    SELECT "row", col, round(avg(value), 6) AS dem_elev_m, round(max(value) - min(value), 6) AS dem_relief_1km, round(sqrt(greatest(avg(value * value) - pow(avg(value), 2), 0)), 4) AS dem_std_1km FROM placed WHERE "row" BETWEEN 0 AND 9 AND col BETWEEN 0 AND 15 GROUP BY ALL""")
def terrain_warp(spark, d):
    """Two tiles with a shared edge, cut to shapes with holes and warped to a sinusoidal grid."""
    found = regrid.terrain(tiles(spark, d), STEPS, (0.13, 0.0, 19.6, 0.0, -0.11, 11.02), 10, 16, lambda lon, lat: (lon * F.cos(F.radians(lat)), lat), shapes(spark, d))
    return rounded(found.withColumn("dem_std_1km", F.round("dem_std_1km", 4)))


_FINE = "fine AS (SELECT CAST(p_partkey // 50 AS INTEGER) AS \"row\", CAST(p_partkey % 50 AS INTEGER) AS col, CASE WHEN p_size % 7 > 0 THEN p_retailprice END AS value FROM part)"


def fine(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.expr("cast(p_partkey div 50 as int)").alias("row"), (F.col("p_partkey") % 50).cast("int").alias("col"), F.when(F.col("p_size") % 7 > 0, F.col("p_retailprice")).alias("value"))


@query(f"""WITH {_FINE}, r AS (SELECT CAST(i AS INTEGER) AS i, i * CAST(3.7 AS DOUBLE) + 0.4 AS lo FROM range(12) t(i)), c AS (SELECT CAST(i AS INTEGER) AS i, i * CAST(2.3 AS DOUBLE) - 1.1 AS lo FROM range(20) t(i)),
    met AS (SELECT r.i AS "row", c.i AS col, value, (least("row" + 1, r.lo + CAST(3.7 AS DOUBLE)) - greatest("row", r.lo)) / CAST(3.7 AS DOUBLE) * (least(col + 1, c.lo + CAST(2.3 AS DOUBLE)) - greatest(col, c.lo)) / CAST(2.3 AS DOUBLE) AS w
        FROM fine, r, c WHERE value IS NOT NULL AND "row" + 1 > r.lo AND "row" < r.lo + CAST(3.7 AS DOUBLE) AND col + 1 > c.lo AND col < c.lo + CAST(2.3 AS DOUBLE))
    SELECT "row", col, round(sum(w * value) / sum(w), 6) AS value, round(sum(w), 6) AS share FROM met WHERE w > 1e-12 GROUP BY ALL""")
def area_averages(spark, d):
    """Means by shared area on a coarser grid whose steps are no multiples."""
    return rounded(regrid.area_average(fine(spark, d), (1.0, 0, 0.0, 0, -1.0, 100.0), (2.3, 0, -1.1, 0, -3.7, 99.6), 12, 20))


@query(f"""WITH {_FINE}, n AS (SELECT max("row") + 1 AS h FROM fine),
    cells AS (SELECT CAST(a.i AS INTEGER) AS "row", CAST(b.i AS INTEGER) AS col, (b.i + CAST(0.5 AS DOUBLE)) * CAST(1.7 AS DOUBLE) + 0.5 * ((a.i + CAST(0.5 AS DOUBLE)) * CAST(1.3 AS DOUBLE) - 2) - 0.5 AS px, (a.i + CAST(0.5 AS DOUBLE)) * CAST(1.3 AS DOUBLE) - 2 - 0.5 AS py FROM range(30) a(i), range(30) b(i)),
    on_ AS (SELECT cells.*, h, least(greatest(floor(px), 0), 48) AS x0, least(greatest(floor(py), 0), h - 2) AS y0 FROM cells, n WHERE px BETWEEN -0.5 AND 49.5 AND py BETWEEN -0.5 AND h - 0.5),
    w AS (SELECT on_."row", on_.col, x0 + i AS x, y0 + j AS y, (CASE WHEN i = 1 THEN least(greatest(px - x0, 0), 1) ELSE 1 - least(greatest(px - x0, 0), 1) END) * (CASE WHEN j = 1 THEN least(greatest(py - y0, 0), 1) ELSE 1 - least(greatest(py - y0, 0), 1) END) AS w FROM on_, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
    SELECT w."row", w.col, round(sum(w * value) / sum(w) FILTER (WHERE value IS NOT NULL), 6) AS value FROM w JOIN fine ON fine."row" = w.y AND fine.col = w.x WHERE w > 0 GROUP BY ALL""")
def bilinear_regrid(spark, d):
    """A sheared target grid: its places are moved by half their northing in the source."""
    f, h = fine(spark, d), table(spark, d, "part").agg(F.max("p_partkey")).first()[0] // 50 + 1
    to = lambda x, y: (x + 0.5 * (100.0 - y), y)
    return rounded(regrid.bilinear_onto(f, (1.0, 0, 0.0, 0, -1.0, 100.0), (h, 50), (1.7, 0, 0.0, 0, -1.3, 102.0), (30, 30), to))
