"""Splits for validation: random, grouped, spatial blocks with a buffer, forward periods, and their guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import finite
from ..functions.geo import albers, arc_km, haversine_km, sphere
from ..functions.store import settled
from .sampling import _dealt, nearest


def random_folds(df: DataFrame, keys: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """df with `fold` 1..k of equal sizes (but for one row), by the rank of a hash of the keys.

    Ranks come from counts by the hash's leading bits, so no order runs over all rows.
    """
    h = F.xxhash64(*(F.col(c) for c in keys), F.lit(seed))
    rows = df.withColumn("_h", h).withColumn("_b", F.shiftrightunsigned("_h", 52))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))  # 4096 rows at most
    before = counts.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_all"))
    w = W.partitionBy("_b").orderBy("_h", *keys)
    ranked = rows.join(F.broadcast(before), "_b").withColumn("_r", F.row_number().over(w) - 1 + F.col("_before"))
    return ranked.withColumn("fold", (F.floor(F.col("_r") * k / F.col("_all")) + 1).cast("int")).drop("_h", "_b", "_before", "_all", "_r")


def deal(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """How groups go to folds, from (size, number of groups) in descending order: runs (size, first rank, length, folds in turn).

    Each group goes to the fold with the fewest rows, ties to the first. Groups of one size take turns
    over the folds that are less than a size above the lightest, in order of load, until the next fold is
    reached: that is one run, however many groups it has, and there are at most k runs a size.
    """
    loads, out = [0] * k, []
    for size, many in sizes:
        done = 0
        while done < many:
            order = sorted(range(k), key=lambda f: (loads[f], f))
            low = loads[order[0]]
            turn = [f for f in order if loads[f] < low + size]
            rest = loads[order[len(turn)]] if len(turn) < k else None
            length = many - done if rest is None else min(many - done, (rest - low) // size * len(turn))
            out.append((size, done, length, [f + 1 for f in turn]))
            for i, f in enumerate(turn):
                loads[f] += size * ((length - i + len(turn) - 1) // len(turn))
            done += length
    return out


def grouped_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """(group, n, fold): groups from large to small (ties by name, a null name first), each to the fold with the fewest rows (ties: the first).

    The plan is made on how many groups there are of each size (N rows have at most sqrt(2 N) sizes);
    a group finds its run by its rank among those of its size, which comes from counts by range of
    names: no list of groups is on the driver or in one task.
    """
    sizes = df.groupBy(F.col(group).cast("string").alias("_g")).agg(F.count("*").alias("n"))
    ranged = sizes.repartitionByRange("n", "_g").withColumn("_p", F.spark_partition_id())
    ranged = settled(ranged)
    counts = settled(ranged.groupBy("n", "_p").agg(F.count("*").alias("m")))
    plan = [(r["n"], r["m"]) for r in counts.groupBy("n").agg(F.sum("m").alias("m")).orderBy(F.desc("n")).collect()]  # a row a size
    if sum(m for _, m in plan) < k:
        raise ValueError(f"needs {k} groups at least, got {sum(m for _, m in plan)}")
    runs = df.sparkSession.createDataFrame(deal(plan, k), "n long, first long, length long, turn array<int>")
    before = counts.select("n", "_p", (F.sum("m").over(W.partitionBy("n").orderBy("_p")) - F.col("m")).alias("before"))
    rank = F.row_number().over(W.partitionBy("n", "_p").orderBy(F.col("_g").asc_nulls_first())) - 1
    ranked = ranged.withColumn("_r", rank).join(before, ["n", "_p"]).withColumn("_r", F.col("_r") + F.col("before"))
    met = ranked.join(runs, "n").where((F.col("_r") >= F.col("first")) & (F.col("_r") < F.col("first") + F.col("length")))
    turn = F.get("turn", ((F.col("_r") - F.col("first")) % F.size("turn")).cast("int"))
    return met.select(F.col("_g").alias(group), "n", turn.alias("fold"))


def station_coordinates(df: DataFrame) -> DataFrame:
    """(station_id, lon, lat) once per station; raises if a station's coordinates vary (a missing one counts as a value)."""
    pick = lambda names: next((c for c in names if c in df.columns), None)
    lon, lat = pick(["station_lon", "lon", "dyn_lon"]), pick(["station_lat", "lat", "dyn_lat"])
    if lon is None or lat is None:
        raise ValueError("no longitude and latitude columns")
    rows = df.select("station_id", finite(F.col(lon).try_cast("double")).alias("lon"), finite(F.col(lat).try_cast("double")).alias("lat")).distinct()
    bad = rows.groupBy("station_id").count().where("count > 1").limit(10).collect()
    if bad:
        raise ValueError(f"coordinates vary for stations {[r['station_id'] for r in bad]}")
    return rows.na.drop(subset=["lon", "lat"])


def spatial_blocks(coords: DataFrame, block_km: float = 200, projected: bool = True) -> DataFrame:
    """coords with x_m, y_m (equal-area unless given), block_x, block_y and spatial_block, counted from the smallest x and y."""
    if block_km <= 0:
        raise ValueError("block_km must be positive")
    if projected:
        x, y = albers(F.col("lon"), F.col("lat"))
        coords = coords.withColumn("x_m", x).withColumn("y_m", y)
    low = coords.agg(F.min("x_m").alias("_x0"), F.min("y_m").alias("_y0"))
    rows = coords.crossJoin(F.broadcast(low))  # one row
    step = lambda v, v0: F.floor((F.col(v) - F.col(v0)) / (block_km * 1000.0)).cast("int")
    rows = rows.withColumn("block_x", step("x_m", "_x0")).withColumn("block_y", step("y_m", "_y0")).drop("_x0", "_y0")
    return rows.withColumn("spatial_block", F.concat_ws("_", "block_x", "block_y"))


def spatial_folds(coords: DataFrame, k: int = 5, block_km: float = 200) -> DataFrame:
    """Stations with their block and fold; whole blocks share a fold."""
    blocks = spatial_blocks(coords, block_km)
    folds = grouped_folds(blocks, "spatial_block", k).select("spatial_block", "fold")
    return blocks.join(folds, "spatial_block")


def within(train: DataFrame, test: DataFrame, km: float, id_col: str = "station_id") -> DataFrame:
    """Ids of training stations nearer than km to a test station: an equi-join on cells of that size, not a cross join."""
    xyz = lambda df, p: df.select(F.col(id_col).alias(f"{p}id"), F.col("lon").alias(f"{p}lon"), F.col("lat").alias(f"{p}lat"), *(c.alias(f"{p}{a}") for c, a in zip(sphere(F.col("lon"), F.col("lat")), "xyz")))
    a, b = _dealt(xyz(train, "a"), ["ax", "ay", "az"], km, False), _dealt(xyz(test, "b"), ["bx", "by", "bz"], km, True)
    return a.join(b, "_c").where(haversine_km(F.col("alon"), F.col("alat"), F.col("blon"), F.col("blat")) < km).select(F.col("aid").alias(id_col)).distinct()


def distance_buffer(train: DataFrame, test: DataFrame, buffer_km: float = 100, id_col: str = "station_id") -> DataFrame:
    """Training stations at least buffer_km from every test station; all of them for a buffer of 0."""
    return train if buffer_km <= 0 else train.join(within(train, test, buffer_km, id_col), id_col, "left_anti")


def nearest_station(test: DataFrame, train: DataFrame, id_col: str = "station_id", start_km: float = 100.0) -> DataFrame:
    """test with nearest_training_station_km."""
    axes = ["x", "y", "z"]
    xyz = lambda df: df.select(id_col, *(c.alias(a) for c, a in zip(sphere(F.col("lon"), F.col("lat")), axes)))
    best = nearest(xyz(test), xyz(train).withColumnRenamed(id_col, "_t"), id_col, axes, start_km, [], ["_t"], 13_000.0)
    return test.join(best.select(id_col, arc_km(F.col("distance")).alias("nearest_training_station_km")), id_col, "left")


def period_split(df: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """(rows before the period, rows in it, both years inclusive)."""
    return df.where(F.col("year") < start), df.where(F.col("year").between(start, end))


def assert_disjoint(train: DataFrame, test: DataFrame, keys: list[str], what: str) -> None:
    """Raises if a key is on both sides, naming ten at most."""
    both = test.select(*keys).distinct().join(train.select(*keys).distinct(), keys, "left_semi").limit(10).collect()
    if both:
        raise ValueError(f"{what}: on both sides are {[tuple(r) for r in both]}")


def split_counts(train: DataFrame, test: DataFrame) -> dict[str, int]:
    """Rows, stations and years of both sides."""
    out = {}
    for name, df in (("train", train), ("test", test)):
        r = df.agg(F.count("*").alias("n"), F.count_distinct("station_id").alias("s"), F.min("year").alias("a"), F.max("year").alias("b")).first()
        out |= {f"n_{name}_samples": r["n"], f"n_{name}_stations": r["s"], f"{name}_first_year": r["a"], f"{name}_last_year": r["b"]}
    return out
