"""Training tables: joins of labels and predictors, calendar, lag and rolling features, feature lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendars import season_angle
from ..functions.clean import assert_unique, nan_to_null, numeric_columns
from ..functions.store import settled

KEYS = ["station_id", "year", "month"]
#: Columns that are never model features.
EXCLUDED = frozenset((
    "spei", "scale", "station_id", "month_end_date", "source_date", "date", "year_month", "time", "fold",
    "station_elevation_m", "Elevation(m)", "dyn_lon", "dyn_lat", "station_lon", "station_lat", "cmfd_grid_lon", "cmfd_grid_lat",
))


def is_precipitation(name: str) -> bool:
    """Whether a variable is summed over windows, by its name."""
    return "prec" in name.lower() or name.lower() == "pr"


def add_calendar(df: DataFrame) -> DataFrame:
    angle = season_angle(F.col("month"))
    return df.withColumn("month_sin", F.sin(angle)).withColumn("month_cos", F.cos(angle))


def history_names(columns: list[str], scale: int, max_lag: int | None = None) -> list[str]:
    lags = max(0, scale - 1) if max_lag is None else max_lag
    return [n for c in columns for n in (*(f"{c}_lag{k}" for k in range(1, lags + 1)), f"{c}_roll{scale}_mean", *([f"{c}_roll{scale}_sum"] if is_precipitation(c) else []))]


def add_history(df: DataFrame, columns: list[str], scale: int, max_lag: int | None = None, keys: tuple[str, ...] = ("station_id",), order: tuple[str, ...] = ("year", "month")) -> DataFrame:
    """Lags by position and full windows of `scale` rows of each column, all over one sort by station.

    A window with a missing row or value is null. Positions count the rows given, so a month that has
    no row is passed over.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    frame = w.rowsBetween(1 - scale, 0)
    lags = max(0, scale - 1) if max_lag is None else max_lag
    new = {}
    for c in columns:
        v = F.col(f"`{c}`")
        for k in range(1, lags + 1):
            new[f"{c}_lag{k}"] = F.lag(v, k).over(w)
        full = F.count(v).over(frame) == scale
        new[f"{c}_roll{scale}_mean"] = F.when(full, F.avg(v).over(frame))
        if is_precipitation(c):
            new[f"{c}_roll{scale}_sum"] = F.when(full, F.sum(v).over(frame))
    return df.withColumns(new)


def build_training(
    labels: DataFrame, dynamic: DataFrame, static: DataFrame | None, scale: int, extras: list[DataFrame] = (), max_lag: int | None = None,
    year_min: int | None = None, year_max: int | None = None, validate: bool = True, broadcast_rows: int = 100_000,
) -> DataFrame:
    """Complete training rows of one timescale.

    Labels of the scale and years join the dynamic predictors (named dyn_*) and the station's static
    ones; extra tables join on the keys they have. Rows with a missing label or history are dropped
    only after lags and windows, which count them. Where labels and static table share a name (lon,
    lat), the static one stays. The static table is broadcast only if it has at most broadcast_rows.
    Tables that are checked are stored first, so that check and join don't compute them twice.
    """
    rows = nan_to_null(labels).where(F.col("scale") == scale)
    if year_min is not None:
        rows = rows.where(F.col("year") >= year_min)
    if year_max is not None:
        rows = rows.where(F.col("year") <= year_max)
    dynamic = nan_to_null(dynamic)
    if validate:
        dynamic = assert_unique(settled(dynamic), KEYS, "dynamic predictors")
    varying = [f"dyn_{c}" for c in numeric_columns(dynamic) if c not in (*KEYS, "lat", "lon")]
    rows = rows.join(dynamic.select(*KEYS, *(F.col(f"`{c}`").alias(f"dyn_{c}") for c in dynamic.columns if c not in KEYS)), KEYS)
    if static is not None:
        static = settled(nan_to_null(static))
        if validate:
            assert_unique(static, ["station_id"], "static predictors")
        shared = [c for c in static.columns if c in rows.columns and c != "station_id"]
        small = static.limit(broadcast_rows + 1).count() <= broadcast_rows
        rows = rows.drop(*shared).join(F.broadcast(static) if small else static, "station_id", "left")
    for extra in extras:
        keys = [k for k in KEYS if k in extra.columns]
        extra = nan_to_null(extra)
        if validate:
            extra = assert_unique(settled(extra), keys, "extra table")
        varying += [c for c in numeric_columns(extra) if c not in keys]
        rows = rows.join(extra, keys, "left")
    varying = sorted(set(varying))
    rows = add_history(add_calendar(rows), varying, scale, max_lag)
    return rows.na.drop(subset=["spei", *history_names(varying, scale, max_lag)])


def combine_variables(tables: list[DataFrame], keys: tuple[str, ...] = ("station_id", "time", "year", "month"), validate: bool = True) -> DataFrame:
    """Tables of one variable each in full outer join on the keys, as one union and one aggregate instead of a chain of joins."""
    names = [next(c for c in t.columns if c not in keys) for t in tables]
    long = None
    for k, (t, name) in enumerate(zip(tables, names)):
        own = t.select(*keys, F.lit(k).alias("_of"), *((F.col(n).cast("double") if n == name else F.lit(None).cast("double")).alias(n) for n in names))
        long = own if long is None else long.unionByName(own)
    value = F.max
    if validate:  # a key that repeats in a variable fails the job that computes it: no input runs twice
        one = lambda k, n: F.when(F.count_if(F.col("_of") == k) > 1, F.raise_error(F.concat(F.lit(f"variable {n}: a key repeats, "), F.to_json(F.struct(*keys)))).cast("double")).otherwise(value(n))
    else:
        one = lambda k, n: value(n)
    return long.groupBy(*keys).agg(*(one(k, n).alias(n) for k, n in enumerate(names)))


def select_features(df: DataFrame, drop_soil: bool = True, drop_terrain: bool = False, drop_coordinates: bool = False) -> list[str]:
    """Numeric columns that a model may use, in order; raises if there is none."""
    out = [c for c in numeric_columns(df) if c not in EXCLUDED]
    out = [c for c in out if not (drop_soil and c.startswith("soil_")) and not (drop_terrain and c.startswith("dem_")) and not (drop_coordinates and c in ("lat", "lon"))]
    if not out:
        raise ValueError("no numeric feature columns")
    return out


def expected_feature_count(scale: int, variables: int = 7) -> int:
    """Features of a full table: per variable current, lags, mean, two climatologies and anomalies; sums; calendar and place."""
    return variables * (scale + 5) + 3 + 9


def assert_no_soil(columns: list[str]) -> list[str]:
    """columns; raises if a soil predictor is among them."""
    soil = [c for c in columns if c.startswith("soil_")]
    if soil:
        raise ValueError(f"soil predictors {soil[:10]}")
    return columns
