"""Station and grid climatologies and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import finite, numeric_columns
from .features import add_history, is_precipitation


def anomaly_sources(df: DataFrame, scale: int) -> list[str]:
    """Current and rolling dynamic predictors of the scale, by name."""
    ends = (f"_roll{scale}_mean", f"_roll{scale}_sum")
    return sorted(c for c in numeric_columns(df) if c.startswith("dyn_") and not c.startswith(("dyn_lon", "dyn_lat", "dyn_time")) and "_lag" not in c and ("_roll" not in c or c.endswith(ends)))


def station_climatology(df: DataFrame, columns: list[str]) -> DataFrame:
    """(station_id, month, clim_*): means of each calendar month, missing values left out."""
    return df.groupBy("station_id", "month").agg(*(F.avg(finite(F.col(f"`{c}`"))).alias(f"clim_{c}") for c in columns))


def add_anomalies(df: DataFrame, scale: int, start: int = 1979, end: int = 2018) -> DataFrame:
    """df with clim_* and anom_* of its anomaly sources; the climatology is of the years start..end.

    One window by (station, month) instead of an aggregate and a join back: rows outside the baseline
    count as missing.
    """
    columns = anomaly_sources(df, scale)
    if not columns:
        raise ValueError("no current or rolling dynamic predictors")
    w = W.partitionBy("station_id", "month")
    base = F.col("year").between(start, end)
    df = df.withColumns({f"clim_{c}": F.avg(F.when(base, finite(F.col(f"`{c}`")))).over(w) for c in columns})
    return df.withColumns({f"anom_{c}": F.col(f"`{c}`") - F.col(f"`clim_{c}`") for c in columns})


def train_period_anomalies(train: DataFrame, test: DataFrame, scale: int, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both tables with the climatology of the training rows only; raises if a test value has none (when check)."""
    columns = anomaly_sources(train, scale)
    clim = station_climatology(train, columns)
    derived = [f"{p}_{c}" for c in columns for p in ("clim", "anom")]

    def attach(df):
        out = df.drop(*derived).join(clim, ["station_id", "month"], "left")
        return out.withColumns({f"anom_{c}": F.col(f"`{c}`") - F.col(f"`clim_{c}`") for c in columns})

    a, b = attach(train), attach(test)
    if check:
        missing = b.agg(*(F.count_if(F.col(f"`clim_{c}`").isNull()).alias(c) for c in columns)).first()
        if sum(missing):
            raise ValueError(f"no training climatology for {sum(missing)} test values of scale {scale}")
    return a, b


def grid_month_features(grid: DataFrame, scale: int, keys: tuple[str, ...] = ("variable", "row", "col")) -> DataFrame:
    """Current value, lags, full-window mean and sum of every cell and month, with the climatology and anomaly of each.

    grid: keys, `t` (months from 0, no gaps) and value. Means of calendar months run over all months
    for the current value and over full windows for the rolling ones. Everything is windowed by cell.
    """
    w = W.partitionBy(*keys).orderBy("t")
    cells = add_history(grid.withColumn("value", finite(F.col("value"))), ["value"], scale, keys=keys, order=("t",))
    frame = w.rowsBetween(1 - scale, 0)
    full = F.count("value").over(frame) == scale
    cells = cells.withColumn(f"value_roll{scale}_sum", F.when(full & F.lower(F.col("variable")).contains("prec"), F.sum("value").over(frame)))
    month = W.partitionBy(*keys, F.pmod(F.col("t"), F.lit(12)))
    names = ["value", f"value_roll{scale}_mean", f"value_roll{scale}_sum"]
    cells = cells.withColumns({f"clim_{n}": F.avg(n).over(month) for n in names})
    return cells.withColumns({f"anom_{n}": F.col(n) - F.col(f"clim_{n}") for n in names})


__all__ = ["add_anomalies", "anomaly_sources", "grid_month_features", "is_precipitation", "station_climatology", "train_period_anomalies"]
