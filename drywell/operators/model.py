"""Boosted-tree regression with median imputation, and the four validation designs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import finite
from ..functions.metrics import fold_summary, regression_metrics
from ..functions.store import settled
from . import boosting
from . import folds as splits
from .climatology import train_period_anomalies
from .features import select_features

#: Depth-wise trees nearest to leaf-wise ones of 63 leaves; the other settings have a counterpart.
PARAMS = {"maxIter": 800, "stepSize": 0.03, "maxDepth": 6, "minInstancesPerNode": 30, "featureSubsetStrategy": "0.8", "maxBins": 255, "subsamplingRate": 1.0, "seed": 42}


#: Equal steps that a round of the exact medians cuts each column's range into.
STEPS = 1024


def ranked_values(long: DataFrame, ranks) -> tuple[dict[int, int], dict[tuple[int, int], float]]:
    """(numbers of values by c, values by c and rank from 0) of long (c int, v double, no nulls); ranks: those wanted of n values.

    Each round counts the values of all c by equal steps of the range that still holds a rank, with
    the least and the greatest of a step, and goes on with the rank's step: at most STEPS rows a rank
    come to the driver, and no task ever holds the values of a c.
    """
    found = {r["c"]: r for r in long.groupBy("c").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    # Of each c and rank: the range that holds it and how many values lie below.
    open_ = {(c, k): (r["low"], r["high"], 0) for c, r in found.items() for k in set(ranks(r["n"]))}
    done: dict[tuple[int, int], float] = {}
    while open_:
        for key, (low, high, _) in list(open_.items()):
            if low == high:
                done[key] = low
                del open_[key]
        ranges = sorted({(c, low, high) for (c, _), (low, high, _) in open_.items()})
        if not ranges:
            break
        bounds = long.sparkSession.createDataFrame(ranges, "c int, low double, high double")
        # Halves first, so that a range of the greatest numbers doesn't overflow.
        step = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * STEPS), F.lit(STEPS - 1))
        own = long.join(F.broadcast(bounds), "c").where("v between low and high")  # a row a rank at most
        counts: dict[tuple, list] = {}
        for r in own.groupBy("c", "low", "high", step.alias("s")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect():
            counts.setdefault((r["c"], r["low"], r["high"]), []).append((r["s"], r["n"], r["a"], r["b"]))
        for key, (low, high, below) in list(open_.items()):
            for _, n, a, b in sorted(counts[key[0], low, high]):
                if below + n > key[1]:
                    open_[key] = (a, b, below)
                    break
                below += n
    return {c: r["n"] for c, r in found.items()}, done


def _stepped(df: DataFrame, columns: list[str], ranges: list[tuple[int, float, float]]) -> list:
    """(range, step, n, least, greatest) of the finite values in each range (column, low, high), low < high: a row a step that holds any."""
    names = ["r", "s", "n", "a", "b"]

    def run(batches):
        n, a, b = np.zeros((len(ranges), STEPS), np.int64), np.full((len(ranges), STEPS), np.inf), np.full((len(ranges), STEPS), -np.inf)
        for batch in batches:
            for k, (c, low, high) in enumerate(ranges):
                v = batch.column(c).to_numpy(zero_copy_only=False)
                v = v[(v >= low) & (v <= high)]
                # Halves first, so that a range of the greatest numbers doesn't overflow.
                s = np.minimum((v / 2 - low / 2) / (high / 2 - low / 2) * STEPS, STEPS - 1).astype(np.int64)
                n[k] += np.bincount(s, minlength=STEPS)
                np.minimum.at(a[k], s, v)
                np.maximum.at(b[k], s, v)
        r, s = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r, s, n[r, s], a[r, s], b[r, s])], names=names)

    found = df.select(*(F.col(f"`{c}`").cast("double").alias(f"_x{k}") for k, c in enumerate(columns))).mapInArrow(run, "r long, s long, n long, a double, b double")
    return found.groupBy("r", "s").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).collect()


def ranked_columns(df: DataFrame, columns: list[str], ranks) -> tuple[dict[int, int], dict[tuple[int, int], float]]:
    """What `ranked_values` gives, of the finite values of each column: rows stay as they are, and each task counts all columns in arrays."""
    wide = [finite(F.col(f"`{c}`").cast("double")) for c in columns]
    row = df.agg(*(f(v).alias(f"{n}{k}") for k, v in enumerate(wide) for n, f in (("n", F.count), ("a", F.min), ("b", F.max)))).first()
    many = {k: row[f"n{k}"] for k in range(len(columns)) if row[f"n{k}"]}
    open_ = {(k, r): (row[f"a{k}"], row[f"b{k}"], 0) for k, n in many.items() for r in set(ranks(n))}
    done: dict[tuple[int, int], float] = {}
    while open_:
        for key, (low, high, _) in list(open_.items()):
            if low == high:
                done[key] = low
                del open_[key]
        ranges = sorted({(c, low, high) for (c, _), (low, high, _) in open_.items()})
        if not ranges:
            break
        counts: dict[tuple, list] = {}
        for r in _stepped(df, columns, ranges):
            counts.setdefault(ranges[r["r"]], []).append((r["s"], r["n"], r["a"], r["b"]))
        for key, (low, high, below) in list(open_.items()):
            for _, n, a, b in sorted(counts[key[0], low, high]):
                if below + n > key[1]:
                    open_[key] = (a, b, below)
                    break
                below += n
    return many, done


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians (the mean of the two middle values) of finite values; columns without any are left out. df is read in a few rounds, so it should be stored."""
    many, at = ranked_columns(df, columns, lambda n: ((n - 1) // 2, n // 2))
    return {columns[c]: (at[c, (n - 1) // 2] + at[c, n // 2]) / 2 for c, n in many.items()}


def quantiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each share): exact quantiles of finite values by group, between neighbouring ranks where a share falls there.

    For reports: a row a group comes to the driver, values never come together. Groups without values give no row.
    """
    spark = df.sparkSession
    rows = df.select(*keys, finite(F.col(f"`{column}`").cast("double")).alias("v")).where("v IS NOT NULL")
    groups = rows.select(*keys).distinct().collect()
    schema = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes)
    known = spark.createDataFrame([(*g, c) for c, g in enumerate(groups)], f"{schema}, c int")
    same = None
    for k in keys:
        one = rows[k].eqNullSafe(known[k])
        same = one if same is None else same & one
    long = rows.join(F.broadcast(known), same).select("c", "v")
    ends = lambda n, p: (int(p * (n - 1)), min(n - 1, int(p * (n - 1)) + 1))
    many, at = ranked_values(long, lambda n: [k for p in shares.values() for k in ends(n, p)])
    out = []
    for c, n in sorted(many.items()):
        values = []
        for p in shares.values():
            low, high = ends(n, p)
            part = p * (n - 1) - low
            values.append(at[c, low] + (at[c, high] - at[c, low]) * part if part else at[c, low])
        out.append((*groups[c], *values))
    return spark.createDataFrame(out, f"{schema}, " + ", ".join(f"`{n}` double" for n in shares))


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(finite(F.col(f"`{c}`")), F.lit(float(v))) for c, v in values.items()})


class Regressor:
    """Medians of the training rows and a fitted model, of Spark's trees or leaf-wise ones; predict() needs all features."""

    def __init__(self, values: dict[str, float], model: PipelineModel | boosting.Forest):
        self.values, self.model = values, model

    def predict(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        missing = [c for c in self.values if c not in df.columns]
        if missing:
            raise ValueError(f"missing features {missing[:10]}")
        if isinstance(self.model, boosting.Forest):
            return self.model.predict(impute(df, self.values), keep or df.columns)
        out = self.model.transform(impute(df, self.values))
        return out.select(*(keep or df.columns), F.col("prediction").alias("pred"))


def fit(train: DataFrame, features: list[str] | None = None, label: str = "spei", params: dict | None = None, leafwise: bool = False) -> Regressor:
    """A Regressor; params go to Spark's trees (PARAMS), or, leafwise, to `boosting.fit` (its PARAMS). train is read many times, so it should be stored."""
    features = features or select_features(train)
    values = medians(train, features)
    if not values:
        raise ValueError("no feature has a value")
    rows = impute(train, values).where(finite(F.col(label)).isNotNull()).withColumn(label, F.col(label).cast("double"))
    if leafwise:
        return Regressor(values, boosting.fit(rows, list(values), label, **(params or {})))
    assemble = VectorAssembler(inputCols=list(values), outputCol="_features")
    model = GBTRegressor(featuresCol="_features", labelCol=label, predictionCol="prediction", **(PARAMS | (params or {})))
    data = assemble.transform(rows.select(*values, label))
    return Regressor(values, PipelineModel([assemble, model.fit(data)]))


def _scored(parts: list[DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, fold metrics, summary); predictions are stored once, so that scores don't predict again."""
    pred = parts[0]
    for p in parts[1:]:
        pred = pred.unionByName(p)
    pred = settled(pred)
    return pred, regression_metrics(pred, ["timescale", "fold"]), fold_summary(pred)


def _out(model: Regressor, test: DataFrame, timescale: str, fold: int) -> DataFrame:
    rows = model.predict(test, ["station_id", "year", "month", "spei"])
    return rows.select(F.lit(timescale).alias("timescale"), F.lit(fold).alias("fold"), "station_id", "year", "month", F.col("spei").cast("double").alias("obs"), "pred", (F.col("pred") - F.col("spei")).alias("error"))


def validate_random(df: DataFrame, timescale: str, k: int = 5, seed: int = 42, **options):
    """Rows at random; climatology predictors are those of the whole period, as given."""
    features = select_features(df)
    rows = settled(splits.random_folds(df, ["station_id", "year", "month"], k, seed))
    return _scored([_out(fit(rows.where(F.col("fold") != f), features, **options), rows.where(F.col("fold") == f), timescale, f) for f in range(1, k + 1)])


def validate_stations(df: DataFrame, timescale: str, k: int = 5, **options):
    """All rows of a station on one side."""
    features = select_features(df)
    df = settled(df)
    rows = settled(df.join(splits.grouped_folds(df, "station_id", k).select("station_id", "fold"), "station_id"))
    parts = []
    for f in range(1, k + 1):
        train, test = rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)
        splits.assert_disjoint(train, test, ["station_id"], f"fold {f}")
        parts.append(_out(fit(train, features, **options), test, timescale, f))
    return _scored(parts)


def validate_blocks(df: DataFrame, timescale: str, k: int = 5, block_km: float = 200, buffer_km: float = 100, **options):
    """Whole spatial blocks on one side, and no training station nearer than the buffer to a test station."""
    features = select_features(df)
    df = settled(df)
    coords = settled(splits.spatial_folds(splits.station_coordinates(df), k, block_km))
    parts, kept = [], []
    for f in range(1, k + 1):
        test = coords.where(F.col("fold") == f)
        train = splits.distance_buffer(coords.where(F.col("fold") != f), test, buffer_km)
        if train.isEmpty():
            raise ValueError(f"the buffer of {buffer_km} km leaves no training station in fold {f}")
        near = splits.nearest_station(test.select("station_id", "lon", "lat"), train.select("station_id", "lon", "lat"))
        kept.append(near.select(F.lit(timescale).alias("timescale"), F.lit(f).alias("fold"), "*"))
        rows = df.join(train.select("station_id"), "station_id", "left_semi"), df.join(test.select("station_id"), "station_id", "left_semi")
        parts.append(_out(fit(settled(rows[0]), features, **options), rows[1], timescale, f))
    distances = kept[0]
    for d in kept[1:]:
        distances = distances.unionByName(d)
    return (*_scored(parts), coords, distances)


def validate_periods(df: DataFrame, timescale: str, scale: int, periods=((1999, 2003), (2004, 2008), (2009, 2013), (2014, 2018)), **options):
    """Strictly earlier years train; the climatology is that of the training years."""
    df, parts = settled(df), []
    for f, (start, end) in enumerate(periods, 1):
        train, test = splits.period_split(df, start, end)
        if train.isEmpty() or test.isEmpty():
            continue
        train, test = train_period_anomalies(train, test, scale)
        train = settled(train)
        parts.append(_out(fit(train, select_features(train), **options), test, timescale, f).withColumn("test_period", F.lit(f"{start}-{end}")))
    if not parts:
        raise ValueError("no period has training and test rows")
    return _scored(parts)
