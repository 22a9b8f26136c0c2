"""Agreement of two gridded products: by pair, region, month and pixel, from mergeable sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import finite
from ..functions.metrics import SUMS, merge_sums, pair_sums, scores


def valid_pairs(ours: DataFrame, ref: DataFrame, keys: list[str], mainland: DataFrame | None = None) -> DataFrame:
    """Rows that both products have a finite value for (and that lie in the mainland's pixels), with `ours` and `ref`."""
    rows = ours.select(*keys, finite(F.col("value")).alias("ours")).join(ref.select(*keys, finite(F.col("value")).alias("ref")), keys)
    rows = rows.where("ours IS NOT NULL AND ref IS NOT NULL")
    return rows if mainland is None else rows.join(mainland, [k for k in keys if k in mainland.columns], "left_semi")


def partial_sums(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Sums by keys; a table of them by month is the state that later months are merged into."""
    return pairs.groupBy(*keys).agg(*pair_sums(F.col("ours"), F.col("ref")))


def merged(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.groupBy(*keys).agg(*merge_sums())


def agreement(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, RMSE, MAE, Bias (ours - ref), Pearson_r from sums."""
    return sums.where("n > 0").select(*keys, "n", *(c.alias(k) for k, c in scores().items()))


def by_region(pairs: DataFrame, keys: list[str], region: str = "region_id") -> DataFrame:
    """Agreement in each region with an id above 0."""
    return agreement(partial_sums(pairs.where(F.col(region) > 0), [*keys, region]), [*keys, region])


def pixel_correlation(sums: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """keys, n and r of pixels with pairs; r is null with fewer than `least` months or no variance. sums: by pixel."""
    return sums.where("n > 0").select(*keys, "n", F.when(F.col("n") >= least, scores()["Pearson_r"]).alias("r"))


def monthly_means(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Means of both products over each month's valid pixels."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ours").alias("ours_mean"), F.avg("ref").alias("ref_mean"))


def summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Agreement with the span and number of months and of pixels that ever have a pair, all from one aggregate."""
    spans = [F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count_distinct("month").alias("n_months"), F.count_distinct("row", "col").alias("n_valid_pixels")]
    sums = pairs.groupBy(*keys).agg(*pair_sums(F.col("ours"), F.col("ref")), *spans)
    return sums.where("n > 0").select(*keys, "n", *(c.alias(k) for k, c in scores().items()), "first_month", "last_month", "n_months", "n_valid_pixels")


def common_months(ours: DataFrame, ref: DataFrame) -> DataFrame:
    """Months that both catalogues have."""
    return ours.select("month").intersect(ref.select("month"))


def remaining(catalog: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("product", "timescale")) -> DataFrame:
    """Catalogue entries that an earlier run hasn't finished."""
    return catalog.join(done.select(*keys).distinct(), list(keys), "left_anti")


__all__ = ["SUMS", "agreement", "by_region", "common_months", "merged", "monthly_means", "partial_sums", "pixel_correlation", "remaining", "summary", "valid_pairs"]
