"""Scores as one pass of sums: regression, bivariate agreement and threshold detection.

All moments come from sums that merge, so they aggregate map-side and over any grouping sets. A
score without a value (no rows, no variance, no events) is null, never NaN or infinite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import finite, ratio

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "sae", "sse", "se")
#: A variance of less than this part of the mean square is rounding only.
ROUNDING = 1e-12


def pair_sums(x: Column, y: Column) -> list[Column]:
    """Aggregates of pairs with both sides finite; the error is x - y."""
    x, y = finite(x), finite(y)
    both = x.isNotNull() & y.isNotNull()
    e = x - y
    of = lambda v, name: F.coalesce(F.sum(F.when(both, v)), F.lit(0.0)).alias(name)
    return [F.count(F.when(both, F.lit(1))).alias("n"), of(x, "sx"), of(y, "sy"), of(x * x, "sxx"), of(y * y, "syy"), of(x * y, "sxy"), of(F.abs(e), "sae"), of(e * e, "sse"), of(e, "se")]


def merge_sums() -> list[Column]:
    """Aggregates that merge rows of sums."""
    return [F.sum(c).alias(c) for c in SUMS]


def _spread(n: Column, s: Column, ss: Column) -> Column:
    """n times the centred sum of squares; null if it is rounding only."""
    d = n * ss - s * s
    return F.when(d > ROUNDING * n * ss, d)


def scores(r2: bool = False) -> dict[str, Column]:
    """Score expressions over columns of SUMS; bias is x - y, R2 takes y for the observations."""
    n, sx, sy, sxx, syy, sxy, sae, sse, se = map(F.col, SUMS)
    some = F.nullif(n, F.lit(0))
    vx, vy = _spread(n, sx, sxx), _spread(n, sy, syy)
    out = {"R2": 1 - sse * n / vy} if r2 else {}
    return out | {"RMSE": F.sqrt(sse / some), "MAE": sae / some, "Bias": se / some, "Pearson_r": (n * sxy - sx * sy) / F.sqrt(vx * vy)}


def regression_metrics(df: DataFrame, keys: list[str], obs: str = "obs", pred: str = "pred") -> DataFrame:
    """keys, n, R2, RMSE, MAE, Bias (pred - obs), Pearson_r of finite pairs."""
    sums = df.groupBy(*keys).agg(*pair_sums(F.col(pred), F.col(obs)))
    return sums.select(*keys, "n", *(c.alias(k) for k, c in scores(r2=True).items()))


def fold_summary(df: DataFrame, by: str = "timescale", fold: str = "fold", obs: str = "obs", pred: str = "pred", pooled: bool = True) -> DataFrame:
    """Means and sample deviations of the folds' scores and, from the same pass, those over all rows.

    Rows are summed once by fold; a fold's sums are merged for the pooled scores. A null fold is left out.
    """
    names = ["R2", "RMSE", "MAE", "Bias", "Pearson_r"]
    sums = df.where(F.col(fold).isNotNull()).groupBy(by, fold).agg(*pair_sums(F.col(pred), F.col(obs)))
    each = sums.withColumns(scores(r2=True))
    rows = each.groupBy(by).agg(F.count("*").alias("n_folds"), *(f(k).alias(f"{k}_{n}") for k in names for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))), *merge_sums())
    if not pooled:
        return rows.drop(*SUMS)
    return rows.withColumns({f"{k}_pooled": c for k, c in scores(r2=True).items()}).withColumnRenamed("n", "n_pooled").drop(*SUMS[1:])


#: Drought levels by threshold.
LEVELS = {-1.0: "moderate_or_worse", -1.5: "severe_or_worse", -2.0: "extreme"}


def detection_counts(df: DataFrame, keys: list[str], thresholds=tuple(LEVELS), obs: str = "obs", pred: str = "pred") -> DataFrame:
    """keys, threshold and TP, FP, FN, TN; an event is a value at or below the threshold. One pass for all thresholds."""
    o, p = finite(F.col(obs)), finite(F.col(pred))
    rows = df.where(o.isNotNull() & p.isNotNull())
    counts = []
    for k, t in enumerate(thresholds):
        a, b = o <= t, p <= t
        counts += [F.count_if(x).alias(f"{n}_{k}") for n, x in (("TP", a & b), ("FP", ~a & b), ("FN", a & ~b), ("TN", ~a & ~b))]
    wide = rows.groupBy(*keys).agg(*counts)
    long = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), *(F.col(f"{n}_{k}").alias(n) for n in ("TP", "FP", "FN", "TN"))) for k, t in enumerate(thresholds)))
    return wide.select(*keys, F.explode(long).alias("d")).select(*keys, "d.*")


def detection_scores(counts: DataFrame, digits: int | None = 4) -> DataFrame:
    """counts with totals and Precision, Recall, F1, FAR, CSI, Accuracy, rounded half to even."""
    tp, fp, fn, tn = map(F.col, ("TP", "FP", "FN", "TN"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    out = {
        "n_samples": tp + fp + fn + tn, "n_drought_obs": tp + fn, "n_drought_pred": tp + fp, "Precision": precision, "Recall": recall,
        "F1": ratio(2 * precision * recall, precision + recall), "FAR": ratio(fp, tp + fp), "CSI": ratio(tp, tp + fp + fn), "Accuracy": ratio(tp + tn, tp + fp + fn + tn),
    }
    return counts.withColumns({k: F.bround(c, digits) if digits is not None and k[0] != "n" else c for k, c in out.items()})


def level_name(threshold: Column, levels: dict[float, str] = LEVELS) -> Column:
    found = F.lit(None).cast("string")
    for t, name in levels.items():
        found = F.when(threshold == t, F.lit(name)).otherwise(found)
    return found


def ordered_scales(scale: Column, order=("SPEI-1", "SPEI-3", "SPEI-6", "SPEI-12", "SPEI-24")) -> Column:
    """Rank of a timescale label in its fixed order; 0 if it is none of them."""
    return F.array_position(F.array(*map(F.lit, order)), scale)
