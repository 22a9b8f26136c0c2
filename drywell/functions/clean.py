"""The boundary to outside data: NaN to null, safe casts, column aliases, zero denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that station tables use for the three key columns, in order of preference; the last ones are names read in another encoding.
STATION_ALIASES = {
    "station_id": ["station_id", "StationID", "station_ID", "ID", "id"],
    "lon": ["lon", "longitude", "lontitude(Decimal Degrees)", "\u7f01\u5fd3\u5bb3"],
    "lat": ["lat", "latitude", "latitude(Decimal Degrees)", "\u7efe\ue100\u5bb3"],
}


def finite(c: Column) -> Column:
    """null for null, NaN and infinities."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def number(c: Column, kind: str = "double") -> Column:
    """Text to a number, null where it isn't one."""
    return c.try_cast(kind)


def without(value: Column, nodata: float | None) -> Column:
    """null where the value is the nodata value, within the usual relative and absolute closeness, or isn't finite."""
    clean = finite(value)
    return clean if nodata is None else F.when(F.abs(clean - nodata) > 1e-8 + 1e-5 * abs(nodata), clean)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def nan_to_null(df: DataFrame) -> DataFrame:
    """All floating columns with NaN as null."""
    return df.select(*(F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema))


def rename_first(df: DataFrame, aliases: dict[str, list[str]], required: bool = True, any_case: bool = False) -> DataFrame:
    """Each name of `aliases` from the first of its synonyms that df has; other synonyms stay as they are."""
    for name, synonyms in aliases.items():
        found = next((s for s in synonyms if s in df.columns), None)
        if found is None and any_case:
            lower = {c.lower(): c for c in df.columns}
            found = next((lower[s.lower()] for s in synonyms if s.lower() in lower), None)
        if found is None:
            if required:
                raise ValueError(f"no column for {name}: needs one of {synonyms}, has {df.columns}")
        elif found != name:
            if name in df.columns:
                df = df.drop(name)
            df = df.withColumnRenamed(found, name)
    return df


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of number and boolean columns, in order."""
    return [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def assert_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """df itself; raises if a key repeats."""
    repeats = df.groupBy(*keys).count().where("count > 1").limit(10).collect()
    if repeats:
        raise ValueError(f"{what}: keys {keys} repeat, as in {[tuple(r[k] for k in keys) for r in repeats]}")
    return df
