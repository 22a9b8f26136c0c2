"""Registered queries of the drought engine over the driver's tables, and their SQL oracles.

Stand-ins: a supplier is a station, its line items by ship date are the daily series and the monthly
predictors, `part` is a grid of 50 columns, and quantity and line number make pairs of values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendars, geo, metrics
from ..functions.clean import rename_first
from ..functions.store import settled
from ..operators import climatology, consistency, features, folds, labels, model, regions, release, sampling

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; sums in another order differ in their last bits."""
    return df.select(*(F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema))


# --- stand-ins -------------------------------------------------------------------------------------


def supplier_month(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").cast("string").alias("station_id"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(F.sum("l_quantity").alias("dyn_prec"), (F.avg("l_extendedprice") * 0.0123457).alias("dyn_temp"))


SM = """sm AS (SELECT CAST(l_suppkey AS VARCHAR) AS station_id, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
    sum(l_quantity) AS dyn_prec, avg(l_extendedprice) * CAST(0.0123457 AS DOUBLE) AS dyn_temp FROM lineitem GROUP BY ALL)"""


def daily(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").cast("string").alias("station_id"), F.lit(1).alias("scale"), F.year("l_shipdate").alias("year"), F.dayofyear("l_shipdate").alias("doy"), F.col("l_quantity").alias("spei"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def daily_sql(calendar: str) -> str:
    date = (
        "CASE WHEN doy BETWEEN 1 AND 365 THEN make_date(year, month(DATE '2001-01-01' + CAST(doy - 1 AS INTEGER)), day(DATE '2001-01-01' + CAST(doy - 1 AS INTEGER))) END"
        if calendar == "noleap_365" else "CAST(make_date(year, 1, 1) + CAST(doy - 1 AS INTEGER) AS DATE)"
    )
    end = "last_day(date)" if calendar == "gregorian" else "CASE WHEN month(date) = 2 THEN make_date(year(date), 2, 28) ELSE last_day(date) END"
    return f"""raw AS (SELECT CAST(l_suppkey AS VARCHAR) AS station_id, 1 AS scale, year(l_shipdate) AS year, dayofyear(l_shipdate) AS doy, l_quantity AS spei,
        (l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS tie FROM lineitem),
    dated AS (SELECT *, {date} AS date FROM raw),
    ends AS (SELECT *, {end} AS month_end, count(*) OVER (PARTITION BY station_id, date) AS same_date,
        count(*) FILTER (WHERE date IS NULL) OVER (PARTITION BY station_id) AS lost,
        row_number() OVER (PARTITION BY station_id, year(date), month(date) ORDER BY date DESC, tie DESC) AS back FROM dated),
    audit AS (SELECT station_id, scale, '{calendar}' AS source_calendar, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
        strftime(max(month_end), '%Y-%m-%d') AS expected_month_end, strftime(max(date), '%Y-%m-%d') AS last_record_date, max(date) = max(month_end) AS last_record_is_month_end,
        count(*) FILTER (WHERE date = month_end) > 0 AS has_month_end_record, count(*) FILTER (WHERE date = month_end AND spei IS NOT NULL) > 0 AS month_end_spei_valid,
        max(spei) FILTER (WHERE back = 1) AS last_record_spei, max(spei) FILTER (WHERE back = 1 AND date = month_end) AS strict_month_end_spei,
        count(*) AS n_daily_records, count(*) FILTER (WHERE date = month_end) AS n_month_end_records, count(*) FILTER (WHERE same_date > 1) AS n_duplicate_date_rows, max(lost) AS invalid_date_rows_in_file,
        strftime(max(date) FILTER (WHERE date = month_end), '%Y-%m-%d') AS strict_source_date
        FROM ends WHERE date IS NOT NULL GROUP BY station_id, scale, year(date), month(date))"""


def oof(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    scale = F.when(F.col("l_returnflag") == "A", "SPEI-1").when(F.col("l_returnflag") == "N", "SPEI-3").otherwise("SPEI-6")
    obs = (F.col("l_quantity") - 25) / 10
    return li.select(scale.alias("timescale"), (F.col("l_orderkey") % 5 + 1).cast("int").alias("fold"), obs.alias("obs"), (0.8 * obs + 0.4 * (F.col("l_linenumber") - 4) / 3).alias("pred"))


OOF = """oof AS (SELECT CASE l_returnflag WHEN 'A' THEN 'SPEI-1' WHEN 'N' THEN 'SPEI-3' ELSE 'SPEI-6' END AS timescale, CAST(l_orderkey % 5 + 1 AS INTEGER) AS fold,
    (l_quantity - 25) / 10 AS obs, CAST(0.8 AS DOUBLE) * ((l_quantity - 25) / 10) + CAST(0.4 AS DOUBLE) * (l_linenumber - 4) / 3 AS pred FROM lineitem)"""


def grid(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    lat, lon = F.expr("cast(p_partkey div 50 as int)"), (F.col("p_partkey") % 50).cast("int")
    hole = (F.col("p_size") % 7 == 0) | lon.between(10, 14)
    return p.select(lat.alias("lat_idx"), lon.alias("lon_idx"), F.when(~hole, F.col("p_retailprice")).alias("value"))


GRID = "grid AS (SELECT CAST(p_partkey // 50 AS INTEGER) AS lat_idx, CAST(p_partkey % 50 AS INTEGER) AS lon_idx, CASE WHEN p_size % 7 = 0 OR p_partkey % 50 BETWEEN 10 AND 14 THEN NULL ELSE p_retailprice END AS value FROM part)"


def grid_height(spark, d) -> int:
    """Rows of the part grid, from the largest key alone."""
    return table(spark, d, "part").agg(F.max("p_partkey")).first()[0] // 50 + 1


def points(spark, d, n_lat: int) -> DataFrame:
    k = F.col("s_suppkey")
    lon = F.when(k % 10 == 0, F.lit(-0.5)).otherwise((k * 37 % 100) / 100 * 49)
    return table(spark, d, "supplier").select("s_suppkey", lon.alias("lon_pos"), ((k * 53 % 100) / 100 * (n_lat - 1)).alias("lat_pos"))


POINTS = """size AS (SELECT max(lat_idx) + 1 AS n FROM grid),
    pts AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN -0.5 ELSE CAST(s_suppkey * 37 % 100 AS DOUBLE) / 100 * 49 END AS lon_pos, CAST(s_suppkey * 53 % 100 AS DOUBLE) / 100 * (n - 1) AS lat_pos, n FROM supplier, size),
    plan AS (SELECT *, greatest(0, least(floor(lon_pos), 48)) AS x0, greatest(0, least(floor(lat_pos), n - 2)) AS y0,
        CAST(greatest(0, least(round_even(lon_pos, 0), 49)) AS INTEGER) AS xn, CAST(greatest(0, least(round_even(lat_pos, 0), n - 1)) AS INTEGER) AS yn FROM pts),
    wts AS (SELECT *, least(greatest(lon_pos - x0, 0), 1) AS wx, least(greatest(lat_pos - y0, 0), 1) AS wy FROM plan),
    corners AS (SELECT s_suppkey, xn, yn, x0 + i AS lon_idx, y0 + j AS lat_idx, (CASE WHEN i = 1 THEN wx ELSE 1 - wx END) * (CASE WHEN j = 1 THEN wy ELSE 1 - wy END) AS w
        FROM wts, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))"""


def coords(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.cast("string").alias("station_id"), (73 + (k * 37 % 620) / 10).alias("lon"), (18 + (k * 53 % 350) / 10).alias("lat"), (k % 5 == 0).alias("is_test"))


COORDS = """coords AS (SELECT CAST(s_suppkey AS VARCHAR) AS station_id, 73 + CAST(s_suppkey * 37 % 620 AS DOUBLE) / 10 AS lon, 18 + CAST(s_suppkey * 53 % 350 AS DOUBLE) / 10 AS lat, s_suppkey % 5 = 0 AS is_test FROM supplier)"""
HAVERSINE = "2 * 6371.0088 * asin(sqrt(least(greatest(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 0), 1)))"


def pairs(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return li.select(F.lit("p").alias("product"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), (F.col("l_partkey") % 100).cast("int").alias("col"), F.lit(0).alias("row"), F.col("s_nationkey").alias("region_id"), F.col("l_quantity").alias("ours"), (0.7 * F.col("l_quantity") + F.col("l_linenumber")).alias("ref"))


PAIRS = """pairs AS (SELECT 'p' AS product, strftime(l_shipdate, '%Y-%m') AS month, CAST(l_partkey % 100 AS INTEGER) AS col, 0 AS "row", s_nationkey AS region_id, l_quantity AS ours, CAST(0.7 AS DOUBLE) * l_quantity + l_linenumber AS ref
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def scores_sql(x: str, y: str, r2: bool = False, digits: int = 6) -> str:
    """Score columns of pairs x, y with error x - y."""
    vx, vy = (f"nullif(greatest(count(*) * sum({v} * {v}) - sum({v}) * sum({v}), 0), 0)" for v in (x, y))
    out = [f"round(1 - sum(({x} - {y}) * ({x} - {y})) * count(*) / {vy}, {digits}) AS R2"] if r2 else []
    out += [f"round(sqrt(avg(({x} - {y}) * ({x} - {y}))), {digits}) AS RMSE", f"round(avg(abs({x} - {y})), {digits}) AS MAE", f"round(avg({x} - {y}), {digits}) AS Bias", f"round((count(*) * sum({x} * {y}) - sum({x}) * sum({y})) / sqrt({vx} * {vy}), {digits}) AS Pearson_r"]
    return ", ".join(out)


# --- features and climatology ----------------------------------------------------------------------

HISTORY = """hist AS (SELECT *, lag(dyn_prec, 1) OVER w AS dyn_prec_lag1, lag(dyn_prec, 2) OVER w AS dyn_prec_lag2, lag(dyn_temp, 1) OVER w AS dyn_temp_lag1, lag(dyn_temp, 2) OVER w AS dyn_temp_lag2,
    CASE WHEN count(dyn_prec) OVER f = 3 THEN avg(dyn_prec) OVER f END AS dyn_prec_roll3_mean, CASE WHEN count(dyn_prec) OVER f = 3 THEN sum(dyn_prec) OVER f END AS dyn_prec_roll3_sum,
    CASE WHEN count(dyn_temp) OVER f = 3 THEN avg(dyn_temp) OVER f END AS dyn_temp_roll3_mean FROM sm
    WINDOW w AS (PARTITION BY station_id ORDER BY year, month), f AS (PARTITION BY station_id ORDER BY year, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    full_ AS (SELECT * FROM hist WHERE dyn_prec_lag2 IS NOT NULL AND dyn_temp_lag2 IS NOT NULL AND dyn_prec_roll3_mean IS NOT NULL AND dyn_temp_roll3_mean IS NOT NULL)"""
HIST_COLUMNS = ["dyn_prec", "dyn_temp", "dyn_prec_lag1", "dyn_prec_lag2", "dyn_temp_lag1", "dyn_temp_lag2", "dyn_prec_roll3_mean", "dyn_prec_roll3_sum", "dyn_temp_roll3_mean"]
SOURCES = ["dyn_prec", "dyn_prec_roll3_mean", "dyn_prec_roll3_sum", "dyn_temp", "dyn_temp_roll3_mean"]


def round_sql(columns, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def history(spark, d) -> DataFrame:
    rows = features.add_history(features.add_calendar(supplier_month(spark, d)), ["dyn_prec", "dyn_temp"], 3)
    return rows.na.drop(subset=features.history_names(["dyn_prec", "dyn_temp"], 3))


@query(f"""WITH {SM}, {HISTORY} SELECT station_id, year, month, round(sin(2 * pi() * month / 12.0), 6) AS month_sin, round(cos(2 * pi() * month / 12.0), 6) AS month_cos, {round_sql(HIST_COLUMNS)} FROM full_""")
def station_month_features(spark, d):
    return rounded(history(spark, d).select("station_id", "year", "month", "month_sin", "month_cos", *HIST_COLUMNS))


@query(f"""WITH {SM}, {HISTORY}, c AS (SELECT station_id, month, {", ".join(f"avg({c}) AS clim_{c}" for c in SOURCES)} FROM full_ WHERE year BETWEEN 1996 AND 1999 GROUP BY ALL)
    SELECT h.station_id, h.year, h.month, {", ".join(f"round({c}, 4) AS {c}, round(clim_{c}, 4) AS clim_{c}, round({c} - clim_{c}, 4) AS anom_{c}" for c in SOURCES)} FROM full_ h LEFT JOIN c USING (station_id, month)""")
def climatology_anomaly(spark, d):
    out = climatology.add_anomalies(history(spark, d), 3, 1996, 1999)
    return rounded(out.select("station_id", "year", "month", *(f"{p}{c}" for c in SOURCES for p in ("", "clim_", "anom_"))), 4)


@query(f"""WITH {SM}, {HISTORY}, c AS (SELECT station_id, month, {", ".join(f"avg({c}) AS clim_{c}" for c in SOURCES)} FROM full_ WHERE year < 1999 GROUP BY ALL)
    SELECT CASE WHEN year < 1999 THEN 'train' ELSE 'test' END AS side, h.station_id, h.year, h.month, {", ".join(f"round(clim_{c}, 4) AS clim_{c}, round({c} - clim_{c}, 4) AS anom_{c}" for c in SOURCES)}
    FROM full_ h LEFT JOIN c USING (station_id, month) WHERE year <= 2001""")
def train_period_climatology(spark, d):
    train, test = folds.period_split(history(spark, d), 1999, 2001)
    a, b = climatology.train_period_anomalies(train, test, 3, check=False)
    out = [F.lit("train").alias("side"), "station_id", "year", "month", *(f"{p}{c}" for c in SOURCES for p in ("clim_", "anom_"))]
    return rounded(a.select(*out).unionByName(b.select(F.lit("test").alias("side"), *out[1:])), 4)


@query(f"""WITH {SM}, {HISTORY}, c AS (SELECT station_id, month, {", ".join(f"avg({c}) AS clim_{c}" for c in SOURCES)} FROM full_ WHERE year < 1999 GROUP BY ALL)
    SELECT {", ".join(f"count(*) FILTER (WHERE clim_{c} IS NULL) AS missing_{c}" for c in SOURCES)} FROM full_ h LEFT JOIN c USING (station_id, month) WHERE year BETWEEN 1999 AND 2001""")
def test_climatology_gaps(spark, d):
    _, test = climatology.train_period_anomalies(*folds.period_split(history(spark, d), 1999, 2001), 3, check=False)
    return test.agg(*(F.count_if(F.col(f"clim_{c}").isNull()).alias(f"missing_{c}") for c in SOURCES))


@query(f"""WITH {SM}, {daily_sql("noleap_365")}, st AS (SELECT CAST(s_suppkey AS VARCHAR) AS station_id, CAST(s_nationkey AS DOUBLE) AS lon, s_acctbal AS dem_elev_m FROM supplier),
    j AS (SELECT audit.station_id, audit.year, audit.month, strict_month_end_spei AS spei, dyn_prec AS prec FROM audit JOIN sm USING (station_id, year, month)),
    h AS (SELECT *, lag(prec, 1) OVER w AS l1, lag(prec, 2) OVER w AS l2, CASE WHEN count(prec) OVER f = 3 THEN avg(prec) OVER f END AS m, CASE WHEN count(prec) OVER f = 3 THEN sum(prec) OVER f END AS s FROM j
        WINDOW w AS (PARTITION BY station_id ORDER BY year, month), f AS (PARTITION BY station_id ORDER BY year, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT h.station_id, h.year, h.month, spei, prec AS dyn_prec, lon, dem_elev_m, l1 AS dyn_prec_lag1, l2 AS dyn_prec_lag2, round(m, 6) AS dyn_prec_roll3_mean, s AS dyn_prec_roll3_sum, n_name
    FROM h LEFT JOIN st USING (station_id) LEFT JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS station_id, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) USING (station_id)
    WHERE spei IS NOT NULL AND l2 IS NOT NULL AND m IS NOT NULL""")
def training_table(spark, d):
    own, _, _ = labels.extract_labels(daily(spark, d), ties=TIES)
    own = own.withColumn("scale", F.lit(3)).withColumn("lon", F.lit(0.0))
    s = table(spark, d, "supplier")
    static = s.select(F.col("s_suppkey").cast("string").alias("station_id"), F.col("s_nationkey").cast("double").alias("lon"), F.col("s_acctbal").alias("dem_elev_m"))
    extra = s.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("station_id"), "n_name")
    dynamic = supplier_month(spark, d).select("station_id", "year", "month", F.col("dyn_prec").alias("prec"))
    rows = features.build_training(own, dynamic, static, 3, [extra])
    return rounded(rows.select("station_id", "year", "month", "spei", "dyn_prec", "lon", "dem_elev_m", "dyn_prec_lag1", "dyn_prec_lag2", "dyn_prec_roll3_mean", "dyn_prec_roll3_sum", "n_name"))


@query("""WITH a AS (SELECT CAST(l_suppkey AS VARCHAR) AS station_id, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, sum(l_quantity) AS prec FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
    b AS (SELECT CAST(l_suppkey AS VARCHAR) AS station_id, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, max(l_extendedprice) AS temp FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL)
    SELECT station_id, year, month, prec, temp FROM a FULL JOIN b USING (station_id, year, month)""")
def outer_variable_merge(spark, d):
    li = table(spark, d, "lineitem").withColumns({"station_id": F.col("l_suppkey").cast("string"), "year": F.year("l_shipdate"), "month": F.month("l_shipdate")})
    keys = ("station_id", "year", "month")
    a = li.where("l_returnflag = 'A'").groupBy(*keys).agg(F.sum("l_quantity").alias("prec"))
    b = li.where("l_returnflag = 'N'").groupBy(*keys).agg(F.max("l_extendedprice").alias("temp"))
    return features.combine_variables([a, b], keys)


@query(f"""WITH {SM} SELECT station_id, year, month, dyn_prec * day(last_day(make_date(year, month, 1))) * 24 AS total FROM sm""")
def precip_monthly_total(spark, d):
    rows = supplier_month(spark, d)
    return rows.select("station_id", "year", "month", calendars.monthly_total(F.col("dyn_prec"), F.make_date("year", "month", F.lit(1)), "prec").alias("total"))


# --- labels ----------------------------------------------------------------------------------------

LABEL_SQL = "SELECT station_id, year, month, expected_month_end AS month_end_date, coalesce({date}, '') AS source_date, scale, {value} AS spei FROM audit"


@query(f"WITH {daily_sql('noleap_365')} " + LABEL_SQL.format(date="strict_source_date", value="strict_month_end_spei"))
def noleap_month_end_labels(spark, d):
    return labels.labels_from_audit(labels.month_audit(daily(spark, d), "noleap_365", TIES))


@query(f"WITH {daily_sql('gregorian')} " + LABEL_SQL.format(date="last_record_date", value="last_record_spei"))
def gregorian_last_record(spark, d):
    return labels.labels_from_audit(labels.month_audit(daily(spark, d), "gregorian", TIES), "last_record")


@query(f"WITH {daily_sql('noleap_365')} SELECT {', '.join(labels.AUDIT)} FROM audit")
def label_audit(spark, d):
    return labels.month_audit(daily(spark, d), ties=TIES).select(*labels.AUDIT)


@query(f"""WITH {daily_sql('noleap_365')} SELECT scale, count(*) AS n_station_months, count(DISTINCT station_id) AS n_stations, count(*) FILTER (WHERE NOT last_record_is_month_end) AS n_last_record_not_month_end,
    count(*) FILTER (WHERE NOT has_month_end_record) AS n_missing_month_end_record, count(*) FILTER (WHERE NOT month_end_spei_valid) AS n_invalid_month_end_spei,
    CAST(sum(n_duplicate_date_rows) AS BIGINT) AS n_duplicate_date_rows, count(*) FILTER (WHERE month_end_spei_valid) AS n_valid_strict_labels FROM audit GROUP BY scale""")
def label_audit_summary(spark, d):
    return labels.audit_summary(labels.month_audit(daily(spark, d), ties=TIES))


@query(f"""WITH {daily_sql('gregorian')}, l AS ({LABEL_SQL.format(date="strict_source_date", value="strict_month_end_spei")})
    SELECT l.station_id, l.year, l.month, l.spei, CAST(n_nationkey AS BIGINT) AS nation, n_name FROM l LEFT JOIN supplier ON l.station_id = CAST(s_suppkey AS VARCHAR) LEFT JOIN nation ON s_nationkey = n_nationkey WHERE l.year BETWEEN 1996 AND 1998""")
def labels_dynamic_static_join(spark, d):
    lookup = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("ID"), F.col("n_nationkey").cast("long").alias("nation"), "n_name")
    lookup = rename_first(lookup, {"station_id": ["station_id", "StationID", "ID"]})
    own, _, _ = labels.extract_labels(daily(spark, d), lookup, calendar="gregorian", start_year=1996, end_year=1998, ties=TIES)
    return own.select("station_id", "year", "month", "spei", "nation", "n_name")


# --- sampling --------------------------------------------------------------------------------------

BILINEAR = "b AS (SELECT s_suppkey, xn, yn, sum(w * value) / sum(w) FILTER (WHERE value IS NOT NULL) AS value FROM corners JOIN grid USING (lat_idx, lon_idx) WHERE w > 0 GROUP BY ALL)"
NEAREST = """near AS (SELECT h.lat_idx, h.lon_idx, arg_min(v.value, (pow(h.lat_idx - v.lat_idx, 2) + pow(h.lon_idx - v.lon_idx, 2), v.lat_idx, v.lon_idx)) AS filled
    FROM (SELECT * FROM grid WHERE value IS NULL) h, (SELECT * FROM grid WHERE value IS NOT NULL) v GROUP BY ALL)"""


@query(f"WITH {GRID}, {POINTS}, {BILINEAR} SELECT s_suppkey, round(value, 6) AS value FROM b")
def bilinear_sample(spark, d):
    n = grid_height(spark, d)
    return rounded(sampling.bilinear(sampling.corner_weights(points(spark, d, n), 50, n), grid(spark, d), "s_suppkey"))


@query(f"WITH {GRID}, {POINTS}, {BILINEAR}, {NEAREST} SELECT s_suppkey, round(coalesce(b.value, near.filled, grid.value), 6) AS value FROM b JOIN grid ON grid.lat_idx = yn AND grid.lon_idx = xn LEFT JOIN near ON near.lat_idx = yn AND near.lon_idx = xn")
def bilinear_fallback(spark, d):
    n, g = grid_height(spark, d), grid(spark, d)
    return rounded(sampling.bilinear(sampling.corner_weights(points(spark, d, n), 50, n), g, "s_suppkey", fallback=sampling.fill_nearest(g)))


@query(f"WITH {GRID}, {NEAREST} SELECT lat_idx, lon_idx, coalesce(value, filled) AS filled FROM grid LEFT JOIN near USING (lat_idx, lon_idx)")
def nearest_fill(spark, d):
    return sampling.fill_nearest(grid(spark, d)).select("lat_idx", "lon_idx", "filled")


TIERED = f"""WITH {GRID}, {POINTS}, q AS (SELECT s_suppkey, v.value, pow(yn - v.lat_idx, 2) + pow(xn - v.lon_idx, 2) AS d2, v.lat_idx, v.lon_idx, greatest(abs(yn - v.lat_idx), abs(xn - v.lon_idx)) AS c
        FROM plan, (SELECT * FROM grid WHERE value IS NOT NULL) v),
    t AS (SELECT *, CASE WHEN c <= 0 THEN 0 WHEN c <= 2 THEN 1 WHEN c <= 5 THEN 2 WHEN c <= 10 THEN 3 WHEN c <= 25 THEN 4 WHEN c <= 50 THEN 5 WHEN c <= 100 THEN 6 ELSE 7 END AS tier FROM q WHERE c <= 200),
    best AS (SELECT s_suppkey, arg_min(value, (tier, d2, lat_idx, lon_idx)) AS value, arg_min(d2, (tier, d2, lat_idx, lon_idx)) AS d2 FROM t GROUP BY s_suppkey)"""


def tiered(spark, d) -> DataFrame:
    n = grid_height(spark, d)
    x, y = geo.grid_plan(F.col("lon_pos"), 50), geo.grid_plan(F.col("lat_pos"), n)
    return sampling.nearest_tiered(points(spark, d, n).select("s_suppkey", y["nearest"].alias("row"), x["nearest"].alias("col")), grid(spark, d), "s_suppkey")


@query(TIERED + " SELECT s_suppkey, value, round(sqrt(d2), 6) AS distance FROM best")
def nearest_valid_tiered(spark, d):
    return rounded(tiered(spark, d))


@query(TIERED + " SELECT s_suppkey, 'dem_elev_m' AS feature, round(sqrt(d2), 6) AS fallback_distance_pixels, d2 > 0 AS used_fallback, value IS NULL AS missing_after_fallback FROM best")
def station_fallback_audit(spark, d):
    return rounded(sampling.fallback_audit(tiered(spark, d), "s_suppkey", "dem_elev_m"))


@query(f"""WITH {GRID}, z AS (SELECT lat_idx // 5 AS "row", lon_idx // 5 AS col, avg(value) AS m, max(value) - min(value) AS r, avg(value * value) AS q FROM grid GROUP BY ALL)
    SELECT "row", col, round(m, 4) AS dem_elev_m, round(r, 4) AS dem_relief_1km, round(sqrt(greatest(q - m * m, 0)), 4) AS dem_std_1km FROM z""")
def terrain_cell_stats(spark, d):
    g = grid(spark, d).withColumns({"row": F.expr("cast(lat_idx div 5 as int)"), "col": F.expr("cast(lon_idx div 5 as int)")})
    return rounded(sampling.zonal_terrain(g, ["row", "col"]), 4)


@query(f"""WITH {GRID} SELECT lat_idx // 4 AS "row", lon_idx // 10 AS col, round(avg(value), 6) AS value FROM grid GROUP BY ALL""")
def average_resampling(spark, d):
    g = grid(spark, d).select(F.col("lat_idx").alias("row"), F.col("lon_idx").alias("col"), "value")
    return rounded(sampling.average_to_coarse(g, 4, 10))


GRID_MONTH = f"""WITH m AS (SELECT 'prec' AS variable, CAST(0 AS INTEGER) AS "row", CAST(n_nationkey AS INTEGER) AS col FROM nation),
    li AS (SELECT s_nationkey AS k, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t, sum(l_quantity) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    g AS (SELECT variable, "row", col, CAST(r.t AS INTEGER) AS t, li.value FROM m, range(0, 83) r(t) LEFT JOIN li ON li.k = m.col AND li.t = r.t),
    h AS (SELECT *, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2, CASE WHEN count(value) OVER f = 3 THEN avg(value) OVER f END AS value_roll3_mean, CASE WHEN count(value) OVER f = 3 THEN sum(value) OVER f END AS value_roll3_sum
        FROM g WINDOW w AS (PARTITION BY col ORDER BY t), f AS (PARTITION BY col ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT variable, "row", col, t, value, value_lag1, value_lag2, {", ".join(f"round({c}, 4) AS {c}" for c in ("value_roll3_mean", "value_roll3_sum"))},
    {", ".join(f"round(avg({c}) OVER (PARTITION BY col, t % 12), 4) AS clim_{c}, round({c} - avg({c}) OVER (PARTITION BY col, t % 12), 4) AS anom_{c}" for c in ("value", "value_roll3_mean", "value_roll3_sum"))} FROM h"""


@query(GRID_MONTH)
def grid_month_features(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    t = (calendars.month_index(F.year("l_shipdate"), F.month("l_shipdate")) - 1995 * 12).cast("int")
    values = li.groupBy(F.col("s_nationkey").alias("col"), t.alias("t")).agg(F.sum("l_quantity").alias("value"))
    cells = table(spark, d, "nation").select(F.lit("prec").alias("variable"), F.lit(0).alias("row"), F.col("n_nationkey").alias("col"), F.explode(F.sequence(F.lit(0), F.lit(82))).alias("t"))
    return rounded(climatology.grid_month_features(cells.join(values, ["col", "t"], "left"), 3), 4)


# --- geography and folds ---------------------------------------------------------------------------


@query(f"WITH {COORDS} SELECT a.station_id, round(min({HAVERSINE}), 4) AS nearest_training_station_km FROM coords a, coords b WHERE a.is_test AND NOT b.is_test GROUP BY a.station_id")
def haversine_nearest(spark, d):
    c = coords(spark, d)
    out = folds.nearest_station(c.where("is_test").drop("is_test"), c.where("NOT is_test").drop("is_test"))
    return rounded(out.select("station_id", "nearest_training_station_km"), 4)


@query(f"WITH {COORDS} SELECT a.station_id FROM coords a WHERE NOT a.is_test AND NOT EXISTS (SELECT 1 FROM coords b WHERE b.is_test AND {HAVERSINE} < 300)")
def distance_buffer_anti(spark, d):
    c = coords(spark, d)
    return folds.distance_buffer(c.where("NOT is_test"), c.where("is_test"), 300).select("station_id")


@query(f"""WITH {COORDS}, xy AS (SELECT station_id, (lon - 105) * 91000 AS x_m, (lat - 35) * 111000 AS y_m FROM coords)
    SELECT station_id, CAST(floor((x_m - min(x_m) OVER ()) / 200000) AS INTEGER) AS block_x, CAST(floor((y_m - min(y_m) OVER ()) / 200000) AS INTEGER) AS block_y,
    concat(CAST(floor((x_m - min(x_m) OVER ()) / 200000) AS INTEGER), '_', CAST(floor((y_m - min(y_m) OVER ()) / 200000) AS INTEGER)) AS spatial_block FROM xy""")
def spatial_blocks(spark, d):
    c = coords(spark, d).withColumns({"x_m": (F.col("lon") - 105) * 91000, "y_m": (F.col("lat") - 35) * 111000})
    return folds.spatial_blocks(c, 200, projected=False).select("station_id", "block_x", "block_y", "spatial_block")


ALBERS = """WITH {coords}, k AS (SELECT 6378137.0::DOUBLE AS a, sqrt((1/298.257223563::DOUBLE) * (2 - 1/298.257223563::DOUBLE)) AS e),
    p AS (SELECT a, e, cos(radians(25)) / sqrt(1 - e*e*pow(sin(radians(25)),2)) AS m1, cos(radians(47)) / sqrt(1 - e*e*pow(sin(radians(47)),2)) AS m2,
        {q25} AS q1, {q47} AS q2, {q35} AS q0 FROM k),
    c AS (SELECT *, (m1*m1 - m2*m2) / (q2 - q1) AS n FROM p), r AS (SELECT *, m1*m1 + n*q1 AS cc FROM c),
    o AS (SELECT *, a * sqrt(cc - n*q0) / n AS rho0 FROM r),
    s AS (SELECT station_id, lon, a, n, cc, rho0, a * sqrt(cc - n * ({qlat})) / n AS rho FROM coords, o)
    SELECT station_id, round(rho * sin(n * radians(lon - 105)), 2) AS x_m, round(rho0 - rho * cos(n * radians(lon - 105)), 2) AS y_m FROM s"""


def _q(lat: str) -> str:
    s = f"sin(radians({lat}))"
    return f"(1 - e*e) * ({s} / (1 - e*e*{s}*{s}) - ln((1 - e*{s}) / (1 + e*{s})) / (2*e))"


@query(ALBERS.format(coords=COORDS, q25=_q("25"), q47=_q("47"), q35=_q("35"), qlat=_q("lat")))
def albers_projection(spark, d):
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    return rounded(coords(spark, d).select("station_id", x.alias("x_m"), y.alias("y_m")), 2)


#: The greedy split in SQL: groups g (name, n) from large to small, each to the lightest of five folds.
GREEDY = """ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS i FROM g),
    loaded AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS name, CAST(0 AS BIGINT) AS n, CAST(0 AS INTEGER) AS fold, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS loads
        UNION ALL SELECT r.i, r.name, r.n, CAST(list_position(l.loads, list_min(l.loads)) AS INTEGER), list_transform(range(1, 6), lambda k: l.loads[k] + CASE WHEN k = list_position(l.loads, list_min(l.loads)) THEN r.n ELSE 0 END)
        FROM loaded l JOIN ranked r ON r.i = l.i + 1)"""


PROJECTED = ALBERS.format(coords=COORDS, q25=_q("25"), q47=_q("47"), q35=_q("35"), qlat=_q("lat")).rpartition("\n    SELECT")[0].replace("WITH ", "WITH RECURSIVE ", 1)


@query(PROJECTED + f""", xy AS (SELECT station_id, rho * sin(n * radians(lon - 105)) AS x_m, rho0 - rho * cos(n * radians(lon - 105)) AS y_m FROM s),
    b AS (SELECT station_id, concat(CAST(floor((x_m - min(x_m) OVER ()) / 400000) AS INTEGER), '_', CAST(floor((y_m - min(y_m) OVER ()) / 400000) AS INTEGER)) AS spatial_block FROM xy),
    g AS (SELECT spatial_block AS name, count(*) AS n FROM b GROUP BY ALL), {GREEDY} SELECT station_id, spatial_block, loaded.fold FROM b JOIN loaded ON name = spatial_block""")
def spatial_fold_assignment(spark, d):
    return folds.spatial_folds(coords(spark, d).drop("is_test"), 5, 400).select("station_id", "spatial_block", "fold")


@query(f"WITH {SM}, t AS (SELECT count(*) AS n FROM sm) SELECT CAST(k + 1 AS INTEGER) AS fold, CAST(ceil(n * (k + 1) / 5.0) - ceil(n * k / 5.0) AS BIGINT) AS n FROM t, range(5) r(k)")
def random_folds(spark, d):
    return folds.random_folds(supplier_month(spark, d), ["station_id", "year", "month"]).groupBy("fold").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {SM}, g AS (SELECT station_id AS name, count(*) AS n FROM sm GROUP BY ALL), {GREEDY} SELECT name AS station_id, n, fold FROM loaded WHERE i > 0")
def grouped_folds(spark, d):
    return folds.grouped_folds(supplier_month(spark, d), "station_id")


@query(f"""WITH {SM}, s AS (SELECT *, CASE WHEN year < 1999 THEN 'train' ELSE 'test' END AS side FROM sm WHERE year <= 2001)
    SELECT side, count(*) AS n_samples, count(DISTINCT station_id) AS n_stations, min(year) AS first_year, max(year) AS last_year FROM s GROUP BY side""")
def split_counts(spark, d):
    train, test = folds.period_split(supplier_month(spark, d), 1999, 2001)
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.groupBy("side").agg(F.count("*").alias("n_samples"), F.count_distinct("station_id").alias("n_stations"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS station_id, count(DISTINCT s_nationkey) AS n_coordinates FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL")
def coordinate_check(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = li.select(F.col("s_suppkey").cast("string").alias("station_id"), F.col("s_nationkey").cast("double").alias("lon"), F.col("s_nationkey").cast("double").alias("lat"))
    return folds.station_coordinates(rows).groupBy("station_id").agg(F.count("*").alias("n_coordinates"))


# --- scores ----------------------------------------------------------------------------------------


@query(f"WITH {OOF} SELECT timescale, fold, count(*) AS n, {scores_sql('pred', 'obs', True)} FROM oof GROUP BY ALL")
def fold_metrics(spark, d):
    return rounded(metrics.regression_metrics(oof(spark, d), ["timescale", "fold"]))


NAMES = ("R2", "RMSE", "MAE", "Bias", "Pearson_r")


@query(f"""WITH {OOF}, f AS (SELECT timescale, fold, {scores_sql('pred', 'obs', True, 15)} FROM oof GROUP BY ALL), p AS (SELECT timescale, count(*) AS n_pooled, {scores_sql('pred', 'obs', True, 6)} FROM oof GROUP BY ALL),
    g AS (SELECT timescale, count(*) AS n_folds, {", ".join(f"round(avg({n}), 6) AS {n}_mean, round(stddev_samp({n}), 6) AS {n}_std" for n in NAMES)} FROM f GROUP BY ALL)
    SELECT g.*, n_pooled, {", ".join(f"{n} AS {n}_pooled" for n in NAMES)} FROM g JOIN p USING (timescale)""")
def fold_summary_pooled(spark, d):
    return rounded(metrics.fold_summary(oof(spark, d)))


@query(f"""WITH {OOF}, f AS (SELECT timescale, fold, {scores_sql('pred', 'obs', True, 15)} FROM oof GROUP BY ALL)
    SELECT timescale, count(*) AS n_folds, {", ".join(f"round(avg({n}), 6) AS {n}_mean, round(stddev_samp({n}), 6) AS {n}_std" for n in NAMES)} FROM f GROUP BY ALL""")
def fold_summary_unpooled(spark, d):
    return rounded(metrics.fold_summary(oof(spark, d), pooled=False))


def detection_sql(keys: str) -> str:
    return f"""WITH {OOF}, c AS (SELECT {keys}, threshold, count(*) FILTER (WHERE obs <= threshold AND pred <= threshold) AS TP, count(*) FILTER (WHERE obs > threshold AND pred <= threshold) AS FP,
        count(*) FILTER (WHERE obs <= threshold AND pred > threshold) AS FN, count(*) FILTER (WHERE obs > threshold AND pred > threshold) AS TN
        FROM oof, (VALUES (CAST(-1.0 AS DOUBLE)), (CAST(-1.5 AS DOUBLE)), (CAST(-2.0 AS DOUBLE))) t(threshold) GROUP BY ALL),
    r AS (SELECT *, TP / nullif(TP + FP, 0) AS p, TP / nullif(TP + FN, 0) AS q FROM c),
    s AS (SELECT {keys}, threshold, TP, FP, FN, TN, TP + FP + FN + TN AS n_samples, TP + FN AS n_drought_obs, TP + FP AS n_drought_pred, round_even(p, 4) AS "Precision", round_even(q, 4) AS Recall,
        round_even(2 * p * q / nullif(p + q, 0), 4) AS F1, round_even(FP / nullif(TP + FP, 0), 4) AS FAR, round_even(TP / nullif(TP + FP + FN, 0), 4) AS CSI, round_even((TP + TN) / nullif(TP + FP + FN + TN, 0), 4) AS Accuracy FROM r)"""


LEVEL_SQL = "CASE threshold WHEN -1.0 THEN 'moderate_or_worse' WHEN -1.5 THEN 'severe_or_worse' ELSE 'extreme' END AS drought_level"


def detection(spark, d, keys):
    return metrics.detection_scores(metrics.detection_counts(oof(spark, d), keys)).withColumn("drought_level", metrics.level_name(F.col("threshold")))


@query(detection_sql("timescale") + f" SELECT *, {LEVEL_SQL} FROM s")
def detection_by_threshold(spark, d):
    return detection(spark, d, ["timescale"]).orderBy(metrics.ordered_scales(F.col("timescale")), F.desc("threshold"))


@query(detection_sql("timescale, fold") + f" SELECT *, {LEVEL_SQL} FROM s")
def detection_by_fold(spark, d):
    return detection(spark, d, ["timescale", "fold"])


@query(detection_sql("timescale") + """ SELECT timescale, max(CSI) FILTER (WHERE threshold = -1.0) AS csi_1_0, max(CSI) FILTER (WHERE threshold = -1.5) AS csi_1_5, max(CSI) FILTER (WHERE threshold = -2.0) AS csi_2_0 FROM s GROUP BY timescale""")
def detection_pivot(spark, d):
    wide = detection(spark, d, ["timescale"]).groupBy("timescale").pivot("threshold", [-1.0, -1.5, -2.0]).agg(F.first("CSI"))
    return wide.toDF("timescale", "csi_1_0", "csi_1_5", "csi_2_0")


@query(f"WITH {PAIRS} SELECT product, count(*) AS n, {scores_sql('ours', 'ref')} FROM pairs GROUP BY ALL")
def pair_metrics_global(spark, d):
    return rounded(consistency.agreement(consistency.partial_sums(pairs(spark, d), ["product"]), ["product"]))


@query(f"WITH {PAIRS} SELECT product, region_id, count(*) AS n, {scores_sql('ours', 'ref')} FROM pairs WHERE region_id > 0 GROUP BY ALL")
def pair_metrics_region(spark, d):
    return rounded(consistency.by_region(pairs(spark, d), ["product"]))


@query(f"""WITH {PAIRS}, m AS (SELECT product, month, "row", col, sum(ours) AS ours, sum(ref) AS ref FROM pairs GROUP BY ALL), s AS (SELECT product, "row", col, count(*) AS n,
    count(*) * sum(ours * ref) - sum(ours) * sum(ref) AS num, count(*) * sum(ours * ours) - sum(ours) * sum(ours) AS vx, count(*) * sum(ref * ref) - sum(ref) * sum(ref) AS vy FROM m GROUP BY ALL)
    SELECT product, "row", col, n, CASE WHEN n >= 3 AND vx > 0 AND vy > 0 THEN round(num / sqrt(vx * vy), 6) END AS r FROM s""")
def pair_metrics_pixel(spark, d):
    months = pairs(spark, d).groupBy("product", "month", "row", "col").agg(F.sum("ours").alias("ours"), F.sum("ref").alias("ref"))
    keys = ["product", "row", "col"]
    return rounded(consistency.pixel_correlation(consistency.partial_sums(months, keys), keys))


@query(f"WITH {PAIRS} SELECT product, month, count(*) AS n, round(avg(ours), 6) AS ours_mean, round(avg(ref), 6) AS ref_mean FROM pairs GROUP BY ALL")
def pair_metrics_monthly(spark, d):
    return rounded(consistency.monthly_means(pairs(spark, d), ["product", "month"]))


@query(f"""WITH {PAIRS} SELECT product, count(*) AS n, {scores_sql('ours', 'ref')}, min(month) AS first_month, max(month) AS last_month, count(DISTINCT month) AS n_months, count(DISTINCT ("row", col)) AS n_valid_pixels FROM pairs GROUP BY ALL""")
def pair_summary(spark, d):
    return rounded(consistency.summary(pairs(spark, d), ["product"]))


@query(f"WITH {PAIRS} SELECT product, count(*) AS n, {scores_sql('ours', 'ref')} FROM pairs GROUP BY ALL")
def pair_metrics_merged(spark, d):
    """From sums by month, as a resumed run has them."""
    by_month = consistency.partial_sums(pairs(spark, d), ["product", "month"])
    return rounded(consistency.agreement(consistency.merged(by_month, ["product"]), ["product"]))


# --- release and months ----------------------------------------------------------------------------


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders INTERSECT SELECT DISTINCT strftime(l_shipdate, '%Y-%m') FROM lineitem")
def common_months(spark, d):
    a = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return consistency.common_months(a, table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month")))


@query(f"""WITH {SM}, o AS (SELECT DISTINCT station_id, printf('%04d-%02d', year, month) AS month FROM sm), e AS (SELECT station_id, strftime(m, '%Y-%m') AS month FROM (SELECT DISTINCT station_id FROM sm), generate_series(DATE '1995-02-01', DATE '2002-01-01', INTERVAL 1 MONTH) g(m))
    SELECT *, 'missing' AS status FROM (FROM e EXCEPT FROM o) UNION ALL SELECT *, 'extra' FROM (FROM o EXCEPT FROM e)""")
def coverage_missing_extra(spark, d):
    seen = supplier_month(spark, d).select("station_id", F.format_string("%04d-%02d", "year", "month").alias("month"))
    months = calendars.month_range(spark, "1995-02", "2002-01").select("month")
    expected = seen.select("station_id").distinct().crossJoin(F.broadcast(months))  # 84 months
    return release.coverage(expected, seen, ["station_id", "month"])


def stand_in_inventory(spark, d) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("n_regionkey").alias("timescale"), (F.col("s_suppkey") * 1000003 + 7).alias("size_bytes"), (F.col("s_suppkey") % 2).alias("width"), F.lit("x").alias("crs"), F.when(F.col("s_suppkey") % 3 > 0, "bilinear").alias("cmfd_spatial_method"))


INVENTORY = "inv AS (SELECT n_regionkey AS timescale, s_suppkey * 1000003 + 7 AS size_bytes, s_suppkey % 2 AS width, CASE WHEN s_suppkey % 3 > 0 THEN 'bilinear' END AS method FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query(f"""WITH {INVENTORY} SELECT timescale, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes, round_even(sum(size_bytes) / 1073741824.0::DOUBLE, 3) AS total_size_gib, count(DISTINCT width) AS n_geometries,
    bool_or(method IS DISTINCT FROM 'bilinear') AS cmfd_spatial_method_differs FROM inv GROUP BY timescale""")
def inventory_consistency(spark, d):
    inv = stand_in_inventory(spark, d)
    return release.totals(inv, ["timescale"]).join(release.geometry_counts(inv, ["timescale"]), "timescale").join(release.tag_faults(inv, ["timescale"], {"cmfd_spatial_method": "bilinear"}), "timescale")


@query("""WITH l AS (SELECT s_name AS archive_name, s_suppkey AS size_bytes FROM supplier), m AS (SELECT s_name AS archive_name, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey + 1 ELSE s_suppkey END AS size_bytes, sha256(s_name) AS sha256 FROM supplier WHERE s_suppkey % 3 > 0)
    SELECT l.archive_name, l.size_bytes, m.sha256 FROM l LEFT JOIN m USING (archive_name, size_bytes)""")
def manifest_reuse(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    old = s.where(k % 3 > 0).select(F.col("s_name").alias("archive_name"), F.when(k % 4 == 0, k + 1).otherwise(k).alias("size_bytes"), F.sha2("s_name", 256).alias("sha256"))
    return release.reuse_checksums(s.select(F.col("s_name").alias("archive_name"), k.alias("size_bytes")), old).select("archive_name", "size_bytes", "sha256")


@query("SELECT strftime(m, '%Y-%m') AS month, CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month_of_year, CAST((year(m) - 1979) * 12 + month(m) AS INTEGER) AS band FROM generate_series(DATE '1979-03-01', DATE '2018-12-01', INTERVAL 1 MONTH) g(m)")
def month_bands(spark, d):
    return calendars.month_range(spark, "1979-03", "2018-12").select("month", "year", "month_of_year", calendars.band_of_month(F.col("month")).alias("band"))


@query("""WITH m AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS month FROM lineitem)
    SELECT month, CAST((CAST(substr(month, 1, 4) AS INTEGER) - 1992) * 12 + CAST(substr(month, 6, 2) AS INTEGER) AS INTEGER) AS band, count(l_orderkey) AS n FROM m JOIN lineitem ON strftime(l_shipdate, '%Y-%m') = month GROUP BY ALL""")
def bands_of_rows(spark, d):
    """The band of each month that the line items have, in a stack that begins in 1992, and how many they are."""
    rows = table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count("l_orderkey").alias("n"))
    return rows.select("month", calendars.band_of_month(F.col("month"), "1992-01").alias("band"), "n")


@query(f"""WITH {SM}, m AS (SELECT strftime(t, '%Y-%m') AS month, CAST((year(t) - 1994) * 12 + month(t) - 1 AS INTEGER) AS position FROM generate_series(DATE '1994-01-01', DATE '1996-12-01', INTERVAL 1 MONTH) g(t)),
    own AS (SELECT station_id, printf('%d-%02d', year, month) AS month FROM sm)
    SELECT station_id, count(*) FILTER (WHERE own.month IS NULL) AS missing, min(m.month) FILTER (WHERE own.month IS NULL) AS first_missing FROM (SELECT DISTINCT station_id FROM own) s CROSS JOIN m LEFT JOIN own USING (station_id, month) WHERE position >= 11 GROUP BY ALL""")
def missing_target_months(spark, d):
    """Of the months with a complete window of twelve, those that a station has no row for."""
    own = supplier_month(spark, d).select("station_id", F.format_string("%d-%02d", "year", "month").alias("month"), F.lit(1).alias("has"))
    wanted = calendars.target_months(spark, 12, "1994-01", end="1996-12").select("month")
    every = own.select("station_id").distinct().join(F.broadcast(wanted))  # 25 rows
    met = every.join(own, ["station_id", "month"], "left")
    return met.groupBy("station_id").agg(F.count_if(F.col("has").isNull()).alias("missing"), F.min(F.when(F.col("has").isNull(), F.col("month"))).alias("first_missing"))


# --- model and plot data ---------------------------------------------------------------------------


@query("""SELECT quantile_cont(l_quantity, 0.5) AS l_quantity, quantile_cont(l_extendedprice, 0.5) AS l_extendedprice, quantile_cont(CASE WHEN l_linenumber > 3 THEN l_discount END, 0.5) AS l_discount FROM lineitem""")
def median_impute(spark, d):
    li = table(spark, d, "lineitem").withColumn("l_discount", F.when(F.col("l_linenumber") > 3, F.col("l_discount")))
    found = model.medians(li, ["l_quantity", "l_extendedprice", "l_discount"])
    return model.impute(spark.createDataFrame([(None, None, None)], "l_quantity double, l_extendedprice double, l_discount double"), found)


@query("SELECT CAST(floor(l_quantity / 5) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def feature_histogram(spark, d):
    return table(spark, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 5).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT CAST(floor(l_quantity / 5) AS INTEGER) AS bin_x, CAST(floor(l_extendedprice / 10000) AS INTEGER) AS bin_y, count(*) AS n FROM lineitem GROUP BY ALL")
def hexbin_counts(spark, d):
    return table(spark, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 5).cast("int").alias("bin_x"), F.floor(F.col("l_extendedprice") / 10000).cast("int").alias("bin_y")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS timescale, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY ALL")
def boxplot_quartiles(spark, d):
    rows = table(spark, d, "lineitem").withColumn("timescale", F.col("l_returnflag"))
    return model.quantiles(rows, ["timescale"], "l_quantity", {"q1": 0.25, "median": 0.5, "q3": 0.75})


@query("""WITH n AS (SELECT n_nationkey + 1 AS region_id, n_nationkey % 5 * 8 + 1 AS x, n_nationkey // 5 * 8 + 1 AS y, 5 + n_nationkey % 3 AS s FROM nation), c AS (SELECT CAST(i AS INTEGER) AS i FROM range(44) r(i))
    SELECT b.i AS "row", a.i AS col, max(region_id) AS region_id FROM c a, c b, n WHERE a.i + 0.5 > x AND a.i + 0.5 < x + s AND 44 - (b.i + 0.5) > y AND 44 - (b.i + 0.5) < y + s GROUP BY ALL""")
def region_raster(spark, d):
    """Squares around nations' places, rasterised; later squares win."""
    n = F.col("n_nationkey").cast("double")
    x, y, s = n % 5 * 8 + 1, F.floor(n / 5) * 8 + 1, 5 + n % 3
    point = lambda a, b: F.array(a, b)
    shapes = table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("region_id"), F.array(F.array(point(x, y), point(x + s, y), point(x + s, y + s), point(x, y + s))).alias("rings"))
    return regions.rasterize(regions.ring_edges(shapes), 0.0, 44.0, 1.0, -1.0, 44, 44)


@query()
def gbt_predict(spark, d):
    """Rows of later years predicted by all trees of `model.PARAMS`, fitted to all rows before."""
    rows = settled(history(spark, d).withColumn("spei", F.col("dyn_prec") / 100))
    train, test = folds.period_split(rows, 2000, 2001)
    fitted = model.fit(train, params={"minInstancesPerNode": 5})
    return fitted.predict(test, ["station_id", "year", "month"])


# --- names, bands and resumption -------------------------------------------------------------------


@query("""WITH f AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN printf('/d/spei_%02dmo_%d-%02d.tif', s_suppkey % 24 + 1, 1979 + s_suppkey % 40, s_suppkey % 12 + 1) ELSE printf('/d/Prod_spei%02d_%d-%02d.tif', s_suppkey % 24 + 1, 1979 + s_suppkey % 40, s_suppkey % 12 + 1) END AS path, * FROM supplier)
    SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'own' ELSE 'prod' END AS product, CAST(s_suppkey % 24 + 1 AS INTEGER) AS scale, printf('%d-%02d', 1979 + s_suppkey % 40, s_suppkey % 12 + 1) AS month, path FROM f""")
def product_catalog(spark, d):
    from ..sources import files

    k = F.col("s_suppkey")
    scale, year, month = k % 24 + 1, 1979 + k % 40, k % 12 + 1
    path = F.when(k % 3 == 0, F.format_string("/d/spei_%02dmo_%d-%02d.tif", scale, year, month)).otherwise(F.format_string("/d/Prod_spei%02d_%d-%02d.tif", scale, year, month))
    listed = table(spark, d, "supplier").select(path.alias("path"))
    own = files.own_months(listed).select(F.lit("own").alias("product"), "scale", "month", "path")
    return own.unionByName(files.products(listed))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 3 THEN NULL ELSE round(l_quantity * CAST(0.0001 AS DOUBLE), 6) END AS value FROM lineitem")
def scaled_bands(spark, d):
    from ..sources import raster

    band = F.when(F.col("l_linenumber") == 3, F.lit(-99999.0)).otherwise(F.col("l_quantity"))
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raster.scaled(band).alias("value")))


@query("SELECT CAST(s_nationkey AS VARCHAR) AS product, s_suppkey AS timescale FROM supplier WHERE s_suppkey % 4 <> 0")
def resume_remaining(spark, d):
    catalog = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("product"), F.col("s_suppkey").alias("timescale"))
    return consistency.remaining(catalog, catalog.where("timescale % 4 = 0"))


@query("""WITH g AS (SELECT CAST(p_partkey // 50 AS INTEGER) AS "row", CAST(p_partkey % 50 AS INTEGER) AS col FROM part) SELECT "row", col, -2600000 + (col + CAST(0.5 AS DOUBLE)) * 1000 AS x, 5900000 - ("row" + CAST(0.5 AS DOUBLE)) * 1000 AS y FROM g""")
def cell_centres(spark, d):
    cells = grid(spark, d).select(F.col("lat_idx").alias("row"), F.col("lon_idx").alias("col"))
    x, y = regions.cell_centre(F.col("row"), F.col("col"), 1000.0, 0.0, -2600000.0, 0.0, -1000.0, 5900000.0)
    return cells.select("row", "col", x.alias("x"), y.alias("y"))


@query(f"""WITH {PAIRS}, a AS (SELECT "row", col, month, sum(ours) AS ours FROM pairs GROUP BY ALL), b AS (SELECT "row", col, month, sum(ref) AS ref FROM pairs WHERE region_id % 2 = 0 GROUP BY ALL),
    pairs2 AS (SELECT a.month, ours, ref FROM a JOIN b USING ("row", col, month) WHERE col % 3 > 0)
    SELECT month, count(*) AS n, {scores_sql("ours", "ref", digits=3)} FROM pairs2 GROUP BY ALL""")
def mainland_pairs(spark, d):
    """Two rasters by month joined where both have a value and the mainland has a pixel."""
    p, keys = pairs(spark, d), ["row", "col", "month"]
    ours = p.groupBy(*keys).agg(F.sum("ours").alias("value"))
    ref = p.where("region_id % 2 = 0").groupBy(*keys).agg(F.sum("ref").alias("value"))
    mainland = p.select("row", "col").where("col % 3 > 0").distinct()
    found = consistency.agreement(consistency.partial_sums(consistency.valid_pairs(ours, ref, keys, mainland), ["month"]), ["month"])
    # Means of tenths by 64 pairs end in a five: what sums in another order left of it goes first.
    return rounded(rounded(found, 9), 3)


@query("SELECT strftime(m, '%Y-%m') AS month, CAST((year(m) - 1979) * 12 + month(m) - 1 AS INTEGER) AS position FROM generate_series(DATE '1980-12-01', DATE '2018-12-01', INTERVAL 1 MONTH) g(m)")
def target_months(spark, d):
    return calendars.target_months(spark, 24).select("month", "position")


@query("SELECT l_returnflag AS k, count(*) AS n_rows, count(*) FILTER (WHERE l_linenumber > 2 AND l_quantity > 0) AS n_valid FROM lineitem GROUP BY ALL")
def nan_boundary(spark, d):
    """NaN, infinities and null count alike as missing."""
    bad = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(F.col("l_linenumber") == 2, F.lit(float("inf"))).otherwise(F.col("l_quantity"))
    from ..functions.clean import finite

    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.count("*").alias("n_rows"), F.count(finite(bad)).alias("n_valid"))


@query()
def forward_validation(spark, d):
    rows = history(spark, d).withColumn("spei", F.col("dyn_prec") / 100).drop("dyn_temp", "dyn_temp_lag1", "dyn_temp_lag2", "dyn_temp_roll3_mean")
    # Station-months that every training period has, so each test value has a climatology.
    seen = rows.where("year < 1999").select("station_id", "month").distinct()
    rows = rows.join(seen, ["station_id", "month"], "left_semi")
    _, each, _ = model.validate_periods(rows, "SPEI-3", 3, periods=((1999, 1999), (2000, 2000)), params={"maxIter": 3, "minInstancesPerNode": 5})
    return each


@query(f"""WITH {COORDS}, a AS (SELECT station_id, lon, lat, radians(lat) AS phi, radians(lon - 30) AS d FROM coords),
    b AS (SELECT *, list_reduce(list_prepend(2 * phi, list_transform(range(25), lambda i: CAST(0 AS DOUBLE))), lambda u, k: u - (u + sin(u) - pi() * sin(phi)) / greatest(1 + cos(u), 1e-12)) / 2 AS t, abs(phi) <= {geo.GOODE_SPLIT!r}::DOUBLE AS low FROM a)
    SELECT station_id, round({geo.GOODE_RADIUS!r}::DOUBLE * (radians(30) + CASE WHEN low THEN d * cos(phi) ELSE 2 * sqrt(2) / pi() * d * cos(t) END), 2) AS x,
    round({geo.GOODE_RADIUS!r}::DOUBLE * CASE WHEN low THEN phi ELSE sqrt(2) * sin(t) - {geo.GOODE_SHIFT!r}::DOUBLE * sign(phi) END, 2) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM b""")
def homolosine_projection(spark, d):
    x, y = geo.goode(F.col("lon"), F.col("lat"))
    lon, lat = geo.goode_to_lonlat(F.col("x"), F.col("y"))
    rows = coords(spark, d).withColumn("x", x).withColumn("y", y)
    return rounded(rows.select("station_id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), lon.alias("lon"), lat.alias("lat")))
