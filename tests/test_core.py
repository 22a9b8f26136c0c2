"""Semantics by hand-made cases: calendars, labels, windows, sampling, folds, scores, release checks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from drywell.functions import calendars, clean, geo, metrics
from drywell.operators import climatology, consistency, features, folds, labels, model, regions, release, sampling

DAILY = "station_id string, scale int, year int, doy int, spei double, line int"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_bilinear_leaves_out_missing_corners(spark):
    grid = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 5.0), (1, 1, float("nan"))], "lat_idx int, lon_idx int, value double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, -3.0, -1.0), (3, 9.0, 9.0)], "id int, lon_pos double, lat_pos double")
    corners = sampling.corner_weights(points, 2, 2)
    got = {r["id"]: r["value"] for r in sampling.bilinear(corners, grid, "id").collect()}
    assert got == {1: 3.0, 2: 1.0, 3: None}  # outside clamps to the edge
    filled = sampling.fill_nearest(grid)
    assert {r["id"]: r["value"] for r in sampling.bilinear(corners, grid, "id", fallback=filled).collect()}[3] == 3.0


def test_precipitation_totals(spark):
    rows = spark.sql("SELECT date'2001-01-01' d UNION ALL SELECT date'2001-02-01'")
    assert sorted(r[0] for r in rows.select(calendars.monthly_total(F.lit(1.0), F.col("d"), "prec")).collect()) == [672.0, 744.0]
    assert rows.select(calendars.monthly_total(F.lit(1.0), F.col("d"), "temp")).distinct().collect() == [(1.0,)]


def test_strict_no_leap_month_end(spark):
    daily = spark.createDataFrame([("001", 1, 2000, 58, -0.2, 1), ("001", 1, 2000, 59, -0.5, 2), ("001", 1, 2000, 60, 0.3, 3)], DAILY)
    own, audit, summary = labels.extract_labels(daily, ties=["line"])
    feb = one(own.where("month = 2"))
    assert (feb["source_date"], feb["spei"], feb["month_end_date"], feb["station_id"]) == ("2000-02-28", -0.5, "2000-02-28", "001")
    assert one(audit.where("month = 2"))["has_month_end_record"] is True
    march = one(own.where("month = 3"))
    assert march["spei"] is None and march["source_date"] == ""
    assert one(summary)["n_valid_strict_labels"] == 1


def test_duplicates_and_invalid_dates(spark):
    rows = [("a", 1, 2001, 31, 1.0, 1), ("a", 1, 2001, 31, 2.0, 2), ("a", 1, 2001, 0, 9.0, 3), ("a", 1, 2001, 366, 9.0, 4), ("a", 1, None, 5, 9.0, 5), ("a", 1, 2000, 366, 7.0, 6)]
    audit = labels.month_audit(spark.createDataFrame(rows, DAILY), "noleap_365", ["line"])
    r = one(audit)
    assert (r["strict_month_end_spei"], r["n_daily_records"], r["n_duplicate_date_rows"], r["invalid_date_rows_in_file"]) == (2.0, 2, 2, 4)
    greg = labels.month_audit(spark.createDataFrame(rows, DAILY), "gregorian", ["line"])
    assert one(greg.where("year = 2000"))["expected_month_end"] == "2000-12-31"
    assert one(greg.where("year = 2001"))["invalid_date_rows_in_file"] == 3
    empty = labels.month_audit(spark.createDataFrame([], DAILY), ties=["line"])
    assert empty.count() == 0
    with pytest.raises(ValueError):
        labels.labels_from_audit(audit, "other")
    with pytest.raises(ValueError):
        labels.month_audit(spark.createDataFrame(rows, DAILY), "other", ["line"])


def test_complete_windows(spark):
    df = spark.createDataFrame([("1", 1979, m, float(m)) for m in (1, 2, 3)], "station_id string, year int, month int, dyn_prec double")
    out = features.add_history(df, ["dyn_prec"], 3, 2)
    names = features.history_names(["dyn_prec"], 3, 2)
    rows = sorted(out.collect(), key=lambda r: r["month"])
    assert [any(r[n] is None for n in names) for r in rows] == [True, True, False]
    assert rows[2]["dyn_prec_roll3_sum"] == 6
    assert features.history_names(["dyn_t"], 1) == ["dyn_t_roll1_mean"]


def test_lags_are_by_position_and_nan_voids_windows(spark):
    df = spark.createDataFrame([("1", 2000, 1, 1.0), ("1", 2000, 3, float("nan")), ("1", 2000, 4, 3.0)], "station_id string, year int, month int, dyn_temp double")
    out = {r["month"]: r for r in features.add_history(clean.nan_to_null(df), ["dyn_temp"], 2).collect()}
    assert out[3]["dyn_temp_lag1"] == 1.0 and out[4]["dyn_temp_lag1"] is None and out[4]["dyn_temp_roll2_mean"] is None


def test_training_table_keeps_static_coordinates_and_checks_keys(spark):
    labels_ = spark.createDataFrame([("1", 2000, m, 1, 0.5, 99.0) for m in (1, 2)], "station_id string, year int, month int, scale int, spei double, lon double")
    dynamic = spark.createDataFrame([("1", 2000, m, 2.0) for m in (1, 2)], "station_id string, year int, month int, temp double")
    static = spark.createDataFrame([("1", 10.0)], "station_id string, lon double")
    rows = features.build_training(labels_, dynamic, static, 1).collect()
    assert len(rows) == 2 and {r["lon"] for r in rows} == {10.0}
    with pytest.raises(ValueError):
        features.build_training(labels_, dynamic.union(dynamic), static, 1)


def test_feature_lists(spark):
    df = spark.createDataFrame([("1", 0.1, 2000, 1.0, 2.0, 3.0, True)], "station_id string, spei double, year int, dyn_prec double, dem_elev_m double, soil_clay_0_5cm double, flag boolean")
    assert features.select_features(df) == ["year", "dyn_prec", "dem_elev_m", "flag"]
    assert features.select_features(df, drop_soil=False, drop_terrain=True) == ["year", "dyn_prec", "soil_clay_0_5cm", "flag"]
    with pytest.raises(ValueError):
        features.select_features(df.select("station_id"))
    assert [features.expected_feature_count(s) for s in (1, 3, 6, 12, 24)] == [54, 68, 89, 131, 215]
    wide = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 1.0)], "dyn_t double, dyn_t_lag1 double, dyn_t_roll3_mean double, dyn_t_roll6_mean double, dyn_lon double")
    assert climatology.anomaly_sources(wide, 3) == ["dyn_t", "dyn_t_roll3_mean"]


def test_train_climatology_guard(spark):
    train = spark.createDataFrame([("1", 2000, 1, 1.0), ("1", 2001, 1, 3.0)], "station_id string, year int, month int, dyn_t double")
    test = spark.createDataFrame([("1", 2002, 1, 5.0)], train.schema)
    a, b = climatology.train_period_anomalies(train, test, 3)
    assert one(b)["anom_dyn_t"] == 3.0 and a.count() == 2
    with pytest.raises(ValueError):
        climatology.train_period_anomalies(train, spark.createDataFrame([("1", 2002, 2, 5.0)], train.schema), 3)


def test_outer_merge_is_one_row_per_key(spark):
    keys = "station_id string, time date, year int, month int"
    a = spark.sql("SELECT '1' station_id, date'2000-01-01' time, 2000 year, 1 month, 1.5D prec")
    b = spark.sql("SELECT '1' station_id, date'2000-02-01' time, 2000 year, 2 month, 2.5D temp")
    got = features.combine_variables([a, b])
    assert got.count() == 2 and keys and {(r["prec"], r["temp"]) for r in got.collect()} == {(1.5, None), (None, 2.5)}


def test_detection_has_the_published_scores(spark):
    rows = []
    for k, (obs, pred, n) in enumerate(((-1, -1, 24436), (0, -1, 5535), (-1, 0, 7949), (0, 0, 167040))):
        rows.append((float(obs), float(pred), n))
    counts = spark.createDataFrame([("SPEI-1", -1.0, 24436, 5535, 7949, 167040)], "timescale string, threshold double, TP long, FP long, FN long, TN long")
    r = one(metrics.detection_scores(counts))
    assert (r["n_samples"], r["Precision"], r["Recall"], r["F1"], r["FAR"], r["CSI"], r["Accuracy"]) == (204960, 0.8153, 0.7545, 0.7838, 0.1847, 0.6444, 0.9342)
    none = one(metrics.detection_scores(spark.createDataFrame([("x", -1.0, 0, 0, 0, 5)], counts.schema)))
    assert none["Precision"] is None and none["F1"] is None and none["Accuracy"] == 1.0


def test_scores_without_a_value_are_null(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 1.0), ("b", 2.0, 3.0), ("c", float("nan"), 1.0), ("d", 1.0, None)], "k string, obs double, pred double")
    got = {r["k"]: r for r in metrics.regression_metrics(df, ["k"]).collect()}
    assert got["a"]["R2"] is None and got["a"]["Pearson_r"] is None and got["a"]["RMSE"] == 0
    assert got["b"]["R2"] is None and got["b"]["Bias"] == 0
    assert got["c"]["n"] == 0 and got["c"]["RMSE"] is None and got["d"]["n"] == 0


def test_fold_summary_of_one_fold_has_no_deviation(spark):
    df = spark.createDataFrame([("SPEI-1", 1, float(i), float(i) + 1) for i in range(4)], "timescale string, fold int, obs double, pred double")
    r = one(metrics.fold_summary(df))
    assert r["RMSE_std"] is None and r["RMSE_mean"] == r["RMSE_pooled"] == 1.0 and r["Bias_mean"] == 1.0


def test_pixel_correlation_needs_three_months(spark):
    rows = [("p", 0, 0, 1.0, 2.0), ("p", 0, 0, 2.0, 4.0), ("p", 0, 1, 1.0, 1.0), ("p", 0, 1, 2.0, 2.0), ("p", 0, 1, 3.0, 3.0), ("p", 0, 2, 5.0, 1.0), ("p", 0, 2, 5.0, 2.0), ("p", 0, 2, 5.0, 3.0)]
    pairs = spark.createDataFrame(rows, "product string, row int, col int, ours double, ref double")
    keys = ["product", "row", "col"]
    got = {r["col"]: (r["n"], r["r"]) for r in consistency.pixel_correlation(consistency.partial_sums(pairs, keys), keys).collect()}
    assert got[0] == (2, None) and got[1] == (3, pytest.approx(1.0)) and got[2] == (3, None)


def test_nearest_agrees_with_brute_force(spark):
    rng = random.Random(5)
    cells = [(r, c, float(r * 100 + c) if rng.random() < 0.04 else None) for r in range(40) for c in range(40)]
    grid = spark.createDataFrame(cells, "lat_idx int, lon_idx int, value double")
    valid = [x for x in cells if x[2] is not None]
    got = {(r["lat_idx"], r["lon_idx"]): r["filled"] for r in sampling.fill_nearest(grid).collect()}
    for r, c, v in cells:
        want = v if v is not None else min(((r - a) ** 2 + (c - b) ** 2, a, b, w) for a, b, w in valid)[3]
        assert got[r, c] == want
    none = spark.createDataFrame([(0, 0, None), (0, 1, None)], "lat_idx int, lon_idx int, value double")
    assert {r["filled"] for r in sampling.fill_nearest(none, reach=8).collect()} == {None}


def test_tiers_are_squares(spark):
    grid = spark.createDataFrame([(2, 2, 1.0), (0, 3, 2.0)], "lat_idx int, lon_idx int, value double")
    points = spark.createDataFrame([(1, 0, 0), (2, 900, 900)], "id int, row int, col int")
    got = {r["id"]: r for r in sampling.nearest_tiered(points, grid, "id").collect()}
    assert got[1]["value"] == 1.0 and got[1]["distance"] == pytest.approx(math.sqrt(8))  # the corner beats the nearer cell outside
    assert got[2]["value"] is None and got[2]["distance"] is None


def test_buffer_keeps_at_the_limit_and_crosses_the_date_line(spark):
    c = spark.createDataFrame([("a", 179.9, 0.0), ("b", 178.0, 0.0)], "station_id string, lon double, lat double")
    t = spark.createDataFrame([("t", -179.9, 0.0)], "station_id string, lon double, lat double")
    assert [r["station_id"] for r in folds.distance_buffer(c, t, 100).collect()] == ["b"]
    assert folds.distance_buffer(c, t, 0).count() == 2
    d = one(folds.nearest_station(t, c, start_km=1))["nearest_training_station_km"]
    assert d == pytest.approx(0.2 * math.pi / 180 * geo.EARTH_KM, rel=1e-9)


def test_folds(spark):
    df = spark.range(103).select(F.col("id").alias("station_id"))
    sizes = {r["fold"]: r["count"] for r in folds.random_folds(df, ["station_id"], 5).groupBy("fold").count().collect()}
    assert sorted(sizes.values()) == [20, 20, 21, 21, 21] and set(sizes) == {1, 2, 3, 4, 5}
    g = folds.grouped_folds(spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 2, "g string"), "g", 2)
    assert {r["g"]: r["fold"] for r in g.collect()} == {"a": 1, "b": 2, "c": 2}
    with pytest.raises(ValueError):
        folds.grouped_folds(spark.createDataFrame([("a",)], "g string"), "g", 2)
    with pytest.raises(ValueError):
        folds.station_coordinates(spark.createDataFrame([("a", 1.0, 1.0), ("a", None, 1.0)], "station_id string, lon double, lat double"))
    with pytest.raises(ValueError):
        folds.assert_disjoint(g, g, ["g"], "fold")


def test_projection_keeps_areas_and_its_origin(spark):
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    rows = spark.createDataFrame([(105.0, 35.0), (106.0, 35.0)], "lon double, lat double").select(x.alias("x"), y.alias("y")).collect()
    assert abs(rows[0]["x"]) < 1e-6 and abs(rows[0]["y"]) < 1e-6 and 85_000 < rows[1]["x"] < 95_000


def test_rasterised_regions_agree_with_even_odd_tests(spark):
    star = [[(8 + 7 * math.sin(a * 2.513), 8 + 7 * math.cos(a * 2.513)) for a in range(5)]]
    ring = [[(1.0, 1.0), (12.0, 1.0), (12.0, 9.0), (1.0, 9.0)], [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0)]]
    shapes = spark.createDataFrame([(1, [[list(p) for p in r] for r in ring]), (2, [[list(p) for p in r] for r in star])], "region_id int, rings array<array<array<double>>>")
    got = {(r["row"], r["col"]): r["region_id"] for r in regions.rasterize(regions.ring_edges(shapes), 0.0, 16.0, 1.0, -1.0, 16, 16).collect()}

    def inside(x, y, rings):
        n = 0
        for r in rings:
            for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
                if min(y1, y2) <= y < max(y1, y2) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) <= x:
                    n += 1
        return n % 2

    for row in range(16):
        for col in range(16):
            x, y = col + 0.5, 16 - row - 0.5
            assert got.get((row, col), 0) == (2 if inside(x, y, star) else 1 if inside(x, y, ring) else 0)


def test_release_checks(spark):
    inv = spark.createDataFrame([("SPEI-1", "2000-01", 10, 5, "bilinear", "excluded", "true"), ("SPEI-1", "2000-02", 20, 5, "bilinear", "excluded", "true")], "timescale string, month string, size_bytes long, width int, cmfd_spatial_method string, soil_predictors string, generation_complete string")
    expected = inv.select("timescale", "month")
    assert one(release.inspect(inv, expected))["total_size_bytes"] == 30
    assert one(release.metadata_json(release.totals(inv, ["timescale"])))["json"].startswith('[{"timescale":"SPEI-1"')
    for bad in (inv.limit(1), inv.withColumn("soil_predictors", F.lit("used")), inv.withColumn("width", F.col("size_bytes"))):
        with pytest.raises(ValueError):
            release.inspect(bad, expected)


def test_model_imputes_and_needs_its_features(spark):
    rows = [(str(i % 7), 2000 + i // 12, i % 12 + 1, float(i % 5), None if i % 3 == 0 else float(i % 4), i % 5 - 2.0) for i in range(240)]
    df = spark.createDataFrame(rows, "station_id string, year int, month int, dyn_a double, dyn_b double, spei double")
    m = model.fit(df, ["dyn_a", "dyn_b"], params={"maxIter": 5, "minInstancesPerNode": 2, "stepSize": 0.5})
    pred = m.predict(df)
    assert one(metrics.regression_metrics(pred.withColumnRenamed("spei", "obs").withColumn("k", F.lit(1)), ["k"]))["R2"] > 0.9
    with pytest.raises(ValueError):
        m.predict(df.drop("dyn_b"))
    _, each, total = model.validate_periods(df.drop("dyn_b"), "SPEI-1", 1, periods=((2010, 2012), (2015, 2019), (1990, 1991)), params={"maxIter": 2, "minInstancesPerNode": 2})
    assert each.count() == 2 and one(total)["n_folds"] == 2


def test_calendar_helpers(spark):
    assert calendars.parse_period(" 1999-2003 ") == (1999, 2003)
    for bad in ("2003-1999", "x", "1999"):
        with pytest.raises(ValueError):
            calendars.parse_period(bad)
    assert calendars.month_range(spark, "1979-03", "2018-12").count() == 478


def test_aliases(spark):
    df = spark.createDataFrame([("1", 2.0, 3.0)], "StationID string, longitude double, `latitude(Decimal Degrees)` double")
    assert clean.rename_first(df, clean.STATION_ALIASES).columns == ["station_id", "lon", "lat"]
    with pytest.raises(ValueError):
        clean.rename_first(df.drop("longitude"), clean.STATION_ALIASES)
    both = spark.createDataFrame([("1", "2")], "station_id string, ID string")
    assert clean.rename_first(both, {"station_id": ["station_id", "ID"]}).columns == ["station_id", "ID"]


def test_homolosine_round_trip(spark):
    places = [(float(lon), float(lat)) for lon in (-150, -60, 10, 73, 105, 135) for lat in (-60, -20, 0, 18, 40, 41, 54, 80)]
    df = spark.createDataFrame(places, "lon double, lat double")
    x, y = geo.goode(F.col("lon"), F.col("lat"))
    lon, lat = geo.goode_to_lonlat(F.col("x"), F.col("y"))
    for r in df.withColumn("x", x).withColumn("y", y).withColumn("a", lon).withColumn("b", lat).collect():
        assert (r["a"], r["b"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-6)
    # Both projections meet at the latitude where they change.
    edge = math.degrees(geo.GOODE_SPLIT)
    a, b = geo.goode(F.lit(105.0), F.lit(edge - 1e-9)), geo.goode(F.lit(105.0), F.lit(edge + 1e-9))
    r = spark.range(1).select(*(c.alias(n) for c, n in zip((*a, *b), "abcd"))).first()
    assert abs(r["a"] - r["c"]) < 5 and abs(r["b"] - r["d"]) < 5


def test_small_guards(spark):
    assert [r["month"] for r in calendars.target_months(spark, 3, end="1979-04").collect()] == ["1979-03", "1979-04"]
    r = spark.range(1).select(calendars.scale_label(F.lit(3)), calendars.scale_code(F.lit(3))).first()
    assert tuple(r) == ("SPEI-3", "spei03")
    with pytest.raises(ValueError):
        features.assert_no_soil(["a", "soil_x"])
    inv = spark.createDataFrame([(1, "a"), (2, "a")], "width int, crs string")
    with pytest.raises(ValueError):
        release.assert_aligned(inv)
    release.assert_aligned(inv.limit(1))


def test_validation_designs(spark):
    rows = [(f"s{i}", 2000 + m // 12, m % 12 + 1, 75.0 + 6 * (i % 5), 20.0 + 5 * (i // 5), float((i * 7 + m) % 11), ((i * 7 + m) % 11) / 3) for i in range(15) for m in range(8)]
    df = spark.createDataFrame(rows, "station_id string, year int, month int, lon double, lat double, dyn_a double, spei double").cache()
    few = {"maxIter": 1, "minInstancesPerNode": 1}
    assert one(model.validate_random(df, "SPEI-1", k=2, params=few)[2])["n_folds"] == 2
    pred, each, total = model.validate_stations(df, "SPEI-1", k=2, params=few)
    assert pred.groupBy("station_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    pred, each, total, blocks, distances = model.validate_blocks(df, "SPEI-1", k=2, block_km=300, buffer_km=50, params=few)
    assert blocks.count() == 15 and distances.where("nearest_training_station_km < 50").isEmpty() and distances.count() == 15
    with pytest.raises(ValueError):
        model.validate_blocks(df, "SPEI-1", k=2, block_km=300, buffer_km=9000, params=few)
    assert folds.split_counts(df.where("month < 3"), df.where("month > 5"))["n_test_samples"] == 45
    df.unpersist()


def test_land_is_filled(spark):
    values = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (1, 0, None), (1, 1, 9.0)], "row int, col int, value double")
    land = spark.createDataFrame([(0, 1), (1, 1)], "row int, col int")
    assert {(r["row"], r["col"]): r["value"] for r in regions.fill_land(values, land).collect()} == {(0, 1): 1.0, (1, 1): 9.0}


def test_summary_of_pairs(spark):
    ours = spark.createDataFrame([("2000-01", 0, 0, 1.0), ("2000-01", 0, 1, float("nan")), ("2000-02", 0, 0, 2.0)], "month string, row int, col int, value double")
    ref = spark.createDataFrame([("2000-01", 0, 0, 2.0), ("2000-01", 0, 1, 5.0), ("2000-03", 0, 0, 2.0)], ours.schema)
    pairs = consistency.valid_pairs(ours, ref, ["month", "row", "col"]).withColumn("product", F.lit("p"))
    r = one(consistency.summary(pairs, ["product"]))
    assert (r["n"], r["Bias"], r["n_months"], r["n_valid_pixels"], r["Pearson_r"]) == (1, -1.0, 1, 1, None)
    assert consistency.valid_pairs(ours, ref, ["month", "row", "col"], spark.createDataFrame([(0, 1)], "row int, col int")).isEmpty()


def test_nearest_fill_is_that_of_brute_force(spark):
    import random

    from drywell.operators import regions, sampling

    rng = random.Random(4)
    cells = []
    for layer in ("a", "b", "none"):
        for r in range(13):
            for c in range(17):
                if rng.random() < 0.15:
                    continue  # the grid leaves cells out
                cells.append((layer, r * 2, c, None if layer == "none" or rng.random() < 0.8 else rng.random()))
    got = sampling.fill_nearest(spark.createDataFrame(cells, "layer string, lat_idx int, lon_idx int, value double"), ("layer",)).collect()
    assert len(got) == len(cells)
    valid = [x for x in cells if x[3] is not None]
    for r in got:
        own = [((r["lat_idx"] - v[1]) ** 2 + (r["lon_idx"] - v[2]) ** 2, v[1], v[2], v[3]) for v in valid if v[0] == r["layer"]]
        assert r["filled"] == (min(own)[3] if own else None)
    land = spark.createDataFrame([(0, 0), (8, 3), (90, 5)], "row int, col int")
    table = spark.createDataFrame([x[1:] for x in cells if x[0] == "a"], "row int, col int, value double")
    want = {(r["lat_idx"], r["lon_idx"]): r["filled"] for r in got if r["layer"] == "a"}
    filled = {(r["row"], r["col"]): r["value"] for r in regions.fill_land(table, land).collect()}
    assert set(filled) == {(0, 0), (8, 3), (90, 5)} and None not in filled.values()
    assert all(filled[k] == want[k] for k in filled if k in want)


def test_nearest_fill_of_a_large_half_empty_grid_ends_soon(spark):
    import time

    from pyspark.sql import functions as F

    from drywell.operators import sampling

    grid = spark.range(1_000_000).selectExpr("cast(id div 1000 as int) AS lat_idx", "cast(id % 1000 as int) AS lon_idx", "CASE WHEN id % 1000 < 500 THEN cast(id as double) END AS value")
    start = time.time()
    r = sampling.fill_nearest(grid).agg(F.count("filled").alias("n"), F.sum(F.when(F.col("lon_idx") >= 500, (F.col("filled") == F.col("lat_idx") * 1000 + 499).cast("int"))).alias("right")).first()
    assert (r["n"], r["right"]) == (1_000_000, 500_000) and time.time() - start < 90


def test_medians_are_exact(spark):
    import random
    import statistics

    from drywell.operators import model

    rng = random.Random(1)
    rows = [(rng.gauss(0, 1) * 10 ** rng.randint(-12, 12), float(k % 3), None if k % 2 else 5.0, float("nan"), rng.choice([-1.7e308, 1.7e308, 0.1])) for k in range(2001)]
    got = model.medians(spark.createDataFrame(rows, "a double, b double, c double, d double, e double"), ["a", "b", "c", "d", "e"])
    assert got == {"a": statistics.median(r[0] for r in rows), "b": 1.0, "c": 5.0, "e": statistics.median(r[4] for r in rows)}
    even = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "a double")
    assert model.medians(even, ["a"]) == {"a": 3.0} and model.medians(even.limit(0), ["a"]) == {}


def test_quantiles_by_group_are_exact(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(0, 1, 4001), "b": rng.integers(0, 5, 1000).astype(float), None: np.array([3.0]), "d": np.array([1e308, -1e308])}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("a", float("nan")), ("e", None)], "g string, v double").repartition(4)
    got = {r["g"]: (r["q1"], r["m"], r["q9"]) for r in model.quantiles(df, ["g"], "v", {"q1": 0.25, "m": 0.5, "q9": 0.9}).collect()}
    assert got.keys() == groups.keys()
    for g in ("a", "b", None):
        assert got[g] == pytest.approx(tuple(np.quantile(groups[g], [0.25, 0.5, 0.9])))
    assert model.quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0


def test_variables_whose_keys_repeat_fail(spark):
    a = spark.createDataFrame([("1", 2000, 1, 1.0), ("1", 2000, 1, None)], "station_id string, year int, month int, x double")
    b = spark.createDataFrame([("1", 2000, 1, 5.0), ("2", 2000, 1, 6.0)], "station_id string, year int, month int, y double")
    keys = ("station_id", "year", "month")
    with pytest.raises(Exception, match="variable x: a key repeats"):
        features.combine_variables([a, b], keys).collect()
    assert {tuple(r) for r in features.combine_variables([a, b], keys, validate=False).collect()} == {("1", 2000, 1, 1.0, 5.0), ("2", 2000, 1, None, 6.0)}


def test_nearest_fill_of_long_columns_ends_soon(spark):
    import time

    from drywell.operators import sampling

    grid = spark.range(300_000).selectExpr("cast(id div 3 as int) AS lat_idx", "cast(id % 3 as int) AS lon_idx", "CASE WHEN id % 7 = 0 THEN cast(id as double) END AS value")
    start = time.time()
    r = sampling.fill_nearest(grid).agg(F.count("filled").alias("n")).first()
    assert r["n"] == 300_000 and time.time() - start < 60


def test_medians_of_columns_count_in_few_jobs(spark):
    """Medians by column equal plain ones, with ties, missing, infinite and great values, and take as many jobs for ten columns as for one."""
    import statistics

    from drywell.operators import model

    values = [[float("nan"), None, float("inf"), -1.7e308, 1.7e308, 0.5, 0.5, 2.0], [3.0] * 8, [None] * 8, [float(k * k % 7) for k in range(8)]]
    df = spark.createDataFrame([tuple(float(v) if v is not None else None for v in row) for row in zip(*values)], "a double, b double, c double, d double").repartition(3)
    finite = [[v for v in column if v is not None and abs(v) < float("inf")] for column in values]
    want = {n: statistics.median(v) for n, v in zip("abcd", finite) if v}
    assert model.medians(df, list("abcd")) == want
    wide = spark.range(5000).selectExpr(*(f"hash(id, {k}) / 7 x{k}" for k in range(10)))
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for columns in (["x0"], [f"x{k}" for k in range(10)]):
        spark.sparkContext.setJobGroup(f"medians {len(columns)}", "")
        found = model.medians(wide, columns)
        jobs.append(len(tracker.getJobIdsForGroup(f"medians {len(columns)}")))
    rows = [tuple(r) for r in wide.collect()]
    assert found == {f"x{k}": statistics.median(r[k] for r in rows) for k in range(10)}
    assert jobs[1] <= jobs[0] + 4


def test_stored_tables_are_read_by_many_tasks(spark):
    """A table that one task stores is still dealt to many."""
    from drywell.functions.store import settled

    table = settled(spark.range(6_000_000).selectExpr("hash(id) * 1.5 a", "hash(id, 1) * 1.5 b").coalesce(1))
    rows = table.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert sum(rows) == 6_000_000 and sum(1 for n in rows if n) > 2
