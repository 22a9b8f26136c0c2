"""Time axes, coordinate axes, cubes to stations and predicted grids against plain definitions."""

import datetime as dt
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from drywell.functions.calendars import time_axis
from drywell.functions.geo import axis_position
from drywell.operators import boosting, gridded
from drywell.plans.gridded import write_cube
from drywell.sources import assembly, cube, raster


def test_time_axes():
    base = dt.date(1900, 1, 1)
    days = [*range(0, 80_000, 37), -1, -400]
    want = [((base + dt.timedelta(d)).year, (base + dt.timedelta(d)).month, (base + dt.timedelta(d)).day) for d in days]
    assert time_axis(days, "days since 1900-01-01") == want
    assert time_axis([24.0 * d + 23.9 for d in days], "hours since 1900-1-1 00:00:00", "gregorian") == want
    assert time_axis([86_400 * d for d in days], "seconds since 1900-01-01T00:00:00Z", "proleptic_gregorian") == want
    assert time_axis([58, 59, 365], "days since 2000-01-01", "noleap") == [(2000, 2, 28), (2000, 3, 1), (2001, 1, 1)]
    assert time_axis([59, 366], "days since 2001-01-01", "all_leap") == [(2001, 2, 29), (2002, 1, 1)]
    assert time_axis([59, 359, 360], "days since 2001-01-01", "360_day") == [(2001, 2, 30), (2001, 12, 30), (2002, 1, 1)]
    assert time_axis([0, 13], "months since 1979-01-15") == [(1979, 1, 15), (1980, 2, 15)]
    assert time_axis([0], "hours since 1999-12-31 23:30:00") == [(1999, 12, 31)] and time_axis([1], "hours since 1999-12-31 23:30:00") == [(2000, 1, 1)]
    for units, calendar in (("days after 1900-01-01", "standard"), ("days since 1900-01-01", "lunar"), ("fortnights since 1900-01-01", "standard")):
        with pytest.raises(ValueError):
            time_axis([0], units, calendar)


@pytest.mark.parametrize("axis", [[1.0, 2, 3, 4], [40.0, 37.5, 35, 32.5], [0.0, 1, 5, 5.5, 9, 20], [20.0, 9, 8.5, 1], [3.0, 7.0], [5.0]])
def test_axis_positions(spark, axis):
    x = np.linspace(min(axis) - 3, max(axis) + 3, 41).tolist() + axis
    got = [r["p"] for r in spark.createDataFrame([(float(v), k) for k, v in enumerate(x)], "x double, k int").select("k", axis_position(F.col("x"), axis).alias("p")).orderBy("k").collect()]

    def plain(v):
        if len(axis) == 1:
            return 0.0
        sign = 1 if axis[1] > axis[0] else -1
        k = max(0, min(len(axis) - 2, int(np.searchsorted([sign * a for a in axis], sign * v, "right")) - 1))
        return k + (v - axis[k]) / (axis[k + 1] - axis[k])

    assert np.allclose(got, [plain(v) for v in x], atol=1e-12)
    assert got[41:] == list(range(len(axis)))


def test_axes_that_turn_are_refused(spark):
    with pytest.raises(ValueError):
        axis_position(F.col("x"), [0.0, 2.0, 1.0])


def plain_sample(values, py, px):
    """NaN-aware bilinear value of one layer at positions, the nearest valid cell of the nearest cell otherwise."""
    h, w = values.shape
    y0, x0 = (min(max(int(np.floor(p)), 0), n - 2) for p, n in ((py, h), (px, w)))
    wy, wx = min(max(py - y0, 0), 1), min(max(px - x0, 0), 1)
    total = used = 0.0
    for y, x, k in ((y0, x0, (1 - wy) * (1 - wx)), (y0, x0 + 1, (1 - wy) * wx), (y0 + 1, x0, wy * (1 - wx)), (y0 + 1, x0 + 1, wy * wx)):
        if np.isfinite(values[y, x]) and k > 0:
            total, used = total + k * values[y, x], used + k
    if used:
        return total / used
    yn, xn = (min(max(int(np.rint(p)), 0), n - 1) for p, n in ((py, h), (px, w)))
    near = [((y - yn) ** 2 + (x - xn) ** 2, y, x) for y in range(h) for x in range(w) if np.isfinite(values[y, x])]
    return values[min(near)[1:]] if near else None


def test_stations_from_cubes(spark, tmp_path):
    rng = np.random.default_rng(2)
    lats, lons = [45.0, 44.0, 42.0, 41.5], [70.0, 71.0, 72.0, 73.0, 74.0]
    values = {n: rng.normal(10, 3, (3, 4, 5)) for n in ("prec", "temp")}
    values["prec"][:, 1:3, :3] = np.nan
    values["temp"][2] = np.nan
    for n, first in (("prec", "2000-01-31"), ("temp", "2000-02-15")):
        cells = spark.createDataFrame([(n, t, y, x, float(v) if np.isfinite(v) else None) for (t, y, x), v in np.ndenumerate(values[n])], "variable string, t int, row int, col int, value double")
        write_cube(cells, f"file://{tmp_path}/{n}.nc", n, lons, lats, f"months since {first}", [0.0, 1.0, 2.0])
    stations = [("a", 70.25, 43.5), ("b", 71.0, 44.0), ("c", 80.0, 20.0), ("d", 60.0, 60.0), ("e", None, 40.0), ("f", 70.5, 42.9)]
    got = {(r["station_id"], r["year"], r["month"]): (r["prec"], r["temp"]) for r in gridded.sample_cube(spark, spark.createDataFrame(stations, "station_id string, lon double, lat double"), [f"{tmp_path}/{n}.nc" for n in values]).collect()}
    assert len(got) == 5 * 4 and cube.describe(f"{tmp_path}/prec.nc").dates == [(2000, 1, 31), (2000, 2, 31), (2000, 3, 31)]
    hours = {1: 31 * 24, 2: 29 * 24, 3: 31 * 24}
    for s, lon, lat in stations:
        if lon is None:
            continue
        px, py = (np.interp(lon, lons, range(5), left=-1, right=5), 3 - np.interp(lat, lats[::-1], range(4), left=-1, right=4))
        for m in (1, 2, 3, 4):
            want = []
            for n, t in (("prec", m - 1), ("temp", m - 2)):
                v = plain_sample(values[n][t], py, px) if 0 <= t < 3 else None
                want.append(v if v is None or n == "temp" else v * hours[m])
            assert got[s, 2000, m] == tuple(v if v is None else pytest.approx(v) for v in want), (s, m)
    with pytest.raises(ValueError):
        gridded.sample_cube(spark, spark.createDataFrame(stations, "station_id string, lon double, lat double"), [f"{tmp_path}/temp.nc"] * 2)


FRAME = assembly.Frame(40, 36, (0.1, 0.0, 70.0, 0.0, -0.1, 45.0), tile=16, compression="deflate")
LONS, LATS = [70.0, 71.0, 72.0, 74.0], [45.0, 44.0, 43.0, 42.0, 41.0]


def layers_of(spark, values):
    return spark.createDataFrame([(t, y, x, f, float(v) if np.isfinite(v) else None) for (t, f), a in values.items() for (y, x), v in np.ndenumerate(a)], "t int, lat_idx int, lon_idx int, feature string, value double")


def plus(given):
    return given["dyn_a"] + 2 * given["dyn_b"] + given["height"] + given["month"]


def test_predicted_grids_equal_plain_ones(spark, tmp_path):
    rng = np.random.default_rng(4)
    values = {(t, f): rng.normal(0, 1, (5, 4)) for t in (3, 4, 5) for f in ("dyn_a", "dyn_b", "unused")}
    values[3, "dyn_a"][:2, :3] = np.nan
    values[4, "dyn_b"][:] = np.nan  # nothing to fill from: no values
    land = [(r, c, float(r * c)) for r in range(40) for c in range(36) if (r + c) % 3 and not (r >= 16 and c < 16)] + [(99, 0, 1.0)]
    df = spark.createDataFrame(land, "row int, col int, height double")
    months = {3: (2000, 4), 4: (2000, 5), 5: (2000, 6)}
    kept = gridded.reconstruct(layers_of(spark, values), df, plus, ["dyn_a", "dyn_b", "height", "month"], str(tmp_path), FRAME, LONS, LATS, 3, months, months_a_task=2, tags={"model": "plus"})
    assert {r["t"]: r["cells"] for r in kept.collect()} == {3: len(land) - 1, 4: 0, 5: len(land) - 1}
    got = {(r["path"][-11:-4], r["row"], r["col"]): r["value"] for r in raster.pixels(spark, str(tmp_path)).where("value is not null").collect()}
    assert len(got) == 2 * (len(land) - 1)
    for r, c, h in land[:-1:7]:
        px, py = np.interp(70 + (c + 0.5) * 0.1, LONS, range(4)), 45 - (45 - (r + 0.5) * 0.1)
        for t in (3, 5):
            a, b = (plain_sample(values[t, f], py, px) for f in ("dyn_a", "dyn_b"))
            assert got[f"2000-{t + 1:02d}", r, c] == pytest.approx(a + 2 * b + h + t + 1, rel=1e-5)
    tags = {r["tags"]["year_month"]: r["tags"] for r in raster.inventory(spark, str(tmp_path)).collect()}
    assert tags["2000-05"] == {"model": "plus", "spei_timescale_months": "3", "year_month": "2000-05", "generation_complete": "true"}

    # Complete files are passed over or refused, others are an error.
    again = lambda how: gridded.reconstruct(layers_of(spark, values), df, plus, ["dyn_a", "dyn_b", "height"], str(tmp_path), FRAME, LONS, LATS, 3, months, existing=how)
    with pytest.raises(FileExistsError):
        again("refuse")
    (tmp_path / "spei_03mo_2000-05.tif").unlink()
    assert [r["t"] for r in again("skip").collect()] == [4]
    assert again("skip").count() == 0
    (tmp_path / "spei_03mo_2000-05.tif").write_bytes(b"II*\0")
    with pytest.raises(RuntimeError):
        again("skip")


def test_leafwise_trees_predict_grids(spark, tmp_path):
    rng = np.random.default_rng(6)
    train = rng.normal(0, 1, (400, 2))
    df = spark.createDataFrame([(*map(float, r), float(r[0] > 0) * 3 + float(r[1])) for r in train], "dyn_a double, height double, spei double")
    forest = boosting.fit(df, ["dyn_a", "height"], trees=2, leaves=6, least=10, rate=0.5)
    values = {(0, "dyn_a"): rng.normal(0, 1, (5, 4))}
    land = [(r, c, float(rng.normal())) for r in range(40) for c in range(36)]
    gridded.reconstruct(layers_of(spark, values), spark.createDataFrame(land, "row int, col int, height double"), forest, forest.names, str(tmp_path), FRAME, LONS, LATS, 1, {0: (2000, 1)})
    got = {(r["row"], r["col"]): r["value"] for r in raster.pixels(spark, str(tmp_path)).collect()}
    a = [plain_sample(values[0, "dyn_a"], (r + 0.5) * 0.1, np.interp(70 + (c + 0.5) * 0.1, LONS, range(4))) for r, c, _ in land]
    want = forest({"dyn_a": np.array(a), "height": np.array([h for _, _, h in land])})
    assert np.mean([got[r, c] == pytest.approx(w, rel=1e-5) for (r, c, _), w in zip(land, want)]) > 0.995


def test_predicted_grids_need_their_features_and_land(spark, tmp_path):
    values = {(0, "dyn_a"): np.ones((5, 4))}
    df = spark.createDataFrame([(0, 0, 1.0)], "row int, col int, height double")
    with pytest.raises(ValueError, match="dyn_b"):
        gridded.reconstruct(layers_of(spark, values), df, plus, ["dyn_a", "dyn_b"], str(tmp_path), FRAME, LONS, LATS, 1, {0: (2000, 1)})
    none = gridded.reconstruct(layers_of(spark, values), df.limit(0), plus, ["dyn_a"], str(tmp_path), FRAME, LONS, LATS, 1, {0: (2000, 1)})
    assert none.count() == 0 and not list(tmp_path.iterdir())


def test_record_times_of_classic_files(tmp_path):
    """A time axis along an unlimited dimension lies between the field's records."""
    text = lambda s: struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    word = lambda k, v: text(k) + struct.pack(">I", 2) + text(v)
    none = struct.pack(">II", 0, 0)
    dims = b"".join(text(n) + struct.pack(">I", k) for n, k in (("time", 0), ("lat", 2), ("lon", 2)))

    def head(a, b, c, e):
        out = b"CDF\2" + struct.pack(">I", 3) + struct.pack(">II", 10, 3) + dims + none + struct.pack(">II", 11, 4)
        out += text("time") + struct.pack(">II", 1, 0) + struct.pack(">II", 12, 1) + word("units", "days since 2000-01-31") + struct.pack(">IIQ", 6, 8, a)
        for n, k, at in (("lat", 1, b), ("lon", 2, c)):
            out += text(n) + struct.pack(">II", 1, k) + none + struct.pack(">IIQ", 6, 16, at)
        return out + text("temp") + struct.pack(">IIII", 3, 0, 1, 2) + none + struct.pack(">IIQ", 5, 16, e)

    n = len(head(0, 0, 0, 0))
    records = b"".join(struct.pack(">d4f", d, *(d + k for k in range(4))) for d in (0.0, 1.0, 60.0))
    (tmp_path / "x.nc").write_bytes(head(n + 32, n, n + 16, n + 40) + struct.pack(">2d2d", 1.0, 0.0, 5.0, 6.0) + records)
    told = cube.describe(str(tmp_path / "x.nc"))
    assert (told.name, told.lons, told.lats, told.dates) == ("temp", [5.0, 6.0], [1.0, 0.0], [(2000, 1, 31), (2000, 2, 1), (2000, 3, 31)])
