"""Readers and writers by small files made here."""

import io
import json
import struct
import tarfile
import zipfile

import numpy as np
import pytest

from drywell.sources import assembly, cube, files, raster, stations
from drywell.streaming import months


def test_daily_files(spark, tmp_path):
    d = tmp_path / "daily_spei_GEV_3monthscale"
    d.mkdir()
    (d / "00123.csv").write_text("2000,31,0.5\n2000,31,0.7\n2000,bad,1\n2000,60,NaN\n")
    (d / "notes.txt").write_text("x")
    rows = stations.read_daily(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r["station_id"], r["scale"], r["year"], r["doy"], r["spei"]) for r in rows] == [("00123", 3, 2000, 31, 0.5), ("00123", 3, 2000, 31, 0.7), ("00123", 3, 2000, None, 1.0), ("00123", 3, 2000, 60, None)]
    from drywell.operators import labels

    audit = labels.month_audit(stations.read_daily(spark, str(tmp_path)), ties=["line"])
    assert audit.where("month = 1").first()["strict_month_end_spei"] == 0.7
    with pytest.raises(Exception):
        stations.read_daily(spark, str(tmp_path / "none"))


def test_tables_keep_leading_zeros(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,longitude,latitude,name\n00123,100.5,30.25,a\n")
    r = stations.read_lookup(spark, str(tmp_path / "s.csv")).first()
    assert (r["station_id"], r["lon"], r["lat"]) == ("00123", 100.5, 30.25)
    (tmp_path / "p.csv").write_text("scale,Fold,station,year,month,TRUTH,y_pred\nSPEI-1,1,01,2000,1,0.5,0.25\nSPEI-2,1,01,2000,1,1,1\nSPEI-3,x,01,2000,1,1,1\n")
    assert [(r["timescale"], r["fold"], r["obs"], r["pred"]) for r in stations.read_predictions(spark, str(tmp_path / "p.csv")).collect()] == [("SPEI-1", 1, 0.5, 0.25)]
    with pytest.raises(ValueError):
        stations.read_training(spark, str(tmp_path / "s.csv"))


def test_sinks_refuse_and_append(spark, tmp_path):
    out = str(tmp_path / "t")
    stations.append_missing(spark.range(3), out, ["id"])
    stations.append_missing(spark.range(5), out, ["id"])
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(Exception):
        stations.write_table(spark.range(1), out)
    stations.write_table(spark.range(1), out, overwrite=True)
    assert spark.read.parquet(out).count() == 1


def classic_netcdf(values, name="temp", record=True, fill=-999.0):
    """A version-1 file with time (unlimited if record), lat and lon."""
    t, h, w = values.shape
    text = lambda s: struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    dims = b"".join(text(n) + struct.pack(">I", k) for n, k in (("time", 0 if record else t), ("lat", h), ("lon", w)))
    attr = text("_FillValue") + struct.pack(">IIf", 5, 1, fill)
    head = lambda begin, b2: (
        b"CDF\1" + struct.pack(">I", t) + struct.pack(">II", 10, 3) + dims + struct.pack(">II", 0, 0) + struct.pack(">II", 11, 2)
        + text("lat") + struct.pack(">II", 1, 1) + struct.pack(">II", 0, 0) + struct.pack(">III", 6, 8 * h, b2)
        + text(name) + struct.pack(">IIII", 3, 0, 1, 2) + struct.pack(">II", 12, 1) + attr + struct.pack(">III", 5, 4 * h * w, begin)
    )
    n = len(head(0, 0))
    return head(n + 8 * h, n) + np.arange(h, dtype=">f8").tobytes() + np.where(np.isnan(values), fill, values).astype(">f4").tobytes()


@pytest.mark.parametrize("record", [True, False])
def test_cube(spark, tmp_path, record):
    values = np.arange(14 * 2 * 3, dtype=float).reshape(14, 2, 3)
    values[3, 1, 2] = np.nan
    (tmp_path / "c.nc").write_bytes(classic_netcdf(values, record=record))
    df = cube.read_cube(spark, str(tmp_path / "c.nc"), 14)
    got = {(r["t"], r["row"], r["col"]): r["value"] for r in df.collect()}
    assert len(got) == 84 and got[3, 1, 2] is None and all(v is None or v == values[k] for k, v in got.items())
    assert cube.axes(str(tmp_path / "c.nc"))[1].tolist() == [0.0, 1.0]
    with pytest.raises(Exception):
        cube.read_cube(spark, str(tmp_path / "c.nc"), 480).count()


def test_raster_round_trip(spark, tmp_path):
    values = np.arange(300 * 270, dtype=np.float32).reshape(300, 270)
    values[5, 7] = np.nan
    (tmp_path / "spei_03mo_2000-01.tif").write_bytes(assembly.to_geotiff(values, (1000.0, 0, 5.0, 0, -1000.0, 9.0), tags={"generation_complete": "true"}))
    df = raster.pixels(spark, str(tmp_path), row0=4, row1=260)
    assert df.count() == 256 * 270 and df.where("row = 5 AND col = 7").first()["value"] is None and df.where("row = 259 AND col = 269").first()["value"] == float(values[259, 269])
    r = raster.inventory(spark, str(tmp_path)).first()
    assert (r["width"], r["height"], r["transform_c"], r["transform_f"], r["nodata"], r["dtype"], r["compression"], r["tags"]) == (270, 300, 5.0, 9.0, -9999.0, "float32", "deflate", {"generation_complete": "true"})
    own = files.own_months(files.listing(spark, str(tmp_path), "*.tif")).first()
    assert (own["scale"], own["month"]) == (3, "2000-01")


def test_lzw():
    def pack(data):
        table, codes, word = {bytes([k]): k for k in range(256)}, [(256, 9)], b""
        width = 9
        for b in data:
            if word + bytes([b]) in table:
                word += bytes([b])
                continue
            codes.append((table[word], width))
            table[word + bytes([b])] = len(table) + 2
            n = len(table) + 2
            width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
            word = bytes([b])
        codes += [(table[word], width), (257, width)]
        bits = "".join(f"{c:0{w}b}" for c, w in codes)
        bits += "0" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big")

    data = bytes((i * i // 7) % 11 for i in range(1500))
    assert raster.unpack_lzw(pack(data)) == data


def test_archives_and_tiles(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        info = tarfile.TarInfo("grids/spei_01mo_1999-12.tif")
        info.size = 5
        t.addfile(info, io.BytesIO(b"hello"))
    r = files.tar_members(spark, str(tmp_path)).first()
    assert r["member"].endswith("1999-12.tif") and files.member_bytes(r["archive"], r["offset"], r["size"]) == b"hello"
    data = np.array([[1, 2, 3], [4, -32768, 6], [7, 8, 9]], ">i2")
    with zipfile.ZipFile(tmp_path / "n30e100.zip", "w") as z:
        z.writestr("n30e100.hgt", data.tobytes())
    got = {(r["row"], r["col"]): r for r in files.elevation_tiles(spark, str(tmp_path)).collect()}
    assert got[0, 0]["lat"] == 31 and got[2, 2]["lat"] == 30 and got[2, 2]["lon"] == 101 and got[1, 1]["value"] is None and got[2, 0]["value"] == 7


def test_boundaries_and_names(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    (tmp_path / "b.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "A"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}]}))
    rows = files.boundary(spark, str(tmp_path / "b.json")).orderBy("region_id").collect()
    assert [(r["region_id"], r["name"], len(r["rings"])) for r in rows] == [(1, "A", 1), (2, "region_2", 2)]
    (tmp_path / "g.json").write_text(json.dumps({"type": "Polygon", "coordinates": square}))
    assert files.boundary(spark, str(tmp_path / "g.json")).first()["name"] == "region_1"
    paths = spark.createDataFrame([("/x/ABC_spei03_1991-01.tif",), ("/x/cube1_spei03_1991-01.tif",), ("/x/other.tif",)], "path string")
    assert [(r["product"], r["scale"], r["month"]) for r in files.products(paths, "Cube").collect()] == [("abc", 3, "1991-01")]
    urls = spark.createDataFrame([("https://h/f?fileName=spei06.zip&x=1",), ("https://h/f",)], "value string")
    assert [(r["file_name"], r["scale"]) for r in files.url_manifest(urls).collect()] == [("spei06.zip", 6)]


def test_stream_resumes(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def put(month, n):
        spark.createDataFrame([("p", 3, month, 0, k, float(k), float(k) * 2) for k in range(n)], months.SCHEMA).coalesce(1).write.mode("append").parquet(src)

    put("2000-01", 3)
    months.accumulate(spark, src, out, state)
    put("2000-02", 4)
    months.accumulate(spark, src, out, state)
    months.accumulate(spark, src, out, state)
    r = months.state(spark, out).first()
    assert r["n"] == 7 and r["Pearson_r"] == pytest.approx(1.0) and r["Bias"] == pytest.approx(-9 / 7)


def test_retries_and_caches(spark, tmp_path):
    waits, calls = [], []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "done"

    assert files.retried(fails, sleep=waits.append) == "done" and waits == [30.0, 60.0]
    with pytest.raises(OSError):
        files.retried(lambda: (_ for _ in ()).throw(OSError("gone")), attempts=2, sleep=waits.append)
    made = []

    def build():
        made.append(1)
        return spark.range(4)

    for key in ("a", "a", "b"):
        assert stations.cached(spark, str(tmp_path / "cache"), build, key).count() == 4
    assert len(made) == 2
    paths = spark.createDataFrame([("/d/prec_x.nc",), ("/d/temp_x.nc",), ("/d/temp_y.nc",)], "path string")
    assert files.one_per_variable(paths, ["prec"]).first()["path"] == "/d/prec_x.nc"
    with pytest.raises(ValueError):
        files.one_per_variable(paths, ["prec", "temp"])


def test_scaled_bands(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(-99999.0,), (12345.0,), (float("nan"),)], "v double")
    assert [r[0] for r in df.select(raster.scaled(F.col("v"))).collect()] == [None, pytest.approx(1.2345), None]


def test_tables_with_a_byte_order_mark_and_incomplete_ones(spark, tmp_path):
    import glob
    import os

    from drywell.sources import stations

    path = str(tmp_path / "t.csv")
    table = spark.createDataFrame([("007", 1.5)], "station_id string, x double")
    stations.write_table(table, path, "csv", bom=True)
    part = open(glob.glob(path + "/part-*")[0], "rb").read()
    assert part.startswith(b"\xef\xbb\xbfstation_id,x")
    assert stations.read_csv(spark, path, ("station_id",)).collect() == [("007", 1.5)]
    with pytest.raises(Exception, match="(?i)exist"):
        stations.write_table(table, path, "csv", replace_incomplete=True)
    os.remove(path + "/_SUCCESS")
    assert not stations.is_complete(spark, path)
    stations.write_table(table, path, "csv", replace_incomplete=True)
    assert stations.is_complete(spark, path)


def test_checksums_are_read_by_range(spark, tmp_path):
    import hashlib

    from drywell.operators import release

    for name, data in (("a b.tar", b"x" * 100_000), ("50%.tar", b"y"), ("c.txt", b"no")):
        (tmp_path / name).write_bytes(data)
    before, release.READ_BYTES = release.READ_BYTES, 1000
    try:
        got = {r["archive_name"]: (r["size_bytes"], r["sha256"]) for r in release.file_listing(spark, str(tmp_path), "*.tar", True).collect()}
    finally:
        release.READ_BYTES = before
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in (("a b.tar", b"x" * 100_000), ("50%.tar", b"y"))}


def test_own_rasters_come_from_archives_where_no_file_has_the_scale(spark):
    from drywell.sources import files

    paths = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    got = files.own_months(paths("/a/spei_03mo_1999-01.tif"), paths("z/spei_03mo_1999-02.tif", "z/spei_12mo_1999-02.tif", "z/other.txt")).collect()
    assert sorted((r["scale"], r["month"]) for r in got) == [(3, "1999-01"), (12, "1999-02")]


def test_station_names_in_another_encoding(spark):
    from drywell.functions import clean

    df = spark.createDataFrame([("1", 2.0, 3.0)], "ID string, `\u7f01\u5fd3\u5bb3` double, `\u7efe\ue100\u5bb3` double")
    assert clean.rename_first(df, clean.STATION_ALIASES).columns == ["station_id", "lon", "lat"]


def test_only_changed_files_are_summed_again(spark, tmp_path):
    import hashlib

    from drywell.operators import release

    for name, text in (("a.tif", b"one"), ("b.tif", b"two!"), ("c.tif", b"three")):
        (tmp_path / name).write_bytes(text)
    old = spark.createDataFrame([("a.tif", 3, "kept"), ("b.tif", 3, "other size"), ("z.tif", 1, "gone")], "archive_name string, size_bytes long, sha256 string")
    got = {r["archive_name"]: (r["sha256"], r["reused"]) for r in release.current_manifest(spark, str(tmp_path), old, "*.tif").collect()}
    assert got == {"a.tif": ("kept", True), "b.tif": (hashlib.sha256(b"two!").hexdigest(), False), "c.tif": (hashlib.sha256(b"three").hexdigest(), False)}


def test_label_sets_have_all_three_tables(spark, tmp_path):
    one = spark.range(2)
    stations.write_label_set(one, one.selectExpr("id AS a"), one.selectExpr("id AS s"), str(tmp_path / "x"))
    assert all(stations.is_complete(spark, f"{tmp_path}/x/{n}") for n in ("labels", "audit", "summary"))
    with pytest.raises(FileExistsError):
        stations.write_label_set(one, one, one, str(tmp_path / "x"))


def test_daily_files_of_many_blocks(spark, tmp_path, monkeypatch):
    """Files longer than a block, of any line ends, give each line once and in order; names stay as they are."""
    monkeypatch.setattr(stations, "BLOCK", 7)
    lines = [f"{1990 + k % 30},{k % 365 + 1},{k / 8}" for k in range(300)]
    for name, end in (("a b%20c", "\n"), ("d", "\r\n"), ("e", "\r")):
        d = tmp_path / "spei_3monthscale"
        d.mkdir(exist_ok=True)
        (d / f"{name}.csv").write_bytes(end.join(lines).encode())
    rows = stations.read_daily(spark, str(tmp_path)).orderBy("station_id", "line").collect()
    want = [(name, 3, *(int(x) for x in row.split(",")[:2]), float(row.split(",")[2])) for name in ("a b%20c", "d", "e") for row in lines]
    assert [tuple(r)[:5] for r in rows] == want


def test_daily_files_are_read_many_a_task(spark, tmp_path):
    """The number of tasks that read does not follow the number of files, nor do those that write follow the bytes."""
    from drywell.plans.stored import write_series

    rows = spark.range(400).selectExpr("cast(id as string) station_id", "3 scale", "2000 year", "cast(id % 300 as int) + 1 doy", "'1.5' spei")
    write_series(rows, f"file://{tmp_path}/many")
    found = stations.read_daily(spark, f"file://{tmp_path}/many")
    assert found.count() == 400 and found.rdd.getNumPartitions() <= 8
