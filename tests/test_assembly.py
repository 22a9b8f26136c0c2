"""Rasters assembled from tiles, read back in every form; members of archives; files that fail."""

import io
import struct
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from drywell.sources import assembly, files, raster

PLACE = (1000.0, 0.0, 5.0, 0.0, -1000.0, 9.0)


def read(data: bytes, band: int = 1) -> np.ndarray:
    class Bytes:
        def read_at(self, n, at):
            return data[at : at + n]

    r = raster.Raster(Bytes())
    out = np.zeros((r.height, r.width), r.dtype.newbyteorder("="))
    for row, col, values in r.blocks(band=band):
        out[row : row + values.shape[0], col : col + values.shape[1]] = values
    return out


@pytest.mark.parametrize("data", [b"", b"a", b"aaaaaaa", bytes(range(256)) * 40, bytes((i * i // 7) % 251 for i in range(70_000)), np.random.default_rng(1).bytes(40_000)])
def test_lzw_round_trip(data):
    assert raster.unpack_lzw(assembly.pack_lzw(data)) == data


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("compression", ["none", "lzw", "deflate"])
@pytest.mark.parametrize("predictor", [1, 2, 3])
@pytest.mark.parametrize("kind", ["<f4", "<f8", "<i2", "<u1"])
def test_every_form_round_trips(compression, predictor, kind, big):
    rng = np.random.default_rng(3)
    values = rng.normal(0, 50, (37, 53)).cumsum(1).astype(kind) if kind[1] == "f" else rng.integers(0, 100, (37, 53)).astype(kind)
    if predictor == 3 and kind[1] != "f":
        with pytest.raises(ValueError):
            assembly.to_geotiff(values, PLACE, 200, tile=16, compression=compression, predictor=predictor)
        return
    data = assembly.to_geotiff(values, PLACE, 200, {"a<b": "x<1 & \"y\""}, tile=16, compression=compression, predictor=predictor, big=big)
    assert (read(data) == values).all()


def test_strips_bands_and_big_endian():
    """Files of three bands, together and apart, in either byte order, made here."""
    values = np.arange(2 * 5 * 3, dtype=np.int64).reshape(5, 2, 3)
    for order in "<>":
        for apart in (False, True):
            parts = [values[:, :, k] for k in range(3)] if apart else [values]
            blocks = [zlib.compress(p[a : a + 2].astype(f"{order}u2").tobytes()) for p in parts for a in (0, 2, 4)]
            n = 12
            at = 8 + 2 + 12 * n + 4
            offsets = [at + 8 * len(blocks) + sum(map(len, blocks[:k])) for k in range(len(blocks))]
            entries = [(256, 3, 1, 2), (257, 3, 1, 5), (258, 3, 1, 16), (259, 3, 1, 8), (262, 3, 1, 1), (273, 4, len(blocks), at), (277, 3, 1, 3), (278, 3, 1, 2), (279, 4, len(blocks), at + 4 * len(blocks)), (284, 3, 1, 2 if apart else 1), (317, 3, 1, 1), (339, 3, 1, 1)]
            raw = struct.pack(f"{order}2sHIH", b"II" if order == "<" else b"MM", 42, 8, n)
            for tag, kind, count, value in entries:
                raw += struct.pack(f"{order}HHI", tag, kind, count) + (struct.pack(f"{order}HH", value, 0) if kind == 3 else struct.pack(f"{order}I", value))
            raw += bytes(4) + struct.pack(f"{order}{len(blocks)}I", *offsets) + struct.pack(f"{order}{len(blocks)}I", *map(len, blocks)) + b"".join(blocks)
            for band in (1, 2, 3):
                assert (read(raw, band) == values[:, :, band - 1]).all()
            with pytest.raises(ValueError):
                read(raw, 4)


def test_a_large_grid_is_never_in_one_task(spark, tmp_path):
    h, w = 5251, 3869
    cells = spark.range(0, 300_000).select(F.lit("a").alias("k"), (F.pmod(F.col("id") * 7919, F.lit(h))).cast("int").alias("row"), (F.pmod(F.col("id") * 104_729, F.lit(w))).cast("int").alias("col"), (F.col("id") % 1000).cast("double").alias("value"))
    cells = cells.dropDuplicates(["row", "col"]).unionByName(spark.createDataFrame([("b", 0, 0, None), ("b", 5250, 3868, 4.5), ("b", 9999, 0, 1.0)], cells.schema))
    done = assembly.write_grids(cells, str(tmp_path), lambda k: f"{k}.tif", ["k"], h, w, PLACE, tags={"model": "x & y"}, compression="lzw", predictor=3)
    got = {r["k"]: r["cells"] for r in done.collect()}
    assert got["b"] == 1 and sorted(x.name for x in tmp_path.iterdir()) == ["a.tif", "b.tif"]
    back = raster.pixels(spark, str(tmp_path)).where("value is not null").select(F.substring_index("path", "/", -1).alias("f"), "row", "col", "value")
    own = back.where("f = 'a.tif'").drop("f")
    want = cells.where("k = 'a'").select("row", "col", "value")
    assert own.count() == got["a"] == want.count() and own.exceptAll(want).isEmpty()
    assert [tuple(r) for r in back.where("f = 'b.tif'").collect()] == [("b.tif", 5250, 3868, 4.5)]
    tags = {r["tags"]["model"] for r in raster.inventory(spark, str(tmp_path)).collect()}
    assert tags == {"x & y"} and {r["compression"] for r in raster.inventory(spark, str(tmp_path)).collect()} == {"lzw"}


def test_runs_that_stop_leave_no_file_that_looks_complete(tmp_path):
    frame = assembly.Frame(40, 40, PLACE, tile=16)
    data = frame.block([0], [0], [1.0])
    w = assembly.Writer(f"file://{tmp_path}/x.tif", frame, {0: len(data), 4: len(data)}, None)
    w.put(0, data)
    assert not (tmp_path / "x.tif").exists()
    left = next(tmp_path.iterdir())
    w.out.flush()
    with pytest.raises(Exception):
        read(left.read_bytes())
    with pytest.raises(ValueError):
        w.put(4, data + b"x")
    w.put(4, data)
    w.close({})
    assert (tmp_path / "x.tif").exists() and read((tmp_path / "x.tif").read_bytes())[16, 16] == 1.0


def test_empty_grids_write_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "k string, row int, col int, value double")
    assert assembly.write_grids(none, str(tmp_path / "n"), lambda k: k, ["k"], 4, 4, PLACE).count() == 0


def test_members_of_archives_are_read_by_range(spark, tmp_path):
    values = {f"p_spei03_2000-{m:02d}.tif": np.arange(48 * 40, dtype=np.float32).reshape(48, 40) + m for m in (1, 2, 3)}
    (tmp_path / "plain").mkdir()
    with tarfile.open(tmp_path / "all.tar", "w") as t:
        for name, v in values.items():
            data = assembly.to_geotiff(v, PLACE, tile=16)
            (tmp_path / "plain" / name).write_bytes(data)
            info = tarfile.TarInfo(f"in/{name}")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    members = files.tar_members(spark, str(tmp_path)).withColumn("path", files.member_path(F.col("archive"), F.col("offset"), F.col("size")))
    named = raster.pixels_of(members).join(members.select("path", "member"), "path").select(F.substring_index("member", "/", -1).alias("name"), "row", "col", "value")
    plain = raster.pixels(spark, str(tmp_path / "plain")).select(F.substring_index("path", "/", -1).alias("name"), "row", "col", "value")
    assert named.count() == 3 * 48 * 40 and named.exceptAll(plain).isEmpty() and plain.exceptAll(named).isEmpty()


def test_reads_that_fail_are_tried_again(tmp_path, monkeypatch):
    (tmp_path / "x.tif").write_bytes(assembly.to_geotiff(np.ones((20, 20), np.float32), PLACE, tile=16))
    waits, fails = [], []

    class Flaky:
        def __init__(self, f):
            self.f = f

        def read_at(self, n, at):
            if len(fails) < 2:
                fails.append(at)
                raise OSError("lost")
            return self.f.read_at(n, at)

        def __getattr__(self, name):
            return getattr(self.f, name)

    plainly = files.plainly_opened
    monkeypatch.setattr(files, "plainly_opened", lambda uri: Flaky(plainly(uri)))
    monkeypatch.setattr("time.sleep", waits.append)
    with files.opened(str(tmp_path / "x.tif")) as f:
        assert sum(v.sum() for _, _, v in raster.Raster(f).blocks()) == 400
    assert len(fails) == 2 and waits == [files.FIRST_WAIT, 2 * files.FIRST_WAIT]
    fails.clear()
    monkeypatch.setattr(files, "ATTEMPTS", 2)
    with files.opened(str(tmp_path / "x.tif")) as f, pytest.raises(OSError):
        raster.Raster(f)


def test_one_catalogue_of_rasters_members_and_cubes(spark, tmp_path):
    from drywell.plans.gridded import write_cube
    from drywell.sources import products

    (tmp_path / "in").mkdir()
    values = {k: np.full((2, 3), float(i), np.float32) for i, k in enumerate(("Aa_spei03_2000-01", "aa_spei03_2000-02", "bb_spei01_2000-01", "cc_spei06_2000-01"), 1)}
    for k in list(values)[:3]:
        (tmp_path / "in" / f"{k}.tif").write_bytes(assembly.to_geotiff(values[k], PLACE, tile=16))
    with tarfile.open(tmp_path / "more.tar", "w") as t:
        for k in ("cc_spei06_2000-01", "aa_spei03_2000-02"):
            data = assembly.to_geotiff(values[k] + 10, PLACE, tile=16)
            info = tarfile.TarInfo(f"{k}.tif")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    cells = spark.createDataFrame([("x", t, r, c, 100.0 * t + r + c) for t in range(3) for r in range(2) for c in range(3)], "variable string, t int, row int, col int, value double")
    path = f"file://{tmp_path}/bb.nc"
    write_cube(cells, path, "spei", [1.0, 2.0, 3.0], [5.0, 4.0], "months since 2000-01-01", [0.0, 1.0, 2.0])
    listed = products.catalogue(files.listing(spark, str(tmp_path / "in")), files.tar_members(spark, str(tmp_path)), products.cube_months(spark, path, "BB", 1))
    assert sorted((r["product"], r["scale"], r["month"], r["band"]) for r in listed.collect()) == [("aa", 3, "2000-01", 1), ("aa", 3, "2000-02", 1), ("bb", 1, "2000-01", 1), ("bb", 1, "2000-02", 2), ("bb", 1, "2000-03", 3), ("cc", 6, "2000-01", 1)]
    got = {(r["product"], r["month"], r["row"], r["col"]): r["value"] for r in products.product_pixels(spark, listed.where("month > '2000-01' OR product = 'cc'")).collect()}
    assert len(got) == 4 * 6 and got["aa", "2000-02", 1, 2] == 2.0 and got["bb", "2000-03", 1, 2] == 203.0 and got["cc", "2000-01", 0, 0] == 14.0
