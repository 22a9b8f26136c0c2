"""Files by URI in tasks, and listings of archives and products."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Reads that fail: how often, and seconds before the second try; the waits double.
ATTEMPTS, FIRST_WAIT = 4, 0.5
MEMBER = re.compile(r"#(\d+)\+(\d+)$")


def plainly_opened(uri: str):
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    files, path = pafs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


class Steady(io.RawIOBase):
    """A seekable file, or the part of one from `start`, that is opened again and read again after a read that fails."""

    def __init__(self, uri: str, start: int = 0, length: int | None = None):
        super().__init__()
        self.uri, self.start, self.at = uri, start, 0
        self.f = retried(lambda: plainly_opened(uri), ATTEMPTS, FIRST_WAIT)
        self.length = self.f.size() - start if length is None else length

    def read_at(self, n: int, at: int) -> bytes:
        n = max(0, min(n, self.length - at))

        def again() -> bytes:
            try:
                return self.f.read_at(n, self.start + at)
            except OSError:
                self.f = plainly_opened(self.uri)
                raise

        return retried(again, ATTEMPTS, FIRST_WAIT)

    def size(self) -> int:
        return self.length

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = to + (0, self.at, self.length)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        data = self.read_at(self.length - self.at if n is None or n < 0 else n, self.at)
        self.at += len(data)
        return data

    def readinto(self, buffer) -> int:
        data = self.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self.f.close()
        super().close()


def opened(uri: str) -> Steady:
    """A readable, seekable file of any file system that pyarrow knows, or the member of an archive that `member_path` names."""
    part = MEMBER.search(uri)
    return Steady(uri[: part.start()], int(part[1]), int(part[2])) if part else Steady(uri)


def member_path(archive, offset, size):
    """The path of an archive's member as a column: `opened` reads it by range, without the archive's other members."""
    return F.concat(archive, F.lit("#"), offset.cast("string"), F.lit("+"), size.cast("string"))


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length) of files, without their contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "length")


def tar_members(spark: SparkSession, path: str, glob: str = "*.tar") -> DataFrame:
    """(archive, member, offset, size) of the plain files in uncompressed archives, from their headers."""

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with opened(uri) as f, tarfile.open(fileobj=io.BufferedReader(f), mode="r:") as t:
                    found = [(uri, m.name, m.offset_data, m.size) for m in t if m.isfile()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["archive", "member", "offset", "size"])

    return listing(spark, path, glob).select("path").mapInArrow(run, "archive string, member string, offset long, size long")


def member_bytes(archive: str, offset: int, size: int) -> bytes:
    with opened(archive) as f:
        return f.read_at(size, offset)


TILE = re.compile(r"([NnSs])(\d{2})([EeWw])(\d{3})")


def elevation_tiles(spark: SparkSession, path: str, glob: str = "*.zip", nodata: int = -32768) -> DataFrame:
    """(tile, lat, lon, row, col, value) of zipped elevation tiles, one per archive: lat and lon of the north-west pixel's centre, degrees per step 1/(n-1).

    A tile goes out in blocks of rows, so a task holds one tile.
    """

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with opened(uri) as f, zipfile.ZipFile(io.BytesIO(f.read())) as z:
                    names = [n for n in z.namelist() if n.lower().endswith(".hgt")]
                    if len(names) != 1:
                        raise ValueError(f"{uri} holds {len(names)} elevation tiles, not one")
                    data = np.frombuffer(z.read(names[0]), ">i2").astype(np.float64)
                at = TILE.search(names[0])
                lat, lon = int(at[2]) * (1 if at[1] in "Nn" else -1), int(at[4]) * (1 if at[3] in "Ee" else -1)
                n = int(round(len(data) ** 0.5))
                data = data.reshape(n, n)
                for a in range(0, n, 64):
                    block = data[a : a + 64]
                    row, col = np.indices(block.shape)
                    row = row + a
                    value = pa.array(block.ravel(), mask=(block == nodata).ravel())
                    yield pa.RecordBatch.from_arrays([
                        pa.array([at[0]] * block.size), pa.array((lat + 1 - row / (n - 1)).ravel()), pa.array((lon + col / (n - 1)).ravel()),
                        pa.array(row.ravel().astype(np.int32)), pa.array(col.ravel().astype(np.int32)), value,
                    ], names=["tile", "lat", "lon", "row", "col", "value"])

    return listing(spark, path, glob).select("path").mapInArrow(run, "tile string, lat double, lon double, row int, col int, value double")


def boundary(spark: SparkSession, path: str) -> DataFrame:
    """(region_id from 1 in file order, name, rings) of a GeoJSON collection, feature or bare geometry; parts of a multi-polygon share the id."""
    text = spark.read.option("wholetext", True).text(path).select("value")
    kind = F.get_json_object("value", "$.type")
    collection = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    feature = F.when(kind == "FeatureCollection", collection).when(kind == "Feature", F.array("value")).otherwise(F.array(F.concat(F.lit('{"geometry":'), F.col("value"), F.lit("}"))))
    rows = text.select(F.posexplode(feature).alias("k", "f"))
    shape = F.get_json_object("f", "$.geometry.coordinates")
    rings = F.when(F.get_json_object("f", "$.geometry.type") == "MultiPolygon", F.flatten(F.from_json(shape, "array<array<array<array<double>>>>"))).otherwise(F.from_json(shape, "array<array<array<double>>>"))
    number = F.col("k") + 1
    return rows.select(number.cast("int").alias("region_id"), F.coalesce(F.get_json_object("f", "$.properties.name"), F.concat(F.lit("region_"), number)).alias("name"), rings.alias("rings"))


#: File names of monthly rasters, ours and other products'.
OWN_NAME = r"(?i)spei_(\d{2})mo_(\d{4}-\d{2})\.tif$"
PRODUCT_NAME = r"(?i)([a-zA-Z0-9]+)_spei(\d{2})_(\d{4}-\d{2})\.tif$"


def own_months(files: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(scale, month, path) of our rasters by name; of `members` (path), those of archives, only scales that no plain file has."""

    def named(df: DataFrame) -> DataFrame:
        rows = df.select("path", F.regexp_extract("path", OWN_NAME, 1).try_cast("int").alias("scale"), F.regexp_extract("path", OWN_NAME, 2).alias("month"))
        return rows.where("scale IS NOT NULL AND month <> ''")

    plain = named(files)
    return plain if members is None else plain.unionByName(named(members).join(plain.select("scale").distinct(), "scale", "left_anti").select(plain.columns))


def products(files: DataFrame, skip: str | None = None) -> DataFrame:
    """(product, scale, month, path) of other products' rasters by name, but for products whose name begins with `skip` (those that are read from a cube)."""
    name = F.col("path")
    rows = files.select(F.lower(F.regexp_extract(name, PRODUCT_NAME, 1)).alias("product"), F.regexp_extract(name, PRODUCT_NAME, 2).try_cast("int").alias("scale"), F.regexp_extract(name, PRODUCT_NAME, 3).alias("month"), "path")
    rows = rows.where(F.col("month") != "")
    return rows.where(~F.col("product").startswith(skip.lower())) if skip else rows


def url_manifest(lines: DataFrame) -> DataFrame:
    """(url, file_name, scale) of a list of download addresses, by their fileName parameter."""
    name = F.try_parse_url(F.col("value"), F.lit("QUERY"), F.lit("fileName"))
    return lines.select(F.col("value").alias("url"), name.alias("file_name"), F.regexp_extract(name, r"(?i)spei[_-]?(\d{1,2})", 1).try_cast("int").alias("scale")).where("file_name IS NOT NULL")


def retried(call, attempts: int = 6, first: float = 30.0, sleep=None):
    """call(), again after a failure to read, with waits that double from `first` seconds; the last failure is raised."""
    import time

    for k in range(attempts):
        try:
            return call()
        except OSError:
            if k == attempts - 1:
                raise
            (sleep or time.sleep)(first * 2**k)


def one_per_variable(files: DataFrame, variables: list[str]) -> DataFrame:
    """(variable, path) of the files whose names begin with a variable; raises unless each has exactly one."""
    name = F.element_at(F.split("path", "/"), -1)
    known = files.sparkSession.createDataFrame([(v,) for v in variables], "variable string")
    rows = files.select("path", name.alias("name")).join(F.broadcast(known), F.expr("startswith(lower(name), lower(variable) || '_')"), "right")
    wrong = rows.groupBy("variable").agg(F.count("path").alias("n")).where("n <> 1").collect()
    if wrong:
        raise ValueError(f"files by variable: {[tuple(r) for r in wrong]}, need one each")
    return rows.select("variable", "path")
