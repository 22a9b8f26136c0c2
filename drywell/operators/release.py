"""Checks of a data release: coverage, geometry, tags, totals and checksums."""

from __future__ import annotations

import hashlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import settled

#: First and last month of each timescale.
COVERAGE = {1: ("1979-01", "2018-12"), 3: ("1979-03", "2018-12"), 6: ("1979-06", "2018-12"), 12: ("1979-12", "2018-12"), 24: ("1980-12", "2018-12")}
GEOMETRY = ("width", "height", "crs", "transform_a", "transform_b", "transform_c", "transform_d", "transform_e", "transform_f", "nodata", "dtype")


def coverage(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """keys and status ('missing' or 'extra') of keys that only one side has."""
    a, b = expected.select(*keys).distinct(), observed.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("status", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("status", F.lit("extra")))


def geometry_counts(inventory: DataFrame, by: list[str], columns: tuple[str, ...] = GEOMETRY) -> DataFrame:
    """Distinct geometries by group; 1 where consistent. Missing parts count as a value."""
    parts = [c for c in columns if c in inventory.columns]
    key = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(c) for c in parts))
    return inventory.groupBy(*by).agg(F.count_distinct(key).alias("n_geometries"))


def totals(inventory: DataFrame, by: list[str]) -> DataFrame:
    """Files, bytes and GiB (to three places) by group."""
    size = F.sum("size_bytes")
    return inventory.groupBy(*by).agg(F.count("*").alias("n_files"), size.alias("total_size_bytes"), F.bround(size / float(1 << 30), 3).alias("total_size_gib"))


def tag_faults(inventory: DataFrame, by: list[str], expected: dict[str, str]) -> DataFrame:
    """For each tag whether any row differs from what is expected; a missing tag differs."""
    return inventory.groupBy(*by).agg(*(F.bool_or(~F.coalesce(F.col(c) == v, F.lit(False))).alias(f"{c}_differs") for c, v in expected.items()))


def inspect(inventory: DataFrame, expected: DataFrame, by: str = "timescale", tags: dict[str, str] | None = None) -> DataFrame:
    """Totals by timescale; raises with the first faults if months, geometry or tags aren't as expected."""
    tags = tags or {"cmfd_spatial_method": "bilinear", "soil_predictors": "excluded", "generation_complete": "true"}
    gaps = coverage(expected, inventory, [by, "month"]).orderBy(by, "month").limit(10).collect()
    mixed = geometry_counts(inventory, [by]).where("n_geometries <> 1").limit(10).collect()
    faults = tag_faults(inventory, [by], tags)
    wrong = faults.where(" OR ".join(f"`{c}_differs`" for c in tags)).limit(10).collect()
    across = geometry_counts(inventory, []).first()["n_geometries"]
    if gaps or mixed or wrong or across > 1:
        raise ValueError(f"release differs: months {[tuple(r) for r in gaps]}, geometry {[tuple(r) for r in mixed]} ({across} in all), tags {[tuple(r) for r in wrong]}")
    return totals(inventory, [by])


#: Bytes that a checksum reads at a time.
READ_BYTES = 16 << 20


def file_listing(spark, path: str, glob: str = "*", checksums: bool = False) -> DataFrame:
    """(archive_name, size_bytes, size_gib, sha256 if asked for) of files of any size but 0 (Spark leaves empty files out); contents are read only for checksums, READ_BYTES at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("size_bytes"))
    out = [F.element_at(F.split("path", "/"), -1).alias("archive_name"), "size_bytes", F.bround(F.col("size_bytes") / float(1 << 30), 3).alias("size_gib")]
    if not checksums:
        return files.select(*out)

    return checksummed(files).select(*out, "sha256")


def checksummed(files: DataFrame) -> DataFrame:
    """(path, size_bytes, sha256) of files (path, size_bytes), dealt over all tasks, READ_BYTES at a time."""

    def run(batches):
        for batch in batches:
            sums = []
            for name in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                fs, at = pafs.FileSystem.from_uri(quote(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name, safe=":/"))
                with fs.open_input_stream(at) as source:
                    while block := source.read(READ_BYTES):
                        digest.update(block)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.string())], names=["path", "size_bytes", "sha256"])

    each = files.select("path", "size_bytes").repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return each.mapInArrow(run, "path string, size_bytes long, sha256 string")


def current_manifest(spark, path: str, manifest: DataFrame, glob: str = "*") -> DataFrame:
    """(archive_name, size_bytes, size_gib, sha256, reused) of the files now there: checksums of an earlier manifest where name and size agree, the others computed. Only the latter's contents are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("size_bytes"))
    named = files.withColumn("archive_name", F.element_at(F.split("path", "/"), -1))
    told = settled(reuse_checksums(named, manifest))
    fresh = checksummed(told.where("sha256 IS NULL")).withColumn("reused", F.lit(False))
    both = told.where("sha256 IS NOT NULL").select("path", "size_bytes", "sha256", F.lit(True).alias("reused")).unionByName(fresh)
    return both.select(F.element_at(F.split("path", "/"), -1).alias("archive_name"), "size_bytes", F.bround(F.col("size_bytes") / float(1 << 30), 3).alias("size_gib"), "sha256", "reused")


def reuse_checksums(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """listing with the manifest's sha256 where name and size agree, else null (to be computed)."""
    old = manifest.groupBy("archive_name", "size_bytes").agg(F.min("sha256").alias("sha256"))
    return listing.drop("sha256").join(old, ["archive_name", "size_bytes"], "left")


def metadata_json(summary: DataFrame) -> DataFrame:
    """One row with all summary rows as a JSON array, in order; summary has a row per timescale."""
    return summary.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*summary.columns)))).alias("json"))


def assert_aligned(inventory: DataFrame) -> None:
    """Raises unless all rasters share one geometry."""
    n = geometry_counts(inventory, []).first()["n_geometries"]
    if n > 1:
        raise ValueError(f"rasters have {n} geometries")
