"""Agreement of growing products: monthly partial sums as a resumable stream."""

from __future__ import annotations

import json

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.consistency import agreement, merged, partial_sums, pixel_correlation

SCHEMA = "product string, scale int, month string, row int, col int, ours double, ref double"


def accumulate(spark: SparkSession, source: str, target: str, checkpoint: str, keys: tuple[str, ...] = ("product", "scale", "month"), schema: str = SCHEMA):
    """Takes the files of pairs that have come since the last run and stores each batch's sums under its number.

    A batch that is run again replaces its own sums, so a crash never counts pairs twice. Returns the
    finished query.
    """

    def store(batch: DataFrame, number: int) -> None:
        partial_sums(batch, list(keys)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def state(spark: SparkSession, target: str, keys: tuple[str, ...] = ("product", "scale")) -> DataFrame:
    """Agreement by keys over all batches so far."""
    return agreement(merged(spark.read.option("basePath", target).parquet(target), list(keys)), list(keys))


#: What a state is kept by.
KINDS = {"pixel": ("product", "scale", "row", "col"), "region": ("product", "scale", "region_id")}
REGIONAL = SCHEMA + ", region_id int"


def _bound(target: str, shape: tuple[int, int], months: list[str]) -> None:
    """Stores what a state is for when it begins; raises if it is for another shape or list of months."""
    files, base = pafs.FileSystem.from_uri(target)
    own, path = {"shape": list(shape), "months": sorted(months)}, f"{base}/_for.json"
    if files.get_file_info(path).type == pafs.FileType.NotFound:
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{path}.part") as out:
            out.write(json.dumps(own).encode())
        files.move(f"{path}.part", path)
        return
    with files.open_input_file(path) as f:
        if (there := json.loads(f.read())) != own:
            raise ValueError(f"the state in {target} is for a grid of {there['shape']} and {len(there['months'])} months, not {own['shape']} and {len(own['months'])}")


def _parts(target: str, kind: str) -> tuple[int, list[int]]:
    """(last batch in the newest whole snapshot, -1 for none; later batches) of a state."""
    files, base = pafs.FileSystem.from_uri(f"{target}/{kind}")
    names = [x.base_name for x in files.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if files.get_file_info(f"{x.path}/_SUCCESS").type != pafs.FileType.NotFound]
    last = max((int(n.split("=")[1]) for n in names if n.startswith("snapshot=")), default=-1)
    return last, sorted(int(n.split("=")[1]) for n in names if n.startswith("batch=") and int(n.split("=")[1]) > last)


def sums(spark: SparkSession, target: str, kind: str) -> DataFrame | None:
    """The merged sums of a state by its keys: the newest snapshot and the batches after it; none before the first batch."""
    last, later = _parts(target, kind)
    paths = ([f"{target}/{kind}/snapshot={last}"] if last >= 0 else []) + [f"{target}/{kind}/batch={b}" for b in later]
    return merged(spark.read.parquet(*paths), list(KINDS[kind])) if paths else None


def accumulate_state(spark: SparkSession, source: str, target: str, checkpoint: str, shape: tuple[int, int], months: list[str], compact: int = 8):
    """Takes the files of pairs (REGIONAL) that have come since the last run into states by pixel and by region.

    Each batch's sums are stored under its number, so one that runs again replaces its own; after
    `compact` batches their sums and the last snapshot's become a new snapshot, which counts only once it
    is whole, and from then on in their place: a batch that runs again after that changes nothing. Regions
    of id 0 or none are no region. A target that was begun for another shape or list of months is
    refused, as are pairs outside the shape or the months. Returns the finished query.
    """
    _bound(target, shape, months)
    inside = F.col("row").between(0, shape[0] - 1) & F.col("col").between(0, shape[1] - 1) & F.col("month").isin(list(months))

    def store(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if (bad := batch.where(~F.coalesce(inside, F.lit(False))).limit(1).collect()):
                raise ValueError(f"pairs outside the state's grid and months: {bad[0].asDict()}")
            for kind, keys in KINDS.items():
                rows = batch if kind == "pixel" else batch.where("region_id > 0")
                partial_sums(rows, list(keys)).write.mode("overwrite").parquet(f"{target}/{kind}/batch={number}")
        finally:
            batch.unpersist()
        for kind in KINDS:
            last, later = _parts(target, kind)
            if len(later) >= compact:
                sums(batch.sparkSession, target, kind).write.mode("overwrite").parquet(f"{target}/{kind}/snapshot={later[-1]}")

    stream = spark.readStream.schema(REGIONAL).parquet(source)
    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def pixel_state(spark: SparkSession, target: str, least: int = 3) -> DataFrame:
    """(product, scale, row, col, n, r) of all months so far; r is null with fewer than `least`."""
    return pixel_correlation(sums(spark, target, "pixel"), list(KINDS["pixel"]), least)


def region_state(spark: SparkSession, target: str) -> DataFrame:
    """Agreement by product, scale and region of all months so far."""
    return agreement(sums(spark, target, "region"), list(KINDS["region"]))


def monthly_alerts(spark: SparkSession, source: str, schema: str, threshold: float = -1.0, delay: str = "1 day") -> DataFrame:
    """A stream of (window, station_id, n, low): readings by station and 30 days of event time `ts`, and how many are at or below the threshold."""
    rows = spark.readStream.schema(schema).parquet(source).withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", "30 days").alias("window"), "station_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") <= threshold).alias("low"))
