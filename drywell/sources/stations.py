"""Station tables from CSV: daily series, lookups, predictors, predictions; and plain sinks."""

from __future__ import annotations

import os
from fnmatch import fnmatchcase

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import STATION_ALIASES, finite, nan_to_null, rename_first

#: Bytes of a file that are read at a time, and lines that are passed on at a time.
BLOCK, LINES = 8 << 20, 50_000
#: The number of months in the name of a scale's folder.
SCALE_PATTERN = r"_(\d+)monthscale/[^/]*$"
#: Names of prediction columns, in order of preference.
PREDICTION_ALIASES = {
    "timescale": ["timescale", "scale_label", "scale", "Timescale"],
    "fold": ["fold", "Fold"],
    "station_id": ["station_id", "station", "StationID"],
    "year": ["year", "Year"],
    "month": ["month", "Month"],
    "obs": ["obs", "observed", "y_true", "truth"],
    "pred": ["pred", "predicted", "y_pred", "prediction"],
}


def _next_line(source, size: int, at: int) -> int:
    """The place of the first line that begins at `at` or after it; lines end in LF, CR LF or CR."""
    if at <= 0 or at >= size:
        return max(0, min(at, size))
    at -= 1
    while at < size:
        source.seek(at)
        data = source.read(1 << 16)
        found = [k for k in (data.find(b"\n"), data.find(b"\r")) if k >= 0]
        if found:
            end = at + min(found)
            source.seek(end)
            return end + (2 if source.read(2) == b"\r\n" else 1)
        at += len(data)
    return size


def _named(path: str) -> tuple:
    """Station and scale by a file's path."""
    return F.regexp_extract(path, r"([^/]+)\.[cC][sS][vV]$", 1).alias("station_id"), F.regexp_extract(path, SCALE_PATTERN, 1).try_cast("int").alias("scale")


def _lines(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(station_id, scale, block, row, value) of the lines of folder/*monthscale/<glob>: files are listed in a task a folder and read many a task, long ones in blocks."""
    files, base = pafs.FileSystem.from_uri(folder if ":" in folder else os.path.abspath(folder))
    found = files.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    tops = [(x.path,) for x in found if x.type == pafs.FileType.Directory and fnmatchcase(x.base_name, "*monthscale")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def listed(batches):
        for batch in batches:
            for top in batch.column(0).to_pylist():
                own = [x for x in files.get_file_info(pafs.FileSelector(top)) if x.is_file and x.base_name[0] not in "._" and fnmatchcase(x.base_name, glob)]
                for k in range(0, len(own), 10_000):
                    blocks = [(x.path, x.size, at) for x in own[k : k + 10_000] for at in range(0, x.size, BLOCK)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*blocks)) or [[]] * 3, (pa.string(), pa.int64(), pa.int64()))], names=["path", "size", "block"])

    def read(batches):
        def out(own, block, many, lines):
            each = np.repeat(np.arange(len(many)), many)
            columns = [*(c.take(pa.array(each)) for c in (pa.array([x[0] for x in own], pa.string()), pa.array([x[1] for x in own], pa.int32()), pa.array(block, pa.int64()))), pa.array(np.concatenate([np.arange(n) for n in many])), pa.array(lines, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["station_id", "scale", "block", "row", "value"])

        for batch in batches:
            held: tuple[list, list, list, list] = [], [], [], []
            for path, size, block, *own in zip(*(c.to_pylist() for c in batch.columns)):
                with files.open_input_file(path) as source:
                    start, stop = _next_line(source, size, block), _next_line(source, size, block + BLOCK)
                    source.seek(start)
                    data = source.read(max(0, stop - start))
                lines = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n").decode("utf-8", "replace").split("\n")
                if not lines[-1]:
                    lines.pop()
                for x, more in zip(held, ([own], [block], [len(lines)], lines)):
                    x.extend(more)
                if len(held[3]) >= LINES:
                    yield out(*held)
                    held = [], [], [], []
            if held[3]:
                yield out(*held)

    paths = spark.createDataFrame(tops, "top string").repartition(max(1, len(tops)), "top").mapInArrow(listed, "path string, size long, block long")
    # Files are short and many: dealt by number, not by bytes.
    return paths.select("*", *_named("path")).repartition(parts).mapInArrow(read, "station_id string, scale int, block long, row long, value string")


def _scanned(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """What `_lines` gives, by Spark's scan: for folders that only Spark can open."""
    files = spark.read.format("text").option("pathGlobFilter", glob).load(f"{folder}/*monthscale/*")
    # Blocks of a split file ascend, and so do rows in a partition: the number orders a file's lines.
    rows = files.select(*_named("_metadata.file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    return rows.withColumn("station_id", F.url_decode("station_id"))


def read_daily(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """(station_id, scale, year, doy, spei, line) of headerless year,doy,value files in folder/*_<N>monthscale/.

    Station and scale come from the path, bad cells become null, and `line` orders the records of a
    file, so the later of two records of one date is known. All folders are one pass.
    """
    try:
        files = _lines(spark, folder, glob)
    except pa.ArrowInvalid:
        files = _scanned(spark, folder, glob)
    cells = F.split("value", ",")
    rows = files.select(
        "station_id", "scale", F.struct("block", "row").alias("line"), *(F.trim(F.get(cells, F.lit(k))).alias(c) for k, c in enumerate(("year", "doy", "spei"))), F.length("value").alias("_n"),
    )
    whole = lambda c: F.col(c).try_cast("double").try_cast("int")
    rows = rows.where("_n > 0").select("station_id", "scale", whole("year").alias("year"), whole("doy").alias("doy"), finite(F.col("spei").try_cast("double")).alias("spei"), "line")
    if rows.isEmpty():
        raise FileNotFoundError(f"no *monthscale folder with {glob} files in {folder}")
    return rows


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A table with a header, types inferred but for station_id, which stays text with its leading zeros; NaN is null."""
    first = spark.read.option("header", True).option("inferSchema", True).csv(path)
    missing = [c for c in required if c not in first.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    texts = {s for s in STATION_ALIASES["station_id"]}
    schema = ", ".join(f"`{f.name}` {'string' if f.name in texts else f.dataType.simpleString()}" for f in first.schema)
    return nan_to_null(spark.read.option("header", True).schema(schema).csv(path))


def read_lookup(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Station table with station_id, lon and lat under any of their usual names; strict: all three are needed."""
    return rename_first(read_csv(spark, path), STATION_ALIASES, required=strict)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """A training table; rows without station, month or label are left out."""
    need = ("station_id", "year", "month", "spei")
    return read_csv(spark, path, need).na.drop(subset=list(need))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions with timescale, fold, obs and pred under any of their usual names; incomplete rows and unknown timescales are left out."""
    df = rename_first(read_csv(spark, path), PREDICTION_ALIASES, any_case=True)
    df = df.withColumns({"obs": finite(F.col("obs").try_cast("double")), "pred": finite(F.col("pred").try_cast("double")), "fold": F.col("fold").try_cast("int"), "timescale": F.col("timescale").cast("string")})
    return df.na.drop(subset=["timescale", "fold", "obs", "pred"]).where(F.col("timescale").isin("SPEI-1", "SPEI-3", "SPEI-6", "SPEI-12", "SPEI-24"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), overwrite: bool = False, replace_incomplete: bool = False, bom: bool = False) -> None:
    """Writes df; refuses an existing target unless told to overwrite, or to replace one that a stopped run left incomplete. The commit is atomic, _SUCCESS marks completeness.

    bom: CSV files begin with the UTF-8 byte-order mark, as spreadsheets want it; readers skip it.
    """
    overwrite = overwrite or (replace_incomplete and not is_complete(df.sparkSession, path))
    if bom:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*partition_by)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_label_set(labels: DataFrame, audit: DataFrame, summary: DataFrame, folder: str, fmt: str = "csv") -> None:
    """Labels, audit and summary of a run as tables of a folder, the labels last: a folder with labels has all three. Refuses a folder that has labels already."""
    spark = labels.sparkSession
    if is_complete(spark, f"{folder}/labels"):
        raise FileExistsError(f"{folder} has labels already")
    for name, df in (("audit", audit), ("summary", summary), ("labels", labels)):
        write_table(df, f"{folder}/{name}", fmt, overwrite=True)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a run that ended wrote the table at path."""
    done = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys the table at path doesn't have yet; makes the table if there is none."""
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    df.write.mode("append").parquet(path)


def cached(spark: SparkSession, path: str, build, key: str) -> DataFrame:
    """The table build() makes, stored under path and a key of its inputs, so a changed input is never served an old table."""
    import hashlib

    target = f"{path}/{hashlib.sha256(key.encode()).hexdigest()[:16]}"
    if not is_complete(spark, target):
        build().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
