"""Shared helpers: tables, the shared folder, files written by tasks, connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package when they run beside the driver's checkout."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    env.setdefault("TOKENIZERS_PARALLELISM", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder as a URI; a temporary one only where none is set and Spark is local."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="drywell-")
        spark.conf.set("spark.checkpoint.dir", top)
    if "://" not in top:
        top = "file:" + top if top.startswith("//") else "file://" + top
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(top)
    return top


#: The folder, below the shared one, that `fresh` names paths in.
_inside: ContextVar[str] = ContextVar("inside", default="")


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{_inside.get()}{what}-{uuid.uuid4().hex}"


@contextmanager
def inside(spark: SparkSession, what: str):
    """Paths named in this block are in one new folder, which is given; whoever opens it removes it."""
    folder = fresh(spark, what)
    token = _inside.set(f"{folder.rsplit('/', 1)[1]}/")
    try:
        yield folder
    finally:
        _inside.reset(token)


def remove(spark: SparkSession, path: str) -> None:
    """Takes away a path of the shared folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark take away the shuffle files of tables that nothing refers to any more; it does so only when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """df as Parquet in the shared folder, read back, and its path."""
    path = fresh(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    return stored(df, what)[0]


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it; works alike on the driver and in tasks."""
    return pafs.FileSystem.from_uri(uri)


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def connected_components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(a, b) links between longs to (node, root): root is the smallest node reachable.

    Alternating large-star and small-star rounds, each written to the shared folder. A hub's star
    is dealt by node with only its minimum aggregated, and links to the minimum are emitted by a
    join, so no neighbour list is ever gathered. No links give no rows; self-links give (a, a).
    """
    both = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null").distinct()
    current, path = stored(both, what)
    while True:
        # Large star: every larger neighbour of a node links to the smallest of its neighbourhood.
        sym = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sym.where("b >= a").join(low, "a").select(F.col("m").alias("a"), F.col("b")).distinct()
        # Small star: every neighbour not larger links to the smallest.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y"), F.col("b").alias("z"))
        step = small.select(F.col("x").alias("a"), F.explode(F.array("y", "z")).alias("b")).where("a <= b").distinct()
        after, place = stored(step, what)
        ended = after.count() == current.count() and after.subtract(current).isEmpty()
        remove(edges.sparkSession, path)
        if ended:
            break
        current, path = after, place
    return after.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
