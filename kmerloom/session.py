"""Session set-up and the few helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a side may have, counted beforehand, to be broadcast.
BROADCAST_ROWS = 50_000


def local_session(cpus: int | str = 8, name: str = "kmerloom", **conf: str) -> SparkSession:
    """A local session as tests and the bench use it; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("KMERLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir where the cluster names one.

    Only where it is unset and the master is local (tests, a laptop) a folder of this
    machine is used; a cluster without the setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="kmerloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The rows of df, written once to the shared folder and read again; zstd pays for long sequences.

    Cuts the lineage: a lost executor costs a re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a bounded count finds at most `limit` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def one_row_per_key(df: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """One row of each non-null `key`; repeated rows of a key are taken to be equal.

    Only the keys are shuffled to find those that repeat. If these are few (counted
    first), just their rows are shuffled; otherwise all rows are.
    """
    rows = df.filter(F.col(key).isNotNull())
    twice = rows.groupBy(key).count().filter("count > 1").select(key).limit(limit + 1).collect()
    if not twice:
        return rows
    if len(twice) > limit:
        return rows.dropDuplicates([key])
    spark = df.sparkSession
    ids = F.broadcast(spark.createDataFrame(twice, rows.select(key).schema))
    return rows.join(ids, key, "left_anti").unionByName(rows.join(ids, key, "left_semi").dropDuplicates([key]))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with dense numbers from 0 in `name`, in no particular order.

    Only one count per written partition passes through a window, never the rows.
    """
    raw = stored(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = raw.groupBy(part.alias("_part")).count()
    before = sizes.select(
        "_part",
        F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    return (
        raw.withColumn("_part", part)
        .join(F.broadcast(before), "_part")  # a row for each written partition
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_before", "_at")
    )
