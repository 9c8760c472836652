"""Structured Streaming over reads that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions.dna import kmer_rows


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """A stream of the parquet files of a folder with the schema of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def reads_once(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Rows of a read that is sent again within the delay are dropped; state older than the watermark is forgotten."""
    return stream.filter("read_idx is not null and seq is not null").withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["read_idx"])


def kmer_counts(stream: DataFrame, k: int) -> DataFrame:
    """(kmer, t) of the reads so far, for update or complete mode."""
    return kmer_rows(stream, "seq", k).groupBy("kmer").agg(F.count("*").alias("t"))


def loads_by_window(stream: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(beg, cell, n_reads, n_bases) by windows of loaded_at, for append mode; rows later than the watermark are left out."""
    return (
        stream.withWatermark("loaded_at", delay)
        .groupBy(F.window("loaded_at", window).alias("w"), "cell")
        .agg(F.count("*").alias("n_reads"), F.sum(F.coalesce(F.length("seq"), F.lit(0))).alias("n_bases"))
        .select(F.col("w.start").alias("beg"), "cell", "n_reads", "n_bases")
    )


def finished(stream: DataFrame, mode: str, path: str, checkpoint: str) -> None:
    """Works through what has arrived and stops; batches are merged into a table by the caller or appended to `path`."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def last_counts(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes the counts after each batch to <path>/batch=<n>, of which the last holds the result (complete mode)."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n:06d}")

    stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
