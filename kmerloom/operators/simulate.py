"""Simulated genomes and reads, drawn by hashes of a seed, so every run gives the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shares of matches, mismatches, insertions and deletions of the simulated reads.
ERRORS = (0.853, 0.014, 0.108, 0.025)
PIECE = 1000


def genome(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(piece, seq): a random genome of n bases in pieces of 1000."""
    digit = lambda i: F.substring(F.lit("ACGT"), (F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(4)) + 1).cast("int"), F.lit(1))
    size = F.least(F.lit(PIECE), n - F.col("id") * PIECE)
    return spark.range(-(-n // PIECE)).select(F.col("id").alias("piece"), F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), size), digit), "").alias("seq"))


def tiled_reads(contigs: DataFrame, read_len: int, per_contig: int) -> DataFrame:
    """(contig, i, half, beg, end, seq): reads that begin at i * len / per_contig; those that pass the end are the halves a and b."""
    beg = F.expr(f"cast(i * len div {per_contig} as int)")
    placed = contigs.select("contig", "seq", F.col("len").cast("int").alias("len"), F.explode(F.sequence(F.lit(0), F.lit(per_contig - 1))).alias("i")).withColumn("beg", beg).withColumn("end", F.col("beg") + F.least(F.lit(read_len), F.col("len")))
    parts = F.when(F.col("end") <= F.col("len"), F.array(F.struct(F.lit("").alias("half"), F.col("beg").alias("b"), F.col("end").alias("e")))).otherwise(
        F.array(F.struct(F.lit("a").alias("half"), F.col("beg").alias("b"), F.col("len").alias("e")), F.struct(F.lit("b").alias("half"), F.lit(0).alias("b"), (F.col("end") - F.col("len")).alias("e")))
    )
    return placed.withColumn("p", F.explode(parts)).select("contig", "i", "p.half", F.col("p.b").alias("beg"), F.col("p.e").alias("end"), F.expr("substring(seq, p.b + 1, p.e - p.b)").alias("seq"))


def with_errors(reads: DataFrame, key: list[str], seed: int = 1, shares: tuple[float, ...] = ERRORS) -> DataFrame:
    """reads(*key, seq) with noisy sequences and counts (mat, mis, ins, del); the draw of a read rests on its key."""

    def noisy(raw: bytes, at: int) -> tuple[bytes, list[int]]:
        rng = np.random.default_rng([seed, at & 0x7FFFFFFFFFFFFFFF])
        out, counts, i = bytearray(), [0, 0, 0, 0], 0
        edges = np.cumsum(shares)
        while i < len(raw):
            kind = min(3, int(np.searchsorted(edges, rng.random() * edges[-1], "right")))
            counts[kind] += 1
            if kind == 0:
                out.append(raw[i])
            elif kind == 1:
                out.append(rng.choice([b for b in b"ACGT" if b != raw[i]]))
            elif kind == 2:
                out.append(b"ACGT"[rng.integers(4)])
                continue
            i += 1
        return bytes(out), counts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [noisy((s or "").encode(), h) for s, h in zip(batch.column("seq").to_pylist(), batch.column("_h").to_pylist())]
            keys = [batch.column(k) for k in key]
            counts = np.array([c for _, c in done], np.int32).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*keys, pa.array([s.decode() for s, _ in done], pa.string()), *(pa.array(counts[:, j]) for j in range(4))], [*key, "seq", "mat", "mis", "ins", "del"])

    kinds = ", ".join(f"{k} {reads.schema[k].dataType.simpleString()}" for k in key)
    return reads.select(*key, "seq", F.xxhash64(*key).alias("_h")).mapInArrow(work, f"{kinds}, seq string, mat int, mis int, ins int, del int")


def down_sampled(rows: DataFrame, group: str, key: str, step: int = 5, seed: int = 1) -> DataFrame:
    """(group, size, key): for every multiple of `step` up to a group's size the first so many rows in one random order."""
    from pyspark.sql import Window

    order = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), key), key)
    ranked = rows.select(group, key, F.row_number().over(order).alias("r"), F.count("*").over(Window.partitionBy(group)).alias("n"))
    least = F.expr(f"cast(ceil(r / {step}) * {step} as int)")
    most = F.expr(f"cast(n div {step} * {step} as int)")
    return ranked.withColumn("lo", least).withColumn("hi", most).filter("lo <= hi").select(group, F.explode(F.sequence("lo", "hi", F.lit(step))).alias("size"), key)
