"""Writers of the domain's text formats. A path must not exist yet; every task writes a file of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_fasta(df: DataFrame, path: str, header: str = "header", seq: str = "seq") -> None:
    """'>' is put before headers that lack it; null sequences are written empty."""
    head = F.when(F.col(header).startswith(">"), F.col(header)).otherwise(F.concat(F.lit(">"), F.col(header)))
    df.select(F.concat(head, F.lit("\n"), F.coalesce(seq, F.lit("")))).write.text(path)


def write_fastq(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit("@"), "header", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")).write.text(path)


def write_creads(df: DataFrame, path: str) -> None:
    """Rows (ktmers, dists) as 'd0 kt1 d1 ...'."""
    rest = F.transform(F.sequence(F.lit(0), F.size("ktmers") - 1), lambda i: F.concat_ws(" ", F.get("ktmers", i), F.get("dists", i + 1).cast("string")))
    line = F.concat_ws(" ", F.get("dists", F.lit(0)).cast("string"), F.when(F.size("ktmers") > 0, F.array_join(rest, " ")))
    df.select(line).write.text(path)


def write_headers_index(df: DataFrame, path: str) -> None:
    """(kmer, read_ids) as 'kt h1 h2 ...'."""
    df.select(F.concat_ws(" ", "kmer", F.array_join("read_ids", " "))).write.text(path)


def write_edges(df: DataFrame, path: str) -> None:
    """(src, dst, dist) as 'kt n1 d1 n2 d2 ...', the nearest first; a node's edges are one line."""
    near = F.array_sort(F.collect_list(F.struct(F.abs("dist").alias("a"), "dst", "dist")))
    df.groupBy("src").agg(near.alias("l")).select(F.concat_ws(" ", "src", F.array_join(F.transform("l", lambda x: F.concat_ws(" ", x["dst"], x["dist"].cast("string"))), " "))).write.text(path)


def write_contigs(df: DataFrame, path: str) -> None:
    """(contig, header, seq): a folder for each contig."""
    df.select(F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value"), "contig").write.partitionBy("contig").text(path)


def write_nhoods(df: DataFrame, path: str) -> None:
    """(base, header, seq): a folder for each base."""
    write_contigs(df.withColumnRenamed("base", "contig"), path)


def write_nhood_index(df: DataFrame, path: str) -> None:
    """(base, neighbour) as 'base n1 n2 ...'."""
    df.groupBy("base").agg(F.array_sort(F.collect_set("neighbour")).alias("l")).select(F.concat_ws(" ", F.col("base").cast("string"), F.array_join(F.transform("l", lambda x: x.cast("string")), " "))).write.text(path)


def dot_lines(edges: DataFrame, genomic: DataFrame) -> DataFrame:
    """(line): the edges and nodes of a Graphviz digraph; nodes of the genome black, others red."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    known = genomic.select("node").distinct().withColumn("g", F.lit(1))
    colour = F.when(F.col("g") == 1, "black").otherwise("red")
    named = nodes.join(known, "node", "left").select(F.format_string('"%s" [color=%s];', "node", colour).alias("line"))
    return named.unionByName(edges.select(F.format_string('"%s" -> "%s";', "src", "dst").alias("line")))


def write_dot(edges: DataFrame, genomic: DataFrame, path: str) -> None:
    """One Graphviz file, which a drawing program reads whole; for graphs that can be drawn."""
    spark = edges.sparkSession
    body = dot_lines(edges, genomic).withColumn("k", F.lit(1))
    frame = spark.createDataFrame([("digraph G {", 0), ("}", 2)], "line string, k int")
    body.unionByName(frame).repartitionByRange(1, "k").sortWithinPartitions("k", "line").select("line").write.text(path)


def write_lines(df: DataFrame, path: str, value: str) -> None:
    """One value per line, such as coverages or lengths."""
    df.select(F.col(value).cast("string")).write.text(path)


def write_report(df: DataFrame, path: str) -> None:
    """Rows as 'name = value' fields, one row a line."""
    fields = [F.concat(F.lit(f"{c} = "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns]
    df.select(F.concat_ws("\t", *fields)).write.text(path)
