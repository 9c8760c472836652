"""Readers of the domain's text formats as DataFrames. Paths may name a file, a folder or a pattern.

Lines that don't fit a format give no row; empty files give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return spark.read.options(**options).text(path)


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.split(F.trim("value"), r"\s+").alias("t")).filter("t[0] <> ''")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line): lines in the order of their file. A file is read as a whole row: for reports and logs, not for reads."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))


def read_fasta(spark: SparkSession, path: str, upper: bool = True, first_line_only: bool = False) -> DataFrame:
    """(header, seq): records that begin with '>'; sequence lines are joined and trimmed.

    Comments (';') and blank lines before the first record are no record. upper=False
    keeps the case; first_line_only takes the first line after the header only.
    Files are split between records, so they may be of any size.
    """
    records = _lines(spark, path, lineSep="\n>").filter("left(ltrim(value), 1) <> ';'").select(F.regexp_replace("value", "^>", "").alias("r"))
    lines = F.split("r", "\r?\n")
    seq = F.trim(F.get(lines, F.lit(1))) if first_line_only else F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), ""), r"\s", "")
    return records.select(F.trim(F.element_at(lines, 1)).alias("header"), F.coalesce(F.upper(seq) if upper else seq, F.lit("")).alias("seq")).filter("header <> ''")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(header, seq, qual): records of four lines '@' header, sequence, '+', quality.

    A quality may begin with '@', so records can't be told from a part of a file: a file
    is read whole by one task. Records with lines missing are dropped.
    """
    rows = _numbered_lines(spark, path).withColumn("rec", F.expr("n div 4")).groupBy("file", "rec").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    line = lambda i: F.trim(F.get("l", F.lit(i))["line"])
    whole = rows.filter(F.size("l") == 4).filter(line(0).startswith("@") & line(2).startswith("+"))
    return whole.select(F.substring(line(0), F.lit(2), F.length(line(0))).alias("header"), F.upper(line(1)).alias("seq"), line(3).alias("qual"))


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """(header, seq) of the first record."""
    return read_fasta(spark, path).limit(1)


def read_creads(spark: SparkSession, path: str) -> DataFrame:
    """(line, ktmers, dists) from 'd0 kt1 d1 kt2 ...'; `line` numbers the lines of the file."""
    t = _numbered_lines(spark, path).select("n", F.split(F.trim("line"), r"\s+").alias("t")).filter("t[0] <> ''")
    return t.select(F.col("n").alias("line"), F.expr("filter(t, (x, i) -> i % 2 = 1)").alias("ktmers"), F.expr("transform(filter(t, (x, i) -> i % 2 = 0), x -> cast(x as int))").alias("dists"))


def read_headers_index(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, read_id), distinct, from 'kt h1 h2 ...'."""
    return _tokens(spark, path).select(F.expr("t[0]").alias("kmer"), F.explode(F.expr("slice(t, 2, size(t))")).alias("read_id")).distinct()


def read_headers_index_old(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, read_id, dist_to_start, dist_to_end) from 'kt h pos dist h pos dist ...'."""
    x = F.explode(F.expr("transform(sequence(0, cast((size(t) - 1) div 3 as int) - 1), i -> struct(t[3 * i + 1] as h, cast(t[3 * i + 2] as int) as b, cast(t[3 * i + 3] as int) as e))"))
    return _tokens(spark, path).filter("size(t) > 3").select(F.expr("t[0]").alias("kmer"), x.alias("x")).select("kmer", F.col("x.h").alias("read_id"), F.col("x.b").alias("dist_to_start"), F.col("x.e").alias("dist_to_end"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, dist) from 'kt n1 d1 n2 d2 ...'."""
    x = F.explode(F.expr("transform(sequence(0, cast((size(t) - 1) div 2 as int) - 1), i -> struct(t[2 * i + 1] as dst, cast(t[2 * i + 2] as int) as dist))"))
    return _tokens(spark, path).filter("size(t) > 2").select(F.expr("t[0]").alias("src"), x.alias("x")).select("src", "x.dst", "x.dist")


#: The columns of the alignment formats, in order.
M1_COLUMNS = "q_name string, t_name string, q_strand int, t_strand int, score int, accuracy double, t_beg int, t_end int, t_len int, q_beg int, q_end int, q_len int, n_cells int"
M5_COLUMNS = "q_name string, q_len int, q_beg int, q_end int, q_strand string, blank string, t_name string, t_len int, t_beg int, t_end int, t_strand string, score int, n_match int, n_mismatch int, n_ins int, n_del int, map_qv int, q_aligned string, pattern string, t_aligned string"


def _columns(t: Column, names: str) -> list[Column]:
    return [t[i].try_cast(kind).alias(name) for i, (name, kind) in enumerate(x.split() for x in names.split(", "))]


def read_m1(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of 13 tokens; of longer lines (a preamble in front) the last 13."""
    return _tokens(spark, path).filter("size(t) >= 13").select(F.expr("slice(t, size(t) - 12, 13)").alias("t")).select(*_columns(F.col("t"), M1_COLUMNS)).filter("score is not null")


def read_m5(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of 20 tokens after splitting on single blanks; the empty one is dropped."""
    return _lines(spark, path).select(F.split("value", " ").alias("t")).filter("size(t) >= 20").select(*_columns(F.col("t"), M5_COLUMNS)).drop("blank").filter("score is not null")


def read_m0(spark: SparkSession, path: str) -> DataFrame:
    """(query, q_beg, q_end, q_total, t_beg, t_end) from verbose alignments.

    A query line ('Q' in column 9) opens a record, the range lines of the query
    ('Q' in column 3) and the target ('T' in column 2) belong to the last one opened.
    """
    lines = _numbered_lines(spark, path)
    kind = F.when(F.expr("substring(line, 10, 1) = 'Q'"), "name").when(F.expr("substring(line, 4, 1) = 'Q'"), "q").when(F.expr("substring(line, 3, 1) = 'T'"), "t")
    opened = lines.select("file", "n", "line", kind.alias("kind")).filter("kind is not null").withColumn("rec", F.count_if(F.col("kind") == "name").over(Window.partitionBy("file").orderBy("n")))
    number = F.transform(F.regexp_extract_all("line", F.lit(r"(\d+)"), 1), lambda x: x.cast("bigint"))
    pick = lambda k, e: F.first(F.when(F.col("kind") == k, e), ignorenulls=True)
    return (
        opened.filter("rec > 0")
        .withColumn("x", number)
        .groupBy("file", "rec")
        .agg(
            pick("name", F.regexp_extract("line", r":\s*(\S+)", 1)).alias("query"), pick("q", F.expr("get(x, 0)")).alias("q_beg"), pick("q", F.expr("get(x, 1)")).alias("q_end"),
            pick("q", F.expr("get(x, 2)")).alias("q_total"), pick("t", F.expr("get(x, 0)")).alias("t_beg"), pick("t", F.expr("get(x, 1)")).alias("t_end"),
        )
        .drop("file", "rec")
    )


def read_m0_accuracies(spark: SparkSession, path: str) -> DataFrame:
    """(accuracy) of the lines with '%' in column 6: their last token."""
    return _lines(spark, path).filter("substring(value, 7, 1) = '%'").select(F.element_at(F.split(F.trim("value"), r"\s+"), -1).try_cast("double").alias("accuracy")).filter("accuracy is not null")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """(name, pos, seq) of the alignment lines."""
    return _lines(spark, path).filter("left(value, 1) <> '@'").select(F.split("value", r"\s+").alias("t")).filter("size(t) > 9").select(F.expr("t[0]").alias("name"), F.expr("try_cast(t[3] as double)").alias("pos"), F.expr("t[9]").alias("seq"))


def read_overlap_info(spark: SparkSession, path: str) -> DataFrame:
    """(base, ext, shift, chimeric): 'Right base ext shift' lines with the flag of the last 'Chimeric' or 'NonChimeric' line before."""
    lines = _numbered_lines(spark, path).select("file", "n", F.split(F.trim("line"), r"\s+").alias("t"))
    flag = F.when(F.expr("t[0] = 'Chimeric'"), True).when(F.expr("t[0] = 'NonChimeric'"), False)
    carried = lines.withColumn("chimeric", F.last(flag, ignorenulls=True).over(Window.partitionBy("file").orderBy("n")))
    return carried.filter("t[0] = 'Right' and size(t) >= 4").select(F.expr("t[1]").alias("base"), F.expr("t[2]").alias("ext"), F.expr("try_cast(t[3] as int)").alias("shift"), "chimeric")


def read_kmer_report(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, degree, t, correct, pos_mean) of lines 'KMER Deg = D t = T correct|incorrect ...'."""
    pattern = r"^\s*([ACGTacgt]+)\s+Deg\s*=\s*(\d+)\s+t\s*=\s*(\d+)\s+(correct|incorrect)(?:\s+pos\s*=\s*([-+.\deE]+))?"
    g = lambda i: F.regexp_extract("value", pattern, i)
    return _lines(spark, path).filter(F.col("value").rlike(pattern)).select(g(1).alias("kmer"), g(2).cast("int").alias("degree"), g(3).cast("int").alias("t"), (g(4) == "correct").alias("correct"), F.nullif(g(5), F.lit("")).cast("double").alias("pos_mean"))


def read_trimmed_lines(spark: SparkSession, path: str, head: int = 0, tail: int = 0) -> DataFrame:
    """(n, line): the lines without the first `head` and last `tail`; an empty last line is no line."""
    lines = _numbered_lines(spark, path)
    total = F.max(F.when(F.col("line") != "", F.col("n") + 1)).over(Window.partitionBy("file"))
    return lines.withColumn("total", total).filter((F.col("n") >= head) & (F.col("n") < F.col("total") - tail)).select("n", "line")


def read_contig_locations(spark: SparkSession, path: str, longer_than: int = 18) -> DataFrame:
    """(start, end, seq) of lines '[start] [end] SEQ' with more than 18 bases."""
    pattern = r"^\s*\[?([-\d.]+)\]?\s+\[?([-\d.]+)\]?\s+([ACGTacgt]+)\s*$"
    return _lines(spark, path).filter(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).try_cast("double").alias("start"), F.regexp_extract("value", pattern, 2).try_cast("double").alias("end"), F.regexp_extract("value", pattern, 3).alias("seq")).filter(F.length("seq") > longer_than)


def read_ktmer_list(spark: SparkSession, path: str) -> DataFrame:
    """(kmer): first tokens without commas, lines of 'Found' skipped."""
    return _lines(spark, path).select(F.element_at(F.split(F.trim(F.translate("value", ",", "")), r"\s+"), 1).alias("kmer")).filter("kmer <> '' and kmer <> 'Found'")


def nhood_name(col: Column) -> list[Column]:
    """pos and kmer of a file name nhood_nh<pos>_<ktmer>.fasta."""
    return [F.nullif(F.regexp_extract(col, r"nh(\d+)_", 1), F.lit("")).cast("bigint").alias("pos"), F.nullif(F.regexp_extract(col, r"nh\d+_([ACGTacgt]+)", 1), F.lit("")).alias("kmer")]


def read_nhoods(spark: SparkSession, folder: str, pattern: str = "*nh*_*.fasta") -> DataFrame:
    """(file, pos, kmer, header, seq) of a folder of neighbourhoods; place and kt-mer come from the file names. Files are read whole."""
    whole = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    records = whole.select(F.col("_metadata.file_name").alias("file"), F.explode(F.split(F.concat(F.lit("\n"), "value"), "\n>")).alias("r")).filter("trim(r) <> ''")
    lines = F.split("r", "\r?\n")
    return records.select("file", *nhood_name(F.col("file")), F.trim(lines[0]).alias("header"), F.upper(F.array_join(F.slice(lines, 2, F.size(lines)), "")).alias("seq"))


def read_consensuses(spark: SparkSession, folder: str) -> DataFrame:
    """(file, header, seq) of the files *corr.fasta."""
    return read_nhoods(spark, folder, "*corr.fasta").select("file", "header", "seq")


def read_matching_log(spark: SparkSession, path: str) -> DataFrame:
    """(source, pos, header): headers between a line with a file name and the next blank line."""
    lines = _numbered_lines(spark, path)
    order = Window.partitionBy("file").orderBy("n")
    state = F.when(F.trim("line") == "", "").when(F.col("line").startswith("/"), F.col("line"))
    held = lines.withColumn("source", F.last(state, ignorenulls=True).over(order))
    return held.filter("left(line, 1) = '>' and source <> ''").select("source", nhood_name(F.col("source"))[0], F.regexp_replace("line", "^>", "").alias("header"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(header) of the lines that begin with '>'."""
    return _lines(spark, path).filter("left(value, 1) = '>'").select(F.trim(F.expr("substring(value, 2)")).alias("header"))


def read_replacement_plan(spark: SparkSession, path: str) -> DataFrame:
    return _tokens(spark, path).filter("size(t) >= 6").select(*_columns(F.col("t"), "read_id string, beg int, end int, consensus string, ec_beg int, ec_end int")).filter("beg is not null")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(base, neighbour) from 'base: n1 n2 ...' or 'base n1 n2 ...'."""
    t = _lines(spark, path).select(F.split(F.trim(F.translate("value", ":", " ")), r"\s+").alias("t")).filter("size(t) > 1")
    return t.select(F.expr("try_cast(t[0] as bigint)").alias("base"), F.explode(F.expr("transform(slice(t, 2, size(t)), x -> try_cast(x as bigint))")).alias("neighbour")).filter("base is not null and neighbour is not null")


def read_list_log(spark: SparkSession, path: str) -> DataFrame:
    """(n, items) of lines like "['12', 'ACGT', '7']"."""
    return _numbered_lines(spark, path).filter("line like '[%'").select("n", F.transform(F.split(F.regexp_replace("line", r"[\[\]'\"]", ""), ","), lambda x: F.trim(x)).alias("items"))
