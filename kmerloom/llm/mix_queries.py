"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.mix import Mix
from kmerloom.llm.tokens import encoded
from kmerloom.plans.registry import Registry
from kmerloom.session import stored, table

REG = Registry()


def source_name(col: str) -> Column:
    """One spelling of a source: lower case, blanks at the ends left out, those inside as underscores; null for blank names."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(col)), r"[\s_]+", "_"), F.lit(""))


def _ids(docs: DataFrame) -> DataFrame:
    return encoded(docs, "doc_id", "text").withColumnRenamed("key", "doc")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Mix]:
    docs = table(spark, sf_dir, "documents")
    counted = _ids(docs).select("doc", F.size("ids").cast("bigint").alias("n_tokens"))
    sizes = stored(docs.select(F.col("doc_id").alias("doc"), source_name("source").alias("source")).join(counted, "doc"))
    targets = table(spark, sf_dir, "mix_targets").select(source_name("source").alias("source"), "target_share", "max_repeats")
    return sizes, Mix(sizes, targets)


@REG.query("p8_mix")
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every speech: its source, tokens, how often it is used, and its source's target share and share reached."""
    sizes, mix = _mix(spark, sf_dir)
    uses = stored(mix.uses())
    total = uses.agg(F.sum("tokens_used").alias("total"))
    by_source = uses.groupBy("source").agg(F.sum("tokens_used").alias("used")).crossJoin(F.broadcast(total)).select("source", (F.col("used") / F.col("total")).alias("share_reached"))
    wanted = spark.createDataFrame([(s.source, s.target) for s in mix.shares], "source string, target_share double")
    return (
        sizes.join(uses.drop("source", "n_tokens"), "doc", "left")
        .join(F.broadcast(by_source), "source", "left")  # a row for each source with a target
        .join(F.broadcast(wanted), "source", "left")
        .select(F.col("doc").alias("doc_id"), "source", "n_tokens", F.coalesce("n_uses", F.lit(0)).alias("n_uses"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), "target_share", F.when(F.col("target_share").isNotNull(), F.coalesce("share_reached", F.lit(0.0))).alias("share_reached"))
    )


@REG.query("p8_shares")
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source with a target: its tokens, the tokens used, and the share reached beside the target."""
    _, mix = _mix(spark, sf_dir)
    used = mix.uses().groupBy("source").agg(F.sum("tokens_used").alias("tokens_used"), F.max("n_uses").alias("most_uses"))
    wanted = spark.createDataFrame([(s.source, s.target, s.max_repeats, s.tokens) for s in mix.shares], "source string, target_share double, max_repeats int, n_tokens bigint")
    reached = wanted.join(used, "source", "left").withColumns({"tokens_used": F.coalesce("tokens_used", F.lit(0)), "most_uses": F.coalesce("most_uses", F.lit(0))})
    total = reached.agg(F.sum("tokens_used").alias("total"))
    return reached.crossJoin(F.broadcast(total)).select(*reached.columns, F.coalesce(F.col("tokens_used") / F.nullif("total", F.lit(0)), F.lit(0.0)).alias("share_reached"))


@REG.query("p8_shards")
def p8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source counts drawn for every shard of the output."""
    return _mix(spark, sf_dir)[1].shards()


@REG.query("p8_blocks")
def p8_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix itself: the token block of every slot."""
    return _mix(spark, sf_dir)[1].blocks(stored(_ids(table(spark, sf_dir, "documents"))))
