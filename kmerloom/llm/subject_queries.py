"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.subjects import MOST_SUBJECTS, SubjectGraph, seed_labels
from kmerloom.plans.registry import Registry
from kmerloom.session import table

REG = Registry()


def subjects_of_documents(spark: SparkSession, docs: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, subject, n_sentences) for the documents.

    Null and blank texts have no subject. Without documents, labels of known subjects,
    or with fewer than two subjects there is no row.
    """
    names = [r[0] for r in subjects.select("subject").filter("subject is not null").distinct().orderBy("subject").limit(MOST_SUBJECTS + 1).collect()]
    if len(names) < 2:
        return spark.createDataFrame([], "doc bigint, subject string, n_sentences bigint")
    graph = SubjectGraph(names)
    labelled, full = graph.spread(docs, "doc_id", "text", "lang", "agenda_item", seed_labels(labels, "doc_id", "subject", "annotator", names))
    return graph.subjects_of(labelled, full)


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects_of_documents(spark, *(table(spark, sf_dir, t) for t in ("documents", "subjects", "subject_labels")))


@REG.query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select(F.col("doc").alias("doc_id"), "subject")


@REG.query("p9_composition")
def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and sentences of each subject over the whole corpus."""
    return _found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))
