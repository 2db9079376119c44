"""Corpus pipeline: each stage takes the documents its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuegrid.llm import language, line_dedup, near_dedup, packing, toxicity
from tissuegrid.llm.common import limit_batches, materialize, prepare, table
from tissuegrid.llm.queries import WORD_BPE


def _ready(docs: DataFrame) -> DataFrame:
    """The same documents, their session set up for the operators."""
    limit_batches(prepare(docs.sparkSession))
    return docs


def _chosen(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id stands in ``decisions``; rows without an id stay."""
    named = docs.where(F.col("doc_id").isNotNull()).join(decisions.select("doc_id").distinct(), "doc_id", "left_semi")
    return named.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def _nameless(docs: DataFrame) -> DataFrame:
    """The rows without an id, stored with a number each (``_row``), by which they can be judged."""
    rows = docs.where(F.col("doc_id").isNull()).withColumn("_row", F.monotonically_increasing_id())
    return materialize(rows, "rows-without-id")


def _by_number(nameless: DataFrame) -> DataFrame:
    """Those rows with their number as id."""
    return nameless.withColumn("doc_id", F.col("_row"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is established; those without a letter or a likely language go."""
    nameless = _nameless(_ready(docs))
    named = docs.where(F.col("doc_id").isNotNull())
    evidence = [language.document_evidence(d).withColumn("numbered", F.lit(n).cast("long"))
                for n, d in enumerate((named, _by_number(nameless)))]
    found = language.identify(evidence[0].unionByName(evidence[1]), ["doc_id", "numbered"]).where("accepted")
    kept = _chosen(named, found.where("numbered = 0"))
    rest = nameless.join(found.where("numbered = 1").select(F.col("doc_id").alias("_row")), "_row", "left_semi")
    return kept.unionByName(rest.select(*docs.columns))


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    nameless = _nameless(_ready(docs))
    named = docs.where(F.col("doc_id").isNotNull())
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"))
    bad = lambda d: toxicity.score(d, weights).where("predicted = 1").select("doc_id").distinct()
    # An id of which any text is toxic goes.
    kept = named.join(bad(named), "doc_id", "left_anti")
    rest = nameless.join(bad(_by_number(nameless)).withColumnRenamed("doc_id", "_row"), "_row", "left_anti")
    return kept.select(*docs.columns).unionByName(rest.select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least id, once."""
    groups = near_dedup.near_duplicates(_ready(docs))
    kept = materialize(groups.where("kept and doc_id is not null").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n")), "kept-documents")
    once = _chosen(docs, kept.where("n = 1"))
    several = docs.join(kept.where("n > 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    return once.unionByName(several.dropDuplicates(["doc_id"]))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines and sentences that an earlier document holds."""
    return line_dedup.remove_repeats(_ready(docs)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    return packing.pack(_ready(docs), WORD_BPE)


STAGES = [
    ("language ID", language_id),
    ("toxicity", toxic_texts),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_lines),
    ("best-fit packing", best_fit_packing),
]

# Trained models, trigram tables and best-fit packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
