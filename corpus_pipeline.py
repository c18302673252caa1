"""Training corpus from documents: reject toxic texts, one text of each near-duplicate group, no benchmark leaks, mix, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.llm.decontam import find_leaks
from tidelog.llm.mixing import mix_sources
from tidelog.llm.ngram_join import ngram_join
from tidelog.llm.packing import packed_digest
from tidelog.llm.queries import MIX, MIX_LEVELS, VOCABULARY, with_domain
from tidelog.llm.toxicity import fit_toxicity, labelled_sample, score_toxicity
from tidelog.session import materialize, new_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; empty and null texts stay."""
    model = fit_toxicity(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_toxicity(docs, model).where("toxic_predicted = 0").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group.

    Texts without words and rows without id are in no group and stay; of rows with one id and text one
    stays. Different texts are grouped by their links alone, also when they share an id: every row
    gets a number of its own, written beside it, and the join runs over these numbers.
    """
    named = docs.where("doc_id is not null").withColumn("row__", F.monotonically_increasing_id())
    rows = materialize(named, "pipeline-rows")
    found = ngram_join(rows, id_col="row__").select("row__", F.when(F.col("n_shingles") > 0, F.col("component")).alias("group__"))
    empty = F.col("group__").isNull()
    facts = rows.select("row__", "doc_id", F.md5("text").alias("name"), F.xxhash64(*docs.columns).alias("tie"))  # ties: rows of one id, the same at every run
    first = found.join(facts, "row__").groupBy(
        "group__", F.when(empty, F.col("doc_id")).alias("empty_id"), F.when(empty, F.col("name")).alias("empty_name")).agg(
        F.min(F.struct("doc_id", "tie", "row__")).alias("f")).select(F.col("f.row__").alias("row__"))
    kept = rows.join(materialize(first, "pipeline-groups").hint("shuffle_hash"), "row__", "left_semi")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("leaked_items") == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by source weights; one that is taken in several epochs comes as often."""
    return mix_sources(with_domain(docs), MIX_LEVELS, MIX).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Segments of the packed id matrices, which are written beside them."""
    return packed_digest(docs, VOCABULARY, new_path(spark, "packed"))


STAGES = [("toxicity", clean), ("ngram_join", distinct), ("decontamination", decontaminate), ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None  # the learnt lexicon, latent retrieval and packing have no SQL form; tests/llm compares with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
