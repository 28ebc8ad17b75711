"""A corpus pipeline: each stage applies one of the corpus operators to what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from exposura.llm.bpe import bpe_encode, ids_digest
from exposura.llm.decontaminate import decontaminate
from exposura.llm.ngram_join import ngram_join
from exposura.llm.ordering import drop_few
from exposura.llm.queries import vocabulary_path
from exposura.llm.secrets import mask_secrets
from exposura.llm.toxicity import fit_toxicity, score_toxicity
from exposura.session import discard, materialize

# Near copies: five words and a similarity of 0.8.
WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labels of this stage's documents."""
    machine = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, machine, score="_toxic_score", predicted="_toxic")
    return scored.where("_toxic = 0").select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies; rows without a doc_id stay.

    Of repeated rows with one doc_id one stays.
    """
    links = ngram_join(docs.select("doc_id", "text"), WORDS, PERCENT)
    dropped = links.where("doc_id != component_id").select("doc_id").distinct()
    kept = drop_few(docs, materialize(dropped), "doc_id")
    repeated = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_found_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and ``n_chars`` brought up to date."""
    return mask_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their number and digest, and whether they decode to its text again."""
    path = vocabulary_path()
    return bpe_encode(docs, path, decoded="decoded").select(
        "doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids",
        ids_digest(F.col("ids")).alias("ids_sha256"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_found_secrets),
    ("bpe", encode),
]
# The classifier, the masking and the encoding cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        discard(*stored)  # what the stage before kept
        stored = [docs]
    return docs
