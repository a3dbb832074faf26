"""A training corpus from the documents table, in five stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paylint.llm import decontamination, jaccard, mixing, quality, tokens
from paylint.llm.queries import tokenizer_path
from paylint.llm.storage import saved


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, all columns as they are.

    Null and empty texts are judged as texts without words, null sources and
    languages as sites of their own; repeated rows are judged alike and all stay or
    all go.  Without labels of both kinds all stay.  An empty table gives none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judged(docs, labels).where("keep").select(*(f"`{c}`" for c in docs.columns))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group that n-gram Jaccard links connect.

    Rows are told apart by doc_id and text: of repeated rows one stays, of rows with
    one doc_id and different texts only copies of others go, a null doc_id comes
    last.  Texts without words are no copies; all of them stay.
    """
    return jaccard.distinct(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none, repeated rows stay or go together."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their target weights, shuffled.

    A null source is a source of its own; equal doc_ids are drawn alike, a null one
    by its text.  A source without text is left out.
    """
    return mixing.mix(docs).select(*(f"`{c}`" for c in docs.columns))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files, and the digest of each document read back from them, a row for each row; null texts have the end id alone."""
    return tokens.encoded(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", uncontaminated), ("mixing", mixed), ("token_ids", tokenized)]

#: Three of the stages (a trained classifier, spaced seeds, a tokenizer) have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs
