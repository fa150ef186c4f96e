"""The corpus pipeline: toxic and poor documents go, one of each group of near copies stays, secrets
are masked, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``.  Nulls, repeated rows, empty tables and further columns are allowed everywhere: a null
text is an empty one, further columns pass through, and no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsynth.llm import quality, toxicity
from obsynth.llm.common import table
from obsynth.llm.ngram_join import Similarity, near_duplicates
from obsynth.llm.packing import pack_documents
from obsynth.llm.secret_scan import mask_secrets
from obsynth.session import cut_lineage


def _free(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go."""
    score = _free(docs, "toxicity")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(False))
    return toxicity.score_toxicity(docs, model, score_col=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality below 0.5 go."""
    score = _free(docs, "quality")
    model = quality.train(docs, table(spark, sf_dir, "labels"), F.lit(False))
    return quality.score_quality(docs, model, score_col=score).where(F.col(score) >= 0.5).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of near copies (five words, 0.8) connect, the smallest id stays.

    An id is one document: rows that share it stay or go together, exact repeats of a row's text
    under one id stay once, and rows without an id stay."""
    found = near_duplicates(docs, Similarity(words=5, percent=80))
    leave = found.groupBy("doc_id").agg(F.bool_and(F.col("component_id") != F.col("doc_id")).alias("go")).where("go and doc_id is not null").select("doc_id")
    mark = _free(docs, "text_hash")
    kept = docs.join(leave, "doc_id", "left_anti").withColumn(mark, F.xxhash64("text"))
    named = kept.where("doc_id is not null").dropDuplicates(["doc_id", mark])
    return named.union(kept.where("doc_id is null")).select(*docs.columns)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mask; ``n_chars`` follows the text where there is such a column."""
    masked = mask_secrets(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 tokens."""
    return pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", keep_one_of_each), ("secrets", mask), ("packing", pack)]

ORACLE_SQL = None  # SQL can express neither the classifiers nor the tokens


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
