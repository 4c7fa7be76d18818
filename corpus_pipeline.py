"""A training-data pipeline over ``documents``: filter, deduplicate, redact, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. A stage works on whole rows of what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm import exact_dedup, ngram_join, packing, pii, quality
from lumenspark.llm.common import cut, read


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the model learns from the labelled ones."""
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(docs.select(F.struct(*docs.columns).alias("row"), F.col("text")), model)
    return scored.where("predicted = 1").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the document with the largest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (word 5-grams, Jaccard 0.8 or more) stays."""
    return ngram_join.drop_near_copies(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind in brackets; n_chars follows the text."""
    # The text stands beside the row, not in it: find_spans writes what it is given.
    rest = F.struct(*(c for c in docs.columns if c != "text"))
    found = pii.find_spans(docs.select(rest.alias("row"), F.col("text")), "text")
    clean = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        clean["n_chars"] = F.when(F.size("spans") > 0, F.length("text")).otherwise(clean["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return pii.redact(found).select(*(v.alias(c) for c, v in clean.items()))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, placed into sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: The first stage holds a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
