"""The training-data pipeline: toxicity, near-duplicates, secrets, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and reread as the next one's docs. All but the last return the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import mixture_pack, secret_index, simhash_blocks, toxicity_chain
from corpusloom.storage import scratch, tables_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones, calls toxic go.

    A null or empty text has no words and stays, unless an empty text counts as toxic itself; repeated
    rows are judged alike; columns of any name are carried; an empty table gives an empty one.
    """
    chain = toxicity_chain.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_chain.keep_clean(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with a five-word-shingle set similarity of 0.8 or more, the one with the smallest id stays."""
    return simhash_blocks.keep_one(docs, words=5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; all documents stay and ``n_chars`` follows the text."""
    return secret_index.redact_secrets(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows that hold each source by its share.

    A null or empty text is its end id alone; repeated rows and null ids are packed like any other; other
    columns, whatever their names, are not read; an empty table gives no piece.
    """
    import public_tokenizers

    return mixture_pack.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack_windows),
]

#: No SQL expresses the classifier, the fingerprints or the tokenizer; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is stored in the shared folder and reread.

    What a stage stores besides goes when its result is written. ``storage.clear_stored`` deletes the
    results when the last one is not needed any more.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{tables_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
