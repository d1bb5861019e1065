"""A corpus pipeline from the operators in bandloom.llm.

Each stage takes (spark, docs, sf_dir), reads what the stage before it kept, and its decisions take
effect; all but the last return the columns of documents, the last the places of packed pieces.
``run`` writes every stage's result as Parquet in the shared folder and rereads it as the next
one's docs, so a lost executor costs one stage at most. Statistics and models are made from the
documents that reach a stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.llm import contamination, neardup, packing, runtime, suffixdedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5 stay."""
    return toxicity.reject(docs, toxicity.fit(docs, runtime.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8), and one of repeated rows."""
    return neardup.dedupe(docs)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 51 words, and bytes under a 400-byte string, that stand elsewhere too are cut out of the texts."""
    return suffixdedup.strip(docs, length=400, words=51).withColumn("n_chars", F.length("text").cast("long"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return contamination.clean(docs, runtime.table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("suffixes", strip_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what every stage kept of the documents. A stage's table goes when the next one is written."""
    docs = runtime.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = runtime.stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            runtime.drop_stored(before)
        before = docs
    return docs
