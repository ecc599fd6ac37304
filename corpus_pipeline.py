"""A corpus prepared for training, in stages that each read what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partslake.llm.forest import one_of_each
from partslake.llm.mixing import mix
from partslake.llm.packing import cut, pack
from partslake.llm.secrets import redact
from partslake.llm.simhash import MAX_BITS
from partslake.llm.toxicity import THRESHOLD, score, train
from partslake.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Near-duplicates: least similarity of word shingles, as numerator and denominator.
NEAR_WORDS, NEAR_SIMILAR = 5, (4, 5)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    docs = docs.select(*COLUMNS)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, COLUMNS).filter(F.col("score") < THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    SimHash fingerprints are joined over the binary trie, and what it links is confirmed on whole sets of
    shingles; similar texts whose fingerprints lie further apart are then found by the LSH forest.
    """
    return one_of_each(docs.select(*COLUMNS), width=NEAR_WORDS, similar=NEAR_SIMILAR, max_bits=MAX_BITS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets in its text replaced by a mark."""
    return redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; those of small sources up to twice."""
    return mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048."""
    return pack(cut(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"]))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# A trained model and a tokeniser decide the rows, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
