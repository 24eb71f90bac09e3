"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes what its predecessor kept; its result is written as Parquet in the shared folder and read again. All but the last
return the columns of documents. Where a text changes, n_chars follows.

Every stage keeps the columns that it is given, whatever their names. Null and empty texts are not toxic, have no copies, nothing to cut and no words to mix:
they stay, once. Documents with a null id stay in the n-gram stage; rows that repeat an id and a text are one document there, which stays or goes as one.
An empty table gives an empty table.

Mixing takes whole documents here: a document is in the mix as often as its share of taken words says, rounded by a seeded draw, 0 to 3
times; a document that comes more than once keeps its doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import decontamination, mixing, ngram_join, sharding, toxicity
from provena.llm.common import read, written

SHARDS = 8


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    return toxicity.reject_toxic(docs, toxicity.learned(spark, sf_dir))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word grams, similarity 0.8) stays: the one with the smallest doc_id."""
    return ngram_join.keep_one(docs, 5, 80, 100)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside occurrences of benchmark windows are cut; a document of which nothing is left goes."""
    out = decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words."""
    return mixing.mix_whole(docs)


def _sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot in the shard."""
    return sharding.shard_records(docs, [1.0] * SHARDS)


STAGES = [
    ("toxicity", _toxicity),
    ("ngram_jaccard_join", _near_duplicates),
    ("benchmark_decontamination", _decontamination),
    ("mixing", _mixing),
    ("sharding", _sharding),
]

#: The trained scores, hashes and groups of the stages are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}-{name}")
    return docs
