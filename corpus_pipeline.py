"""A corpus pipeline: language ID, near-duplicates, repeated passages, source mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of ``documents``. Nulls, empty texts and other odd rows have the results that the operators' modules state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfield.llm import langid, minhash, mixing, packing, substring
from grainfield.llm.common import scratch_folder, scratch_path, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter."""
    model = langid.train(langid.train_split(docs))
    told = langid.identify(docs, model, ("_lang_pred", "_lang_score"))
    return told.where(F.col("_lang_pred") != langid.UNKNOWN).drop("_lang_pred", "_lang_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group linked by 80 % of common five-word shingles."""
    return minhash.dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts runs of 50 words or more that begin in a document with a smaller id too; the documents stay."""
    return substring.remove_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes sources to weights 3, 1, 2 in turn, 150 % of all words, no document more than twice."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all into sequences of 1024 tokens; a document that the mix holds twice is packed twice."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packed", packed),
]

#: SQL has no MinHash, tokenizer or best-fit plan: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch_folder(spark, f"{name}-scratch"):  # what a stage writes on its way goes when its result is written
            docs = stored(stage(spark, docs, sf_dir), path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
