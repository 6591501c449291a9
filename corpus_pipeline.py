"""Corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's rows to the shared folder and
gives them to the next as its docs. All but the last return the columns of documents.

Defined cases, in every stage: an empty table gives an empty result; repeated rows are rows of their own, judged alike;
very long texts are read whole; further columns are passed on, but names that a stage adds (``slot``, ``__hit`` and the
like, listed in its operator) raise an error.

* toxicity: null and empty texts score the bias alone, and a score equal to the threshold is toxic.
* line dedup: a null source is no site; a null text stays null with its n_chars, and other texts get theirs counted again.
* near-duplicates: null and empty texts, and null ids, are linked with nothing and stay; of a group the smallest id stays,
  on all its rows.
* decontamination: null and empty texts hold no window and stay.
* mixing: null sources, and sources without a weight, form one pool; equal deadlines go to the heavier source, then by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from algoscape.llm import decontaminate, line_dedup, mixing, near_duplicates, toxicity
from algoscape.llm.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; labels come from the labels table."""
    model = toxicity.fit_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.remove_toxic(docs, model)


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that spread over many sources; n_chars follows the text."""
    d = line_dedup.remove_boilerplate(docs)
    return d.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_duplicates.remove_near_duplicates(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_boilerplate),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Trained and hashed stages have no SQL; tests/llm compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = scratch.save(out, name) if i < len(STAGES) - 1 else out
    return docs
