"""The cleaning and mixing pipeline over documents: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import decontaminate, mixing, pii, simhash, toxicity
from panelforge.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain tagger scores below one half; it learns from the labelled documents among them."""
    tagger = toxicity.train_tagger(*toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, tagger)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a telling share of benchmark passages."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what gives it away replaced in their texts."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: shard, slot, source, pass_no, block, doc_ids, n_words, text, one row per slot."""
    return mixing.mix(docs, with_text=True).texts()


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", sanitise),
    ("mixing", mix_sources),
]

#: The fitted tagger and the hashed draws have no SQL twin; tests/llm compares the stages with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each one keeps is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
