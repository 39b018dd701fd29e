"""From raw documents to sharded training text, in five stages.

Each stage is written as Parquet to the shared folder and read again, so that a lost executor costs no more than
the stage it ran. All stages but the last return the columns of documents; the last returns them, texts included, with
each row's size, shard and slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallywright.llm import decontam, toxicity as toxic
from tallywright.llm.mixing import mixed_rows
from tallywright.llm.sharding import shard_by_bytes
from tallywright.llm.shingle_join import distinct_rows
from tallywright.operators.scratch import Scratch

SHARDS = 24


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labels that aren't held out, scores below 0.5.

    A null or empty text scores 0 and stays; a very long one is scored whole, by its worst window; a score of exactly
    0.5 goes. Rows that repeat a text go or stay alike. An empty table, or labels of one kind only, keep all there is.
    Other columns, whatever their names, are kept and never read.
    """
    return toxic.clean_rows(docs, toxic.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 0.8 of the five-word shingles, links taken together.

    The smallest id stays, so there are no ties; of rows that repeat an id one stays. Null and empty texts, those
    without words, and rows with a null id link with nothing and all stay; a very long text is compared whole. An empty
    table stays empty. Other columns, whatever their names, are kept.
    """
    return distinct_rows(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts and items match nothing, so such rows stay; a very long text is searched whole, and one
    match is enough, so ties don't matter. Repeated rows go or stay alike. An empty table of either kind keeps all
    there is. Other columns, whatever their names, are kept.
    """
    return decontam.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to source weights takes them: 3, 1, 2 repeating, 150% of all words, at most twice.

    A null or empty text has no words: it comes along where the mix passes it and adds nothing. A very long one is
    taken whole or not. A null source is a source of its own. Equal finish times go by source, shuffled key, id and
    copy; repeated rows are rows of their own. An empty table stays empty. Other columns, whatever their names, are
    kept.
    """
    return mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix with its size, shard and slot; sizes of shards near equal, equal texts together.

    A null text has no bytes; null texts are one group, apart from the empty text; a very long text has its place
    whole and may be larger than the mean shard. Rows of equal id and text have slots in any order. An empty table
    stays empty. All columns are kept; where one of them is called size, shard or slot, the added one gets an
    underscore.
    """
    return shard_by_bytes(docs, SHARDS, keep_columns=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL expresses neither the network nor the seeds; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        kept = scratch.write(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
