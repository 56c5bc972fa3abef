"""A training corpus from the documents table: toxic texts and near copies go, so do texts that hold benchmark items;
personal data is masked; what is left is packed into batches of tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns
of documents, whatever these are; the last returns a row for each sequence of tokens.

Defined results, whatever is null, empty, very long, tied or repeated: a null or empty text is not toxic by itself (it
gets the score of a text without features), holds no benchmark item and no personal data, and has no sequences. Texts
without words are copies of each other, so one row of them stays. Of near copies the row with the smallest id stays;
rows with null id take part and come last, rows that share an id are told apart by their texts, and rows that repeat
both are one. Texts of any length are read whole. Columns that documents do not have in the given tables are carried along. Empty documents give
empty results at every stage; without labels of both classes the toxicity stage keeps what scores under 0.5, without
benchmark items nothing is dropped for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm import decontaminate, packing, pii, simhash, toxicity
from matchspark.llm.common import cut, on_workers, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier fitted to labels finds toxic go."""
    on_workers(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays."""
    on_workers(spark)
    return simhash.keep_one(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a benchmark item go."""
    on_workers(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes <KIND>; n_chars follows the text."""
    on_workers(spark)
    masked = pii.find(docs, pii.learn_field(docs), mask=True)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens in batches of their length's bucket."""
    on_workers(spark)
    return packing.pack(cut(packing.sequences(docs, tokens=True)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("simhash_near_dedup", near_copies_out),
    ("decontamination", benchmark_out),
    ("pii", personal_data_masked),
    ("packing", packed),
]

#: The stages' models have no SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
