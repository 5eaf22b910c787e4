"""The corpus pipeline over ``documents``: quality, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet into
the shared folder and reads it back as the next stage's documents. All but the last return the
columns of ``documents``. Part of the operators' subpackage: it is removed together with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blotter.llm import line_dedup, minmax_dedup, mixing, nbsvm, packing
from blotter.llm.queries import tokenizer_file
from blotter.llm.store import stage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels outside the held-out part, scores 0.3 or more."""
    labels = table(spark, sf_dir, "labels").where(~nbsvm.held_out(F.col("doc_id")))
    model = nbsvm.fit(docs, labels)
    return nbsvm.scores(docs, model, out="__score").where(F.col("__score") >= 0.3).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines kept elsewhere; those that lose every word of theirs go."""
    left = line_dedup.dedup_lines(docs.select(*COLUMNS))
    cut = F.col("removed_lines") > 0
    chars = F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.where(~cut | F.regexp_like("text", F.lit(mixing.WORD))).withColumn("n_chars", chars).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each near-duplicate component, and of equal rows one."""
    docs = docs.select(*COLUMNS)
    gone = minmax_dedup.near_duplicates(docs, percent=80).where("NOT kept").select("doc_id", "text_hash").distinct()
    rest = docs.withColumn("text_hash", F.xxhash64("text")).join(gone, ["doc_id", "text_hash"], "left_anti")
    again = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("doc_id", "text_hash"))
    return rest.withColumn("again", again).where((F.col("again") == 1) | F.col("doc_id").isNull()).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a document as often as it is taken, shuffled."""
    docs = docs.select(*COLUMNS)
    chosen = mixing.mix(docs, mixing.repeating_weights(docs, "source"), mixing.word_count(F.col("text")))
    return mixing.mixture(chosen).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of at most 4096 ids."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixed", mixed),
    ("packed", packed),
]

#: The classifier, the hashes and the tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
