"""The registered queries of the operators: production parameters over the whole tables.

Each query runs its operator and derives the columns of its report from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from . import ann_scan, bpe, conversation_repair, line_dedup, minmax_dedup, mixing, nbsvm, packing, sharding, suffix_tree, token_store, topk_pivot, whitening
from .store import stage, table


def tokenizer_file(name: str) -> str:
    """Path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 8 shards of near equal bytes."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    placed = sharding.shard_rows(docs, ["doc_id", "text_crc32"], "size", shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op2_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found for every 50th vector."""
    rows = table(spark, sf_dir, "embeddings")
    return ann_scan.search(rows, rows.where("vec_id % 50 = 0"), k=5)


def op3_pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer products for every 50th vector."""
    rows = table(spark, sf_dir, "embeddings")
    return topk_pivot.search(rows, rows.where("vec_id % 50 = 0"), k=5)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document's ids lie in the store, read back from its files."""
    path = shared_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"), end_id=0,
                            vocabulary=50_257)
    return token_store.read_store(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", token_store.crc_rows)


def op5_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("text_hash")


def op6_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~nbsvm.held_out(F.col("doc_id")))
    scored = nbsvm.scores(docs, nbsvm.fit(docs, labels))
    return scored.select("doc_id", nbsvm.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's and the base's log10 probability of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = nbsvm.held_out(F.col("doc_id"), rest=1)
    scored = suffix_tree.score(docs, *suffix_tree.fit(docs.where(~out)))
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture's share of every document, and the output shards that the tree gives it to, pass by pass."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    docs = stage(docs, "mix-sizes")
    mixed = mixing.mix(docs, mixing.repeating_weights(docs, "source"), F.col("words"))
    shards = F.array_join(F.transform("places", lambda p: p["shard"].cast("string")), ",")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document's text: lines removed, characters and crc32 of the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = line_dedup.dedup_lines(docs)
    return left.select("doc_id", "removed_lines", F.length("text").cast("long").alias("chars"),
                       F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of 4096 ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_lattice_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation."""
    report = conversation_repair.repair_report(conversation_repair.damage(table(spark, sf_dir, "conversations")))
    return report.withColumnsRenamed({"conv": "conv_id", "sha256": "repaired_sha256"})


def op12_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of every document's ids and of the text that they decode to."""
    path = tokenizer_file("byte_bpe_50k.json")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op13_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first four whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bounded_ring": op1_bounded_ring,
    "op2_dimension_scan": op2_dimension_scan,
    "op3_pivot_table": op3_pivot_table,
    "op4_token_store": op4_token_store,
    "op5_minmax_dedup": op5_minmax_dedup,
    "op6_nbsvm_quality": op6_nbsvm_quality,
    "op7_suffix_tree": op7_suffix_tree,
    "op8_splitting_tree": op8_splitting_tree,
    "op9_fuzzy_lines": op9_fuzzy_lines,
    "op10_harmonic_packing": op10_harmonic_packing,
    "op11_lattice_repair": op11_lattice_repair,
    "op12_speculative_bpe": op12_speculative_bpe,
    "op13_qdwh_whitening": op13_qdwh_whitening,
}
