"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm import (chunk_dedup, compression_rules, decontaminate, language_id, licenses, merkle, near_dups, pareto_mix, prefix_trie, resharding, suffix_dedup,
                       token_counts, weak_labels)
from dwell.llm.oracles import MERKLE_SQL, MIX_SQL, NEAR_SQL, TRIE_SQL

SHINGLE_WORDS = 4     # of op2's contract
SIMILARITY = 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def laid_out_by_source() -> Column:
    """The old shard of a document: the shards were once filled by source."""
    return F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(resharding.SHARDS))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.near_duplicates(_table(spark, sf_dir, "documents"), SHINGLE_WORDS, SIMILARITY)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents")).drop("spans")


def op5_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.reshard(_table(spark, sf_dir, "documents"), laid_out_by_source())


def op6_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.quality_scores(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents")).drop("spans", "kept_text")


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.chunk_dedup(_table(spark, sf_dir, "documents")).drop("spans", "kept_text")


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pareto_mix.pareto_mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def _id_crc(column: str) -> Column:
    """Unsigned CRC-32 of the id's decimal digits (null: of nothing)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = prefix_trie.conversations(_table(spark, sf_dir, "conversations"))
    mixed = prefix_trie.rebuilt(convs, F.col("conv_id") - F.col("conv_id") % 5, _id_crc("conv_id") % 9, 8)
    return prefix_trie.prefix_trie(mixed)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has the CRC of nothing, 0, so its row is not held out."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", _id_crc("doc_id") % 3 == 1)
    model = language_id.fit(docs.filter(~F.col("held_out")).select("lang", "text"))
    return language_id.predict(docs, model, keep=("doc_id", "held_out"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has the CRC of nothing, 0, so its row is tampered with."""
    tampered = F.when(_id_crc("doc_id") % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = merkle.manifest(_table(spark, sf_dir, "documents"), tampered)
    proved = found.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("path"))).alias("proof_sha256"),
                          merkle.folded(F.coalesce("altered_leaf", "leaf"), F.col("path")).alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_near_duplicates, op3_contaminated, op4_license_scan, op5_reshard, op6_quality_scores, op7_quality_rules,
    op8_suffix_dedup, op9_chunk_dedup, op10_pareto_mix, op11_prefix_trie, op12_language_id,
    op13_merkle_manifest)}
ORACLES = {"op2_near_duplicates": NEAR_SQL, "op10_pareto_mix": MIX_SQL,
           "op11_prefix_trie": TRIE_SQL, "op13_merkle_manifest": MERKLE_SQL}
