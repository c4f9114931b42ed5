"""The operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, media, merkle, nearest, neardup, neardupvec, oracles, packing, pii, quality, secretscan, sharding, substrings, turns
from .common import stored, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode_documents(table(spark, sf_dir, "documents"), path)
    ids = ids.withColumn("ids_sha256", F.sha2("ids", 256))
    back = bpe.decode_documents(ids, path, keep=("n_tokens", "ids_sha256"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = media.store_text(table(spark, sf_dir, "documents"))
    return media.audio_features(media.correct_types(held, keep=("doc_id", "n_bytes")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    crc = F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")))
    rows = table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), crc.cast("long").alias("text_crc32"))
    dealt = sharding.shard(stored(rows, "sizes"), 40)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.neighbours(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(table(spark, sf_dir, "documents")).drop("span_list")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.find_secrets(table(spark, sf_dir, "documents")).drop("span_list")


def op11_dijkstra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damaged(table(spark, sf_dir, "conversations")))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.document_manifest(table(spark, sf_dir, "documents"))
    proof = F.sha2("siblings", 256).alias("proof_sha256")
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof, "folded_root", "verified")


def op13_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardupvec.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_media": op2_media,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_substrings": op6_substrings,
    "op7_minhash": op7_minhash,
    "op8_crf": op8_crf,
    "op9_secrets": op9_secrets,
    "op10_multi_index": op10_multi_index,
    "op11_dijkstra": op11_dijkstra,
    "op12_merkle": op12_merkle,
    "op13_quantised": op13_quantised,
}

ORACLE_SQL: dict[str, str] = {
    "op11_dijkstra": oracles.REPAIR,
    "op12_merkle": oracles.MERKLE,
    "op13_quantised": oracles.NEAR_VECTORS,
}
