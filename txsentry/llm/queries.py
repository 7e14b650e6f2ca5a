"""Registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from txsentry.llm import fingerprints, host_rules, licenses, line_dedup, mixing, prefix_trie, sharding, simhash, topk, toxicity, wavelet, whitening
from txsentry.llm import sentencepiece_lattice as lattice
from txsentry.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
            .select("doc_id", "text", "n_lines", "n_removed"))


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.NOTICES, related=licenses.RELATED)


def op6_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = lattice.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    return lattice.encode_merges(table(spark, sf_dir, "documents"), pieces)


def op8_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.rate(docs, model).drop("text")


def op9_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_tiled_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_qd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_wavelet_tokens, op3_hash_tree_shards, op4_pivotal_mix, op5_license_scan,
    op6_one_permutation_minhash, op7_sentencepiece_lattice, op8_ordinal_toxicity, op9_simhash_pivots, op10_tiled_top_k,
    op11_qd_whitening, op12_host_rules, op13_prefix_trie)}
ORACLE = {"op1_line_dedup": line_dedup.SQL, "op3_hash_tree_shards": sharding.SQL, "op10_tiled_top_k": topk.SQL, "op12_host_rules": host_rules.SQL,
          "op13_prefix_trie": prefix_trie.SQL}
