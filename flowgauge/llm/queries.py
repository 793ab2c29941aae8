"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    common,
    filter_audit,
    fingerprint,
    license,
    linededup,
    merkle,
    minhash,
    ngram_join,
    oracles,
    packing,
    pieces,
    quality,
    sharding,
    token_orc,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SEQUENCE_TOKENS = 4096
SHARD_BYTES = 64 << 20


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(common.documents(spark, sf_dir), path, end_id=1, capacity=SEQUENCE_TOKENS)


@query("op9_token_orc")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = common.work_dir(spark, "token-orc")
    token_orc.write_tokens(common.documents(spark, sf_dir), files, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_orc.token_index(token_orc.read_tokens(spark, files))


@query("op10_extendible_shards")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(common.documents(spark, sf_dir), SHARD_BYTES)


@query("op2_minhash_groups", oracles.NEAR_DUPLICATES)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_groups(common.documents(spark, sf_dir))


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(common.documents(spark, sf_dir), common.labels(spark, sf_dir))
    return out.withColumn("rejected_by", F.concat_ws(",", "rejected_by"))


@query("op4_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.repeats(common.documents(spark, sf_dir))
    spans = F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return out.withColumn("spans", F.concat_ws(",", spans))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(common.documents(spark, sf_dir), common.labels(spark, sf_dir))


@query("op1_weighted_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(common.documents(spark, sf_dir))


@query("op5_license_scan", oracles.LICENSES)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(common.documents(spark, sf_dir))


@query("op8_pieces_round_trip")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = pieces.encode(common.documents(spark, sf_dir), model)
    found = ids.select("doc_id", pieces.read_back(F.col("ids"), model).alias("back")).select("doc_id", "back.*")
    return found.select("doc_id", "n_ids", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


@query("op11_ngram_join", oracles.NGRAM_JOIN)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_similar(common.documents(spark, sf_dir))


@query("op12_merkle_manifest", oracles.MERKLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(*merkle.manifest(common.documents(spark, sf_dir)))


@query("op13_filter_audit", oracles.FILTER_AUDIT)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(common.documents(spark, sf_dir), common.labels(spark, sf_dir))
