"""The thin queries over the driver's tables, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bpe, collocations, cross_polytope, dac, fertility, licences, merkle, mixing, norm_buckets, rlz, suffix_array, transcripts
from .common import documents


def op1_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judged(documents(spark, sf_dir))


def op2_transcript_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.parse_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.repeated_spans(documents(spark, sf_dir))


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_directly_addressable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.digests(documents(spark, sf_dir))


def op7_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op8_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.parse(documents(spark, sf_dir))


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(documents(spark, sf_dir))


def op12_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_buckets.top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_tokeniser_fertility, op2_transcript_hmm, op3_suffix_array, op4_temperature_mixing, op5_cross_polytope, op6_directly_addressable, op7_licence_digests, op8_relative_lz, op9_prefix_bpe, op10_bagminhash, op11_collocations, op12_norm_buckets, op13_merkle_manifest)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op7_licence_digests": licences.scan_sql(), "op11_collocations": collocations.phrases_sql(), "op12_norm_buckets": norm_buckets.top_products_sql(), "op13_merkle_manifest": merkle.audited_sql()}
