"""The driver's tables in the roles that the catalogue's operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import part_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by their keys in as many tasks as a shuffle is set to have.

    For rows that become many fragments, specs or pairs: a small file is read by few tasks, and Spark puts small partitions together by
    their bytes before they grow, so what meets in a task would grow with the input.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_id, part_number, part_key, manufacturer, category, description."""
    p = table(spark, sf_dir, "part")
    number = F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string"))
    return p.select(F.col("p_partkey").alias("part_id"), number.alias("part_number"), part_key(number).alias("part_key"), F.col("p_brand").alias("manufacturer"), F.col("p_type").alias("category"), F.col("p_name").alias("description"))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: part_id, family, property, value. Blank and null values have no row."""
    p = table(spark, sf_dir, "part")
    rows = p.select(
        F.col("p_partkey").alias("part_id"),
        F.col("p_type").alias("family"),
        F.explode(
            F.array(
                F.struct(F.lit("brand").alias("property"), F.col("p_brand").alias("value")),
                F.struct(F.lit("name").alias("property"), F.col("p_name").alias("value")),
                F.struct(F.lit("size").alias("property"), F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("string")).alias("value")),
                F.struct(F.lit("range").alias("property"), F.concat_ws("..", F.col("p_size").cast("string"), (F.col("p_size") + 5).cast("string")).alias("value")),
            )
        ).alias("s"),
    )
    return rows.select("part_id", "family", "s.property", "s.value").filter(F.trim("value") != "")


def from_options(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """primary, or where it has no row the fallback; provenance says which."""
    none = primary.limit(1).count() == 0
    return (fallback if none else primary).withColumn("provenance", F.lit("fallback" if none else "primary"))


def document_kind(content: DataFrame) -> DataFrame:
    """binaryFile rows with their kind by magic: pdf, html or other."""
    head = F.decode(F.substring("content", 1, 512), "ISO-8859-1")
    kind = F.when(head.startswith("%PDF-"), "pdf").when(head.rlike(r"(?i)^\s*(<!doctype html|<html)"), "html").otherwise("other")
    return content.withColumn("kind", kind)
