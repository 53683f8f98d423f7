"""Clean a corpus and mix its sources: stages over documents, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of docs. Texts stay
byte for byte but where a stage says otherwise; null and repeated rows are treated as the stage's operator says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precepta.llm.common import SPACED, cut, delete, shared_folder, table
from precepta.llm.decontaminate import contamination
from precepta.llm.mixing import mixed
from precepta.llm.near_dedup import near_duplicates
from precepta.llm.quality_classifier import classify_quality
from precepta.llm.substring_dedup import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the co-trained classifier takes for bad."""
    return classify_quality(docs, table(spark, sf_dir, "labels")).where("kept").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id, null last.

    Each row is judged by its own text, whatever its doc_id. Rows without words are in no group and stay; of rows that
    agree in doc_id and text one stays.
    """
    whole = docs.select(F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("doc_id").alias("id"), F.struct("*").alias("doc"))
    judged = near_duplicates(docs.select(F.xxhash64(F.col("text").cast("string")).alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("key"))
    judged = cut(judged.agg(F.max("n_shingles").alias("n"), F.max("component_id").alias("group")))
    rows = whole.groupBy("key", "id").agg(F.count("*").alias("rows")).join(judged.where("n > 0"), "key")
    kept = rows.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), F.col("id").alias("kept_id"), "key", "rows")).alias("best"))
    kept = cut(kept.select("best.key", "best.kept_id", "best.rows").union(judged.where("n = 0").select("key", F.lit(None), F.lit(0))))
    out = whole.join(kept, "key").where((F.col("rows") == 0) | F.col("id").eqNullSafe(F.col("kept_id")))
    once = out.where("rows <= 1").select("doc.*")
    if not kept.where("rows > 1").isEmpty():
        once = once.union(out.where("rows > 1").dropDuplicates(["key"]).select("doc.*"))
    return once


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated passages; documents of which nothing is left go. Rows of a null doc_id come after all others."""
    text = F.col("text").cast("string")
    given = docs.select(*[F.col(c).alias(f"_{c}") for c in docs.columns], F.coalesce("doc_id", F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(1 << 62)).alias("doc_id"), text.alias("text"))
    out = substring_dedup(given, carry=[f"_{c}" for c in docs.columns]).where("text IS NULL OR text != '' OR n_removed = 0")
    return out.select([F.col("text") if c == "text" else F.col(f"others._{c}").alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that have any passage of the benchmark, each judged by its own text, whatever its doc_id."""
    key = F.xxhash64(F.col("text").cast("string"))
    found = contamination(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("_key")).distinct()
    return docs.join(found, key == F.col("_key"), "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight: the columns of docs, copy (from 1 on) and n_words of each emitted document."""
    return mixed(docs).withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(SPACED)), F.lit(0)).cast("long"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substrings", substrings), ("decontaminate", decontaminate), ("mix", mix)]
#: Signatures and fitted models can't be expressed in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; the one before is then deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            delete(spark, before)
        before = path
    return docs
