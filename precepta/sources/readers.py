"""Readers of landed files and of line formats, and the cutting of lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that spark.checkpoint.dir names. Where it is unset, in a temporary one, but only if all tasks run in this process."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="precepta-"))
    return df.checkpoint(eager=True)


def read_records(spark: SparkSession, path: str, schema: StructType | str, key: str | None = None, skip: str = "descartados") -> DataFrame:
    """JSON lines of a file or folder with a fixed schema; broken lines fail the read, as do repeated or missing keys if key is given."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").json(path)
    df = df.where(~F.col("_metadata.file_name").contains(f".{skip}.")) if skip else df
    if key:
        bad = duplicate_keys(df, key).limit(5).collect()
        if bad:
            raise ValueError(f"repeated keys: {[r[0] for r in bad]}")
        if df.isEmpty():
            raise ValueError(f"no records in {path}")
    return df


def read_documents(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """One JSON document for each file of several folders; of files of one name the first folder's counts, unreadable ones are left out."""
    parts = [spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(p).withColumn("_file", F.lower(F.col("_metadata.file_name"))).withColumn("_from", F.lit(i)) for i, p in enumerate(paths)]
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("_file").orderBy("_from"))).where("_n = 1").drop("_n", "_from", "_file")


def read_cases(spark: SparkSession, path: str, columns: list[str], required: int) -> DataFrame:
    """Lines of fields between bars, # comments and blank lines left out; missing optional fields are empty. Too few fields fail."""
    lines = spark.read.text(path).where(~F.trim("value").rlike("^(#.*)?$"))
    parts = lines.select(F.transform(F.split("value", r"\|"), lambda x: F.trim(x)).alias("p"))
    checked = F.when((F.size("p") < required) | (F.size("p") > len(columns)), F.raise_error(F.concat(F.lit("bad case: "), F.array_join("p", "|")))).otherwise(F.col("p"))
    return parts.select(checked.alias("p")).select(*[F.coalesce(F.get("p", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)])


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, expected, year, reason, text) of a file of blocks from '--- CASO:' to '--- FIN'."""
    blocks = spark.read.text(path, lineSep="--- FIN").where(F.col("value").contains("--- CASO:"))
    field = lambda name: F.trim(F.regexp_extract("value", rf"(?m)^{name}:[ \t]*(.*)$", 1))
    return blocks.select(F.trim(F.regexp_extract("value", r"--- CASO:\s*(.*)", 1)).alias("case_id"), field("esperado").alias("expected"), field("ejercicio").alias("year"), field("motivo").alias("reason"), F.regexp_extract("value", r"(?s)\ntexto:\s*(.*?)\s*$", 1).alias("text"))


def read_xml_blocks(spark: SparkSession, path: str, schema: StructType | str, row_tag: str = "bloque") -> DataFrame:
    """The elements of official XML, a row each, with the schema given."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def latest_raw(files: DataFrame) -> DataFrame:
    """The newest landed file (norm, resource, stamp, path, failed) of each norm and resource that isn't a failure."""
    return files.where("NOT failed").groupBy("norm", "resource").agg(F.max_by("path", "stamp").alias("path"), F.max("stamp").alias("stamp"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that are repeated or null."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | missing)


def landed_profile(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes, rows) of landed files: checksum, size and lines that aren't blank."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    lines = spark.read.text(path).where("trim(value) != ''").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))
    tail = lambda c: F.regexp_replace(c, "^file:/*", "/")
    return files.withColumn("path", tail("path")).join(lines.withColumn("path", tail("path")), "path", "left").na.fill(0, ["rows"])
