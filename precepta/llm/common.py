"""What the operators of this subpackage share: cutting lineage, size-checked joins, native word splitting."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words between white space, and words of letters, digits and all that is not ASCII (of lower-cased text).
SPACED, ALPHANUMERIC = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Sides of up to so many rows and bytes may be broadcast; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one, but only if all tasks run in this process."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="precepta-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written as a table of its own in the shared folder, so that it has no lineage to recompute."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._cut_path = path
    return kept


def forget(*kept: DataFrame) -> None:
    """Deletes the tables of cut() that no plan to come reads."""
    for df in kept:
        delete(df.sparkSession, df._cut_path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def in_python(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow(function, schema), with this package sent to the executors once for each application."""
    context = df.sparkSession.sparkContext
    if not getattr(context, "_has_precepta", False):
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="precepta-")) / "precepta.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        context.addPyFile(str(archive))
        context._has_precepta = True
    return df.mapInArrow(function, schema)


def is_small(df: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Whether df has at most so many rows, and bytes of their values as text; counts no more than those."""
    rows, size = BROADCAST_ROWS if rows is None else rows, BROADCAST_BYTES if size is None else size
    n, found = df.limit(rows + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return n <= rows and (found or 0) <= size


def checked_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it is small, which is counted first; as it is otherwise."""
    return F.broadcast(df) if is_small(df, rows) else df


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


#: The ASCII characters that are neither letters nor digits.
BETWEEN_WORDS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def alphanumeric_words(text: Column) -> Column:
    """Array of the words (see ALPHANUMERIC) of lower-cased text; empty for null.

    One pass lowers letters and blanks out all else, so that a split at single blanks, without a pattern, gives the words.
    """
    blanked = F.translate(text, UPPER + BETWEEN_WORDS, LOWER + " " * len(BETWEEN_WORDS))
    return F.coalesce(F.array_remove(F.split(blanked, " "), ""), F.array().cast("array<string>"))
