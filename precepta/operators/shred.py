"""Shredding of ordered blocks: bodies, heading paths, signature cuts, block kinds, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precepta.functions.text import fold

# Heading words and their depth, and kinds of blocks by the title's beginning, in order.
HEADING_LEVELS = {"libro": 0, "titulo": 1, "capitulo": 2, "seccion": 3, "subseccion": 4}
KINDS = (
    ("precepto", r"^articulo"), ("disposicion_adicional", r"^disposicion(es)? adicional"), ("disposicion_transitoria", r"^disposicion(es)? transitoria"),
    ("disposicion_derogatoria", r"^disposicion(es)? derogatoria"), ("disposicion_final", r"^disposicion(es)? final"), ("anexo", r"^anexo"),
    ("encabezado", r"^(libro|titulo|capitulo|seccion|subseccion)\b"), ("preambulo", r"^(preambulo|exposicion de motivos)"), ("firma", r"^firma"), ("nota", r"^nota"),
)


def block_kind(title: Column) -> Column:
    """The kind of a block by its title; desconocido if no pattern fits."""
    plain, out = F.trim(fold(title)), F.lit("desconocido")
    for name, pattern in reversed(KINDS):
        out = F.when(plain.rlike(pattern), name).otherwise(out)
    return out


def heading_level(title: Column) -> Column:
    """0 to 4 by the first word, 9 for anything else."""
    levels = F.create_map(*[F.lit(x) for pair in HEADING_LEVELS.items() for x in pair])
    return F.coalesce(F.try_element_at(levels, F.regexp_extract(F.trim(fold(title)), r"^(\w+)", 1)), F.lit(9))


def article_number(title: Column) -> Column:
    return F.regexp_extract(fold(title), r"^articulo\s+(\d+)", 1).try_cast("int")


def with_bodies(blocks: DataFrame, document: str = "norm", order: str = "position") -> DataFrame:
    """blocks (norm, position, kind, number) with body: it grows by one where an article's number falls below its forerunner's.

    Where a signature is followed by articles, the bodies are what lies up to it and what lies behind it.
    """
    by = Window.partitionBy(document).orderBy(order)  # the blocks of one act
    upto, whole = by.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(document)
    last = F.last(F.when(F.col("kind") == "precepto", F.col("number")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    falls = (F.col("kind") == "precepto") & (F.col("number") < last)
    signature = F.min(F.when(F.col("kind") == "firma", F.col(order))).over(whole)
    last_article = F.max(F.when(F.col("kind") == "precepto", F.col(order))).over(whole)
    marked = blocks.withColumn("_falls", F.coalesce(falls, F.lit(False)).cast("int")).withColumn("_cut", F.when(last_article > signature, signature))
    body = F.when(F.col("_cut").isNotNull(), (F.col(order) > F.col("_cut")).cast("long")).otherwise(F.sum("_falls").over(upto))
    return marked.withColumn("body", body).drop("_falls", "_cut")


def with_context(blocks: DataFrame, document: str = "norm", order: str = "position") -> DataFrame:
    """blocks (norm, body, position, kind, title) with context: the headings above a block, outermost first.

    The heading of depth L is the last one of depth up to L, if its depth is L. Provisions and annexes have none.
    """
    over = Window.partitionBy(document, "body").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    depth = F.when(F.col("kind") == "encabezado", heading_level(F.col("title")))
    out, names = blocks.withColumn("_depth", depth), []
    for d in range(5):
        last = F.last(F.when(F.col("_depth") <= d, F.struct("_depth", "title")), ignorenulls=True).over(over)
        out = out.withColumn(f"_at{d}", F.when(last["_depth"] == d, last["title"]))
        names.append(f"_at{d}")
    plain = F.col("kind").startswith("disposicion") | (F.col("kind") == "anexo")
    return out.withColumn("context", F.when(plain, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*names)))).drop("_depth", *names)


def reform_note(text: Column) -> Column:
    """struct(action, norm, refs) of a reform note."""
    plain = fold(text)
    action = F.when(plain.contains("se modifica"), "modifica").when(plain.contains("se anade"), "anade").when(plain.contains("se suprime"), "suprime").when(plain.contains("se deroga"), "deroga").when(plain.contains("redactado"), "redacta").otherwise("otra")
    return F.struct(action.alias("action"), F.nullif(F.regexp_extract(text, r"((?:Ley|Real Decreto(?:-ley)?|Orden)[^,]*?\d+/\d{4})", 1), F.lit("")).alias("norm"), F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(BOE-[A-Z]-\d{4}-\d+)"), F.lit(1)))).alias("refs"))


def pending_reforms(later: DataFrame, versions: DataFrame) -> DataFrame:
    """Those of later (norm, reform_id, ...) that no version (norm, origin) of the norm incorporates."""
    done = versions.select("norm", F.col("origin").alias("reform_id")).distinct()
    return later.join(done, ["norm", "reform_id"], "left_anti")
