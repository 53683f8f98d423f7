"""Consolidated acts in XML: blocks with their versions, notes and editorial remarks, bodies and headings, citable or not."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precepta.functions.text import fold
from precepta.operators import shred, temporal
from precepta.operators.graph import SUFFIX

# Classes of notes, what editors add, containers, and lines that complete a heading.
NOTE_CLASSES = ["nota_pie", "nota_pie_2", "nota_pie_3"]
EDITORIAL = "nota_editorial"
CONTAINERS = ("blockquote", "div", "ul", "ol")
HEADING_CLASSES = ["titulo_tit", "capitulo_tit", "seccion"]
SUPPRESSED = r"(?i)^\(?\s*(suprimid|derogad|sin contenido|anulad)"
CITED_NORM = r"(?i)\b((?:Ley Org[aá]nica|Ley|Real Decreto-ley|Real Decreto Legislativo|Real Decreto|Decreto-ley|Orden|Reglamento)\s+[\w/\-]*\d+/\d{4})"
LONG_DATE = r"(?i)\bde\s+(\d{1,2})\s+de\s+([a-záéíóú]+)(?:\s+de\s+(\d{4}))?"
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
CITABLE = ["precepto", "anexo", "disposicion_adicional", "disposicion_transitoria", "disposicion_derogatoria", "disposicion_final"]

VERSIONS = "array<struct<source:string,published:string,effective:string,lines:array<struct<class:string,text:string>>>>"


def block_versions(xml: Column) -> Column:
    """The versions of a block's XML, each with its lines in order and their classes; null where it isn't well formed.

    What stands in a quoted block with a class is the editors', but for notes. The reader goes to the executors by value.
    """
    notes, editorial, containers = NOTE_CLASSES, EDITORIAL, CONTAINERS

    def read(block: pd.Series) -> pd.Series:
        from xml.etree import ElementTree

        def squeezed(element):
            return " ".join("".join(element.itertext()).split())

        def table_rows(element):
            rows = ([squeezed(c) for c in tr if c.tag in ("td", "th")] for tr in element.iter("tr"))
            return "\n".join(" | ".join(cells) for cells in rows if any(cells))

        def lines(version):
            open_nodes = [(child, False) for child in reversed(version)]
            while open_nodes:
                node, quoted = open_nodes.pop()
                if node.tag in containers:
                    inside = quoted or (node.tag == "blockquote" and bool(node.get("class")))
                    open_nodes += [(child, inside) for child in reversed(node)]
                    continue
                own = {"p": node.get("class") or "", "table": "tabla", "li": ""}.get(node.tag)
                if own is not None:
                    yield {"class": editorial if quoted and own not in notes else own, "text": table_rows(node) if node.tag == "table" else squeezed(node)}

        def versions(text):
            try:
                found = ElementTree.fromstring(text).findall("version")
            except (ElementTree.ParseError, TypeError):
                return None
            return [{"source": v.get("id_norma") or "", "published": v.get("fecha_publicacion"), "effective": v.get("fecha_vigencia"), "lines": list(lines(v))} for v in found]

        return block.map(versions)

    return F.pandas_udf(read, VERSIONS)(xml)


def attribute(xml: Column, name: str) -> Column:
    """An attribute of an element's first tag, with the five named references decoded; empty if it has none."""
    value = F.regexp_extract(xml, rf"""(?s)^<\w+\b[^>]*?\s{name}\s*=\s*["']([^"']*)["']""", 1)
    for entity, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        value = F.replace(value, F.lit(f"&{entity};"), F.lit(char))
    return F.trim(value)


def act_blocks(acts: DataFrame) -> DataFrame:
    """(norm, position, xml): the blocks of acts (norm, xml), a row each, in order."""
    found = F.regexp_extract_all("xml", F.lit(r"(?s)<bloque\b[^>]*?/>|<bloque\b.*?</bloque\s*>"), F.lit(0))
    return acts.select("norm", F.posexplode(found).alias("position", "xml"))


def block_number(title: Column) -> Column:
    """'95' or '163 bis' of an article's title; empty for others."""
    return F.regexp_replace(F.regexp_extract(fold(title), r"^articulo\s+(\d+(?:\s+" + SUFFIX + r")?)", 1), r"\s+", " ")


def note_record(text: Column) -> Column:
    """struct(text, action, norm, date, refs) of a note on a reform. A date without a year has that of the norm's number."""
    plain = fold(text)
    begins = lambda verb: plain.startswith(verb) | F.contains(F.left(plain, F.lit(40)), F.lit(verb + "n"))
    action = F.when(begins("se modifica"), "modifica").when(begins("se anade"), "anade").when(begins("se suprime"), "suprime").when(begins("se deroga"), "deroga").when(F.contains(plain, F.lit("correccion de errores")), "correccion").otherwise("otro")
    norm = F.regexp_extract(text, CITED_NORM, 1)
    day, month, year = (F.regexp_extract(text, LONG_DATE, g) for g in (1, 2, 3))
    name = F.regexp_replace(fold(month), "^setiembre$", "septiembre")
    number = F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")
    written = F.concat_ws("-", F.coalesce(F.nullif(year, F.lit("")), F.regexp_extract(norm, r"/(\d{4})\b", 1)), F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    date = F.when(number > 0, F.try_to_date(written, "yyyy-MM-dd"))
    refs = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(BOE-[A-Z]-\d{4}-\d+)\b"), F.lit(1))))
    return F.struct(text.alias("text"), action.alias("action"), norm.alias("norm"), date.alias("date"), refs.alias("refs"))


def _dated(version: Column, order: Column) -> Column:
    lines = F.transform(F.filter(version["lines"], lambda x: ~x["class"].isin([*NOTE_CLASSES, EDITORIAL]) & (x["text"] != "")), lambda x: x["text"])
    text = F.array_join(lines, "\n")
    published, effective = temporal.compact_date(version["published"]), temporal.compact_date(version["effective"])
    used = temporal.repaired_date(effective, published)
    return F.struct(
        order.alias("order"), version["source"].alias("source"), published.alias("published"), effective.alias("effective"), used["date"].alias("used"),
        (~used["date"].eqNullSafe(effective)).alias("repaired"), used["reason"].alias("reason"), text.alias("text"), text.rlike(SUPPRESSED).alias("suppressed"),
    )


def shredded(acts: DataFrame) -> DataFrame:
    """The blocks of acts (norm, xml): norm, position, block_id, kind, title, number, body, context, versions, notes, editorial, incidents, expires, citable.

    A version's text is what was enacted: notes and what editors quote stand in lists of their own, each once, in order. The
    body grows where article numbers fall, or behind a signature that articles follow; headings above a block are its context,
    with the line that completes them. incidents tell missing versions, texts and dates, and XML that can't be read. A null
    act has no blocks. Work on a block stays in its row; bodies and contexts take the blocks of one act together.
    """
    blocks = act_blocks(acts).select("norm", "position", "xml", *[attribute(F.col("xml"), a).alias(b) for a, b in (("id", "block_id"), ("titulo", "title"), ("tipo", "declared"), ("fecha_caducidad", "_expires"))])
    read = blocks.withColumn("_read", block_versions(F.col("xml"))).drop("xml")
    kind = shred.block_kind(F.col("title"))
    kind = F.when(kind == "desconocido", F.when(F.col("declared") == "firma", "firma").otherwise(kind)).otherwise(kind)
    lines = F.flatten(F.transform("_read", lambda v: v["lines"]))
    texts = lambda keep: F.array_distinct(F.transform(F.filter(lines, lambda x: keep(x) & (x["text"] != "")), lambda x: x["text"]))
    completes = F.get(F.filter(F.get("_read", F.lit(0))["lines"], lambda x: x["class"].isin(HEADING_CLASSES) & (x["text"] != "")), F.lit(0))["text"]
    rows = read.select(
        "norm", "position", "block_id", kind.alias("kind"), "title", block_number(F.col("title")).alias("label"), F.regexp_extract(block_number(F.col("title")), r"^(\d+)", 1).try_cast("int").alias("number"),
        F.when(kind == "encabezado", F.concat_ws(". ", "title", completes)).otherwise(F.col("title")).alias("_heading"), F.coalesce(F.transform("_read", _dated), F.array()).alias("versions"),
        F.coalesce(F.transform(texts(lambda x: x["class"].isin(NOTE_CLASSES)), note_record), F.array()).alias("notes"), F.coalesce(texts(lambda x: x["class"] == EDITORIAL), F.array().cast("array<string>")).alias("editorial"),
        F.col("_read").isNull().alias("_broken"), temporal.compact_date(F.col("_expires")).alias("expires"), "_expires",
    )
    told = lambda v: F.array_compact(F.array(F.when(v["reason"] != "", F.concat(F.lit("version "), v["order"], F.lit(": "), v["reason"])), F.when(F.trim(v["text"]) == "", F.concat(F.lit("version "), v["order"], F.lit(": empty")))))
    of_block = F.array_compact(F.array(F.when(F.col("_broken"), "unreadable").when(F.size("versions") == 0, "no version"), F.when((F.col("_expires") != "") & F.col("expires").isNull(), "unreadable expiry")))
    rows = rows.withColumn("incidents", F.concat(of_block, F.flatten(F.transform("versions", told)))).drop("_broken", "_expires")
    placed = shred.with_context(shred.with_bodies(rows).withColumnsRenamed({"title": "_title", "_heading": "title"}))
    return placed.select("norm", "position", "block_id", "kind", F.col("_title").alias("title"), F.col("label").alias("number"), "body", "context", "versions", "notes", "editorial", "incidents", "expires", F.col("kind").isin(CITABLE).alias("citable"))


def structure_profile(acts: DataFrame) -> DataFrame:
    """(what, name, n): how often each tag, attribute and class occurs in acts (norm, xml), counted in tasks before the shuffle."""
    tags = F.regexp_extract_all("xml", F.lit(r"<([a-zA-Z_]\w*)\b"), F.lit(1))
    attributes = F.regexp_extract_all("xml", F.lit(r"\s([a-zA-Z_]\w*)\s*=\s*[\"'][^\"'<]*[\"'](?=[^<]*>)"), F.lit(1))
    classes = F.regexp_extract_all("xml", F.lit(r"\sclass\s*=\s*[\"']([^\"'<]*)[\"']"), F.lit(1))
    named = lambda what, found: F.transform(found, lambda x: F.struct(F.lit(what).alias("what"), x.alias("name")))
    each = acts.select(F.explode(F.concat(named("tag", tags), named("attribute", attributes), named("class", classes))).alias("e"))
    return each.groupBy("e.what", "e.name").agg(F.count("*").alias("n"))
