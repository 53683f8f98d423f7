"""Places in texts: quotations with what surrounds them, what they cite, mentions inside quoted blocks, and masks that move no character."""

from __future__ import annotations

import re
import sys

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from precepta.operators.graph import NORM_NUMBER, SUFFIX
from precepta.operators.verify import ADDRESS, CLAIMS

# Families of quotation marks, shortest quotation, what may stand between a quotation and its brackets, and what is masked, in turn.
FAMILIES, SHORTEST = ("«»", "“”", '""'), 3
GLUED = r"[\s,;:.—-]{0,6}[(\[{]([^)\]}]+)[)\]}]"
MASKED = ("[«\"“][^»\"”]*[»\"”]", r"\([^()]*\)", r"https?://[^\s)\]}>,;]+")
# What a reference looks like, by kind; the first group is its number. The first two kinds go before the others.
KINDS = {
    "criterion": r"\b(\d{2}/\d{4,5}/\d{4}/\d{2}/\d{1,2}(?:/\d+)?)\b",
    "ruling": r"\b([VC]\d{3,5}-\d{2})\b",
    "article": r"(?i)\b(?:art[íi]culo|art\.)\s+(\d+(?:\s+" + SUFFIX + r"\b)?)",
    "provision": r"(?i)\bdisposici[óo]n\s+((?:adicional|transitoria|final|derogatoria)\s+(?:\p{L}+|\d+))",
}
STOPS = re.compile(r"[()\[\]{}.;\n«“\"]")
MENTIONED = re.compile(r"[aA][rR][tT](?<!\w...)(?i:[íi]culo|\.)\s+(\d+)")  # begins with its letters, as re skips to such fast
NORM_NAMED, BLANKS = re.compile(NORM_NUMBER), " \t\n\v\f\r"

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # its functions go to the tasks themselves, where this package may not be


def _struct(**fields: type) -> ArrayType:
    """array<struct> with these fields; no DDL text, as tasks load this module without a session."""
    struct = StructType()
    for name, kind in fields.items():
        struct = struct.add(name, kind())
    return ArrayType(struct)


_QUOTATION = _struct(start=IntegerType, end=IntegerType, literal=StringType, since=IntegerType, before=StringType, glued_at=IntegerType, glued=StringType, after=StringType)
_PLACE = _struct(start=IntegerType, end=IntegerType, found=StringType, number=StringType)


def _sentence_end(text: str, start: int) -> int:
    """Where the sentence from start ends: behind a full stop, semicolon or line break outside all brackets, or before a quotation."""
    depth = 0
    for mark in STOPS.finditer(text, start):
        sign = mark[0]
        if sign in "([{":
            depth += 1
        elif sign in ")]}":
            depth = max(depth - 1, 0)
        elif sign in "«“\"":
            if mark.start() > start:
                return mark.start()
        elif depth == 0:
            return mark.end()
    return len(text)


def _quoted(text: str) -> list[tuple[int, int]]:
    """(start, end) of the quotations of a text in order, each with its marks: of those that overlap the one that begins first."""
    pairs = []
    for opens, closes in FAMILIES:
        at = 0
        while (start := text.find(opens, at)) >= 0 and (end := text.find(closes, start + 1)) >= 0:
            at = end + 1
            if len(text[start + 1 : end].strip()) >= SHORTEST:
                pairs.append((start, at))
    if len(pairs) < 2:
        return pairs
    kept, last = [], 0
    for start, end in sorted(pairs):
        if start >= last:
            kept.append((start, end))
            last = end
    return kept


def _since(text: str, start: int, last: int) -> int:
    """Where what stands before a quotation at start begins: behind the last closing mark; the quotation before it ends at last."""
    begin = max(last - 1, 0)
    return max(text.rfind("»", begin, start), text.rfind("”", begin, start), text.rfind('"', begin, start)) + 1


@F.pandas_udf(_QUOTATION)
def quotations(texts: pd.Series) -> pd.Series:
    """The quotations of each text, with offsets in characters: of those that overlap the one that begins first.

    before: from the last closing mark on (since); glued: what stands in brackets right behind; after: the rest of the sentence.
    """

    def read(text: str | None) -> list[dict]:
        found, last = [], 0
        for start, end in _quoted(text or ""):
            since, glued = _since(text, start, last), re.compile(GLUED).match(text, end)
            found.append({
                "start": start, "end": end, "literal": text[start + 1 : end - 1].strip(), "since": since, "before": text[since:start],
                "glued_at": glued.start(1) if glued else None, "glued": glued[1] if glued else None, "after": text[end : _sentence_end(text, end)],
            })
            last = end
        return found

    return texts.map(read)


def _norm_before(text: str, since: int, start: int) -> str | None:
    """The first norm named in the sentence that goes up to start and begins at since at the earliest; a line break right before start ends none."""
    end = start - 1 if text.endswith("\n", since, start) else start
    since = max(since, text.rfind(";", since, end) + 1, text.rfind("\n", since, end) + 1)
    stop = end
    while (stop := text.rfind(".", since, stop)) >= 0:
        if stop + 1 < start and text[stop + 1] in BLANKS:
            since = stop + 1
            break
    named = NORM_NAMED.search(text[since:end])
    return named[1] if named else None


@F.arrow_udf(_struct(start=IntegerType, number=StringType, norm=StringType))
def _mentions(texts: pa.Array, owns: pa.Array) -> pa.Array:
    """The mentions of articles in each text, with the norm that the quotation around them goes into, unless it is the text's own."""
    ends, starts, numbers, norms = [0], [], [], []
    for text, own in zip(texts.to_pylist(), owns.to_pylist()):
        quoted, i, read, norm = None, 0, None, None
        for found in MENTIONED.finditer(text or ""):
            quoted, at = _quoted(text) if quoted is None else quoted, found.start()
            while i < len(quoted) and quoted[i][1] <= at:
                i += 1
            inside = i < len(quoted) and quoted[i][0] < at
            if inside and read != i:
                norm, read = _norm_before(text, _since(text, quoted[i][0], quoted[i - 1][1] if i else 0), quoted[i][0]), i
            starts.append(at)
            numbers.append(found[1])
            norms.append(norm if inside and norm != own else None)
        ends.append(len(starts))
    each = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(numbers, pa.string()), pa.array(norms, pa.string())], ["start", "number", "norm"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)


def _matches(pattern: str):
    """A column function that gives all places where a pattern matches, as array of (start, end, found, number)."""

    @F.pandas_udf(_PLACE)
    def places(texts: pd.Series) -> pd.Series:
        sought = re.compile(pattern)
        return texts.map(lambda text: [(m.start(), m.end(), m[0], m[1] if sought.groups else None) for m in sought.finditer(text or "")])

    return places


@F.pandas_udf(StringType())
def _blanked(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts with what MASKED fits, and the spans (start, end), written over by blanks of the same length."""

    def blank(text: str | None, cited) -> str | None:
        if text is None:
            return None
        for pattern in MASKED:
            text = re.sub(pattern, lambda m: " " * len(m[0]), text)
        pieces, last = [], 0
        for start, end in sorted((s["start"], s["end"]) for s in (cited if cited is not None else [])):
            if start >= last:
                pieces += [text[last:start], " " * (end - start)]
                last = end
        return "".join([*pieces, text[last:]])

    return pd.Series([blank(*each) for each in zip(texts, spans)], index=texts.index, dtype=object)


def _reference(part: Column, base: Column, last: bool) -> Column:
    """struct(kind, number, start, end) of the first or last reference in a part of a text that begins at base; null without one."""
    read = {}
    for kind, pattern in KINDS.items():
        raw = F.try_element_at(F.regexp_extract_all(part, F.lit(pattern), F.lit(0)), F.lit(-1 if last else 1))
        at = F.length(part) - F.instr(F.reverse(part), F.reverse(raw)) - F.length(raw) + 1 if last else F.instr(part, raw) - 1
        number = F.regexp_replace(F.regexp_extract(raw, pattern, 1), r"\s+", " ")
        read[kind] = (raw, at, F.when(raw.isNotNull(), F.struct(F.lit(kind).alias("kind"), number.alias("number"), (base + at).alias("start"), (base + at + F.length(raw)).alias("end"))))
    (article, a, own), (provision, p, other) = read["article"], read["provision"]
    nearer = F.when(article.isNull() | (p > a if last else p < a), other).otherwise(own)
    return F.coalesce(read["criterion"][2], read["ruling"][2], F.when(provision.isNull(), own).otherwise(nearer))


def _cited(text: Column) -> Column:
    """array of the quotations of a text with the reference of each: in the brackets behind it, else the last before it, else the first behind it."""

    def each(q: Column) -> Column:
        reference = F.coalesce(_reference(q["glued"], q["glued_at"], False), _reference(q["before"], q["since"], True), _reference(q["after"], q["end"], False))
        address = lambda c: F.nullif(F.rtrim(F.regexp_extract(c, ADDRESS, 1), F.lit(".,;)")), F.lit(""))
        link = F.coalesce(address(F.coalesce(q["glued"], q["after"])), address(q["before"]))
        return F.struct(q["start"].alias("start"), q["end"].alias("end"), q["literal"].alias("literal"), reference.alias("reference"), link.alias("link"))

    return F.transform(quotations(text), each)


def placed_citations(docs: DataFrame) -> DataFrame:
    """(doc_id, n, start, end, literal, kind, number, link) of docs (doc_id, text): each quotation with its offsets and reference.

    Quotation marks of three families; of overlapping quotations the one that begins first counts. A sentence ends outside
    brackets only, or where the next quotation begins. n counts from 0. Null and empty texts have no rows; a quotation
    without a reference has a null kind and number. Each row is read by itself, without a shuffle; repeated rows stay.
    """
    each = docs.select("doc_id", F.posexplode(_cited(F.col("text"))).alias("n", "c"))
    return each.select("doc_id", "n", "c.start", "c.end", "c.literal", "c.reference.kind", "c.reference.number", "c.link")


def masked(docs: DataFrame) -> DataFrame:
    """docs with `masked`: text with quotations, brackets, addresses and what citations refer to as blanks; all offsets stay. Null stays null."""
    cited = F.filter(F.transform(_cited(F.col("text")), lambda c: F.struct(c["reference"]["start"].alias("start"), c["reference"]["end"].alias("end"))), lambda s: s["start"].isNotNull())
    return docs.withColumn("masked", _blanked(F.col("text"), cited))


def placed_claims(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, claim, start): statements of docs (doc_id, text) that nothing quoted or cited supports, with their offsets in text."""
    hidden = masked(docs).select("doc_id", "masked")
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), _matches(pattern)(F.col("masked")).alias("places")) for kind, pattern in CLAIMS.items()])
    each = hidden.select("doc_id", F.explode(kinds).alias("k")).select("doc_id", "k.kind", F.explode("k.places").alias("p"))
    return each.select("doc_id", "kind", F.col("p.found").alias("claim"), F.col("p.start").alias("start"))


def placed_mentions(docs: DataFrame) -> DataFrame:
    """(origin, start, number, norm) of articles mentioned in docs (origin, own, text); norm: what the quoted block around it goes into.

    A block is a quotation whose opening sentence, of any length, names a norm by number; its first norm, unless it is own,
    is that of the mentions between the marks. Elsewhere norm is null: the text's own. Blocks are told by their places, so
    equal words outside them are kept apart. Each row is read by itself in one pass, without a shuffle; repeated rows stay.
    """
    return docs.select("origin", F.inline(_mentions(F.col("text"), F.col("own").cast("string"))))
