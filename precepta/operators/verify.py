"""Quotations: extraction from texts, literal location in a corpus, verdicts with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precepta.functions.text import fold, normal_literal, small_letters
from precepta.operators.graph import SUFFIX
from precepta.operators.rulings import label_check, resolution_key
from precepta.sources.readers import cut

#: So many words are sought, and so many literals tested, in one scan; so many words may be broadcast to be counted.
KEY_WORDS, BROADCAST_WORDS = 2_000, 100_000
# Shorter quotations are verified with a caution; patterns of statements that need a source.
SHORT_QUOTE = 25
CLAIMS = {"percentage": r"\d+(?:[.,]\d+)?\s?%", "deadline": r"(?i)\b\d+\s+(?:d[íi]as?|meses|a[ñn]os?|days?|months?|years?)\b", "money": r"(?i)\b\d[\d.,]*\s?(?:€|euros?|eur)\b", "article": r"(?i)\bart[íi]culos?\s+\d+"}
QUOTED = r"«[^»]{3,}»|“[^”]{3,}”|\"[^\"]{3,}\""
ADDRESS = r"(https?://[^\s)\]]+)"
REFERENCE = r"(?i)\b(?:art[íi]culo|art\.|article)\s+(\d+(?:\s+" + SUFFIX + r")?)"


def citations(docs: DataFrame) -> DataFrame:
    """(doc_id, n, literal, number, link, pieces) of the quotations in texts.

    Quotation marks of three kinds; a reference in parentheses right behind the quotation is its own, else the first one up
    to the end of the sentence behind it, else the last one before it. link: the first address in these parentheses, in
    that sentence, or behind it before another quotation, else the last one before the quotation; pieces: the literal split
    at ellipses.
    """
    text = F.col("text")
    quotes = F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0))
    located = docs.select("doc_id", "text", F.posexplode(quotes).alias("n", "quote"))
    inner = F.trim(F.expr("substring(quote, 2, length(quote) - 2)"))
    # the n-th quotation of equal ones is told apart by the count of its equals before it
    same = F.expr("size(filter(slice(regexp_extract_all(text, '" + QUOTED.replace("\\", "\\\\").replace("'", "\\'") + "', 0), 1, n), x -> x = quote))") + 1
    located = located.withColumn("same", same).withColumn("before", F.expr("substring_index(text, quote, same)")).withColumn("after", F.expr("substring(text, length(before) + length(quote) + 1)"))
    glued = F.regexp_extract("after", r"^\s*\(([^)]*)\)", 1)
    sentence = F.regexp_extract("after", r"(?s)^(.*?)(?:[.;]\s|[«“\"]|$)", 1)
    number = lambda c: F.nullif(F.regexp_extract(c, REFERENCE, 1), F.lit(""))
    last = F.try_element_at(F.regexp_extract_all("before", F.lit(REFERENCE), F.lit(1)), F.lit(-1))
    address = lambda c: F.nullif(F.regexp_extract(c, ADDRESS, 1), F.lit(""))
    behind = F.regexp_extract("after", r"(?s)^([^«“]*)", 1)
    link = F.coalesce(address(glued), address(sentence), address(behind), F.try_element_at(F.regexp_extract_all("before", F.lit(ADDRESS), F.lit(1)), F.lit(-1)))
    pieces = F.filter(F.transform(F.split(inner, r"\[?(?:\.\.\.|…)\]?"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    return located.where(F.length(inner) >= 3).select("doc_id", "n", inner.alias("literal"), F.coalesce(number(glued), number(sentence), last).alias("number"), link.alias("link"), pieces.alias("pieces"))


def locate(literals: DataFrame, corpus: DataFrame) -> DataFrame:
    """(literal_id, doc_id): the documents that contain a literal, of literals (literal_id, literal) and corpus (doc_id, text).

    Both are normalised. A containment join would test all pairs; instead each literal is keyed by its rarest inner word
    (those at its ends may be parts of longer ones), and only documents with that word are tested. With up to KEY_WORDS
    keys, a document's own ones are found and tested in one scan that shuffles no text; with more, key words are joined
    to documents, and these to their texts. Literals without an inner word are tested on all texts, KEY_WORDS in a scan.
    """
    split = lambda c: F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), F.lit(0))
    asked = literals.select("literal_id", normal_literal(F.col("literal")).alias("literal")).where("literal != ''").withColumn("inner", split(F.col("literal")))
    asked = cut(asked.withColumn("inner", F.when(F.size("inner") > 2, F.expr("slice(inner, 2, size(inner) - 2)"))))
    texts = corpus.select("doc_id", normal_literal(F.col("text")).alias("text"))
    pairs = asked.select("literal_id", F.explode(F.array_distinct("inner")).alias("word"))
    sought = pairs.select("word").distinct()
    index = lambda words: texts.select("doc_id", F.explode(F.array_distinct(split(F.col("text")))).alias("word")).join(words, "word")
    counts = cut(index(F.broadcast(sought) if sought.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else sought).groupBy("word").agg(F.count("*").alias("n")))
    keys = pairs.join(counts, "word", "left").groupBy("literal_id").agg(F.count_if(F.col("n").isNull()).alias("absent"), F.min(F.struct("n", "word"))["word"].alias("word")).where("absent = 0")
    keyed = cut(keys.join(asked, "literal_id").select("literal_id", "literal", "word"))
    few = [r[0] for r in keyed.select("word").distinct().limit(KEY_WORDS + 1).collect()]
    if len(few) <= KEY_WORDS:
        own = texts.select("doc_id", "text", F.explode(F.array_intersect(split(F.col("text")), F.array(*map(F.lit, few)).cast("array<string>"))).alias("word"))
        hits = own.join(keyed, "word").where(F.contains("text", "literal")).select("literal_id", "doc_id")
    else:
        found = index(keyed.select("word", "literal_id")).select("doc_id", "literal_id")
        hits = found.join(keyed.select("literal_id", "literal"), "literal_id").join(texts, "doc_id").where(F.contains("text", "literal")).select("literal_id", "doc_id")
    short = [r[0] for r in asked.where("inner IS NULL").select("literal").distinct().toLocalIterator()]
    for block in (short[i : i + KEY_WORDS] for i in range(0, len(short), KEY_WORDS)):
        inside = F.filter(F.array(*map(F.lit, block)), lambda x: F.contains(F.col("text"), x))
        hits = hits.union(texts.select("doc_id", F.explode(inside).alias("literal")).join(asked.where("inner IS NULL"), "literal").select("literal_id", "doc_id"))
    return hits.distinct()


def verdicts(cited: DataFrame, articles: DataFrame) -> DataFrame:
    """cited (cite_id, literal, number, link, pieces) against articles (number, key, text, in_force, url): cite_id, verdict, reason.

    In order: no reference, unknown or ambiguous article, not in force, a quotation with gaps, literal and link, near misses.
    """
    one = articles.groupBy("number").agg(F.count("*").alias("n"), F.min(F.struct("key", "text", "in_force", "url")).alias("one")).select("number", "n", "one.*")
    joined = cited.join(one, "number", "left")
    literal, text = normal_literal(F.col("literal")), normal_literal(F.coalesce("text", F.lit("")))
    inside = F.contains(text, literal)
    link_ok = F.col("link").isNull() | (F.rtrim(F.col("link"), F.lit("/")) == F.rtrim(F.col("url"), F.lit("/")))
    verdict, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    ladder = [
        (F.col("number").isNull(), "REJECTED", "no_reference"),
        (F.col("n").isNull(), "REJECTED", "not_found"),
        (F.col("n") > 1, "REJECTED", "ambiguous"),
        (~F.col("in_force"), "REJECTED", "not_in_force"),
        (F.size("pieces") > 1, "REJECTED", "gaps"),
        (inside & ~link_ok, "REJECTED", "wrong_link"),
        (inside & (F.length(literal) < SHORT_QUOTE), "VERIFIED", "short"),
        (inside, "VERIFIED", ""),
        (F.contains(small_letters(text), small_letters(literal)), "REJECTED", "case_differs"),
        (F.contains(fold(text), fold(literal)), "REJECTED", "accents_differ"),
    ]
    verdict, reason = F.lit("REJECTED"), F.lit("not_literal")
    for condition, v, r in reversed(ladder):
        verdict, reason = F.when(condition, v).otherwise(verdict), F.when(condition, r).otherwise(reason)
    return joined.select("cite_id", verdict.alias("verdict"), reason.alias("reason"))


def text_verdict(judged: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, n_citations, accepted) of judged (doc_id, verdict) and texts (doc_id): all must be verified, and there must be one."""
    per = judged.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and(F.col("verdict") == "VERIFIED").alias("all"))
    return texts.select("doc_id").join(per, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_citations"), F.coalesce("all", F.lit(False)).alias("accepted"))


def unsupported_claims(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, claim, n): statements outside quotations, parentheses and addresses."""
    bare = F.regexp_replace("text", QUOTED + r"|\([^)]*\)|https?://\S+", " ")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(bare, F.lit(p), F.lit(0)).alias("claims")) for k, p in CLAIMS.items()])
    return docs.select("doc_id", F.explode(kinds).alias("k")).select("doc_id", "k.kind", F.explode("k.claims").alias("claim")).groupBy("doc_id", "kind", "claim").agg(F.count("*").alias("n"))


# Numbers of rulings and of criteria in addresses.
RULING_IN_LINK = r"\b(V\d{3,5}-\d{2})\b"
ASKED_IN_LINK = r"(?i)num_consulta=([VC]?\d{3,5}-\d{2})"
CRITERION_IN_LINK = r"\b(\d{2}/\d{4,5}/\d{4}/\d{2}/\d{1,2}(?:/\d+)?)\b"


def _whole(*parts: str) -> Column:
    """One normalised text of several columns; nulls are empty."""
    return normal_literal(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def _judged(joined: DataFrame, ladder: list[tuple[Column, str, str]]) -> DataFrame:
    """(cite_id, verdict, reason) by the first condition that holds; verified if none does."""
    verdict, reason = F.lit("VERIFIED"), F.lit("")
    for condition, v, r in reversed(ladder):
        verdict, reason = F.when(condition, v).otherwise(verdict), F.when(condition, r).otherwise(reason)
    return joined.select("cite_id", verdict.alias("verdict"), reason.alias("reason"))


def _absent(pieces: Column, text: Column) -> Column:
    """Whether a piece, normalised, isn't in a text."""
    return F.exists(F.transform(pieces, lambda p: normal_literal(p)), lambda p: (p != "") & ~F.contains(text, p))


def ruling_verdicts(cited: DataFrame, rulings: DataFrame) -> DataFrame:
    """cited (cite_id, number, pieces, link) against rulings (number, answer, question, facts): cite_id, verdict, reason.

    A ruling that isn't held can't be verified. Each piece of the quotation must stand in the ruling, and an address, if
    there is one, must name it. Of rulings that share a number the first by their text counts.
    """
    held = rulings.select(F.upper("number").alias("number"), _whole("answer", "question", "facts").alias("text")).groupBy("number").agg(F.min("text").alias("text"))
    joined = cited.withColumn("number", F.upper("number")).join(held, "number", "left")
    named = F.upper(F.coalesce(F.nullif(F.regexp_extract("link", RULING_IN_LINK, 1), F.lit("")), F.regexp_extract("link", ASKED_IN_LINK, 1)))
    linked = F.coalesce("link", F.lit("")) != ""
    return _judged(joined, [
        (F.col("text").isNull(), "UNVERIFIABLE", "not_held"), (_absent(F.col("pieces"), F.col("text")), "REJECTED", "not_literal"),
        (linked & (named == ""), "REJECTED", "link_without_number"), (linked & (named != F.col("number")), "REJECTED", "wrong_link"),
    ])


def tribunal_verdicts(cited: DataFrame, criteria: DataFrame) -> DataFrame:
    """cited (cite_id, number, label, pieces, link) against criteria (id, resolution, unit, criterion, subject): cite_id, verdict, reason.

    number is a criterion's id, or else a resolution's number. As ruling_verdicts, but that the label must name the tribunal as rulings.label_check asks, and an address may lead to
    another criterion of the same resolution. A criterion of an unknown tribunal can't be verified.
    """
    named = criteria.select(F.posexplode(F.array("id", "resolution")).alias("place", "number"), F.coalesce("unit", F.lit("")).alias("unit"), _whole("criterion", "subject").alias("text")).where("number IS NOT NULL")
    held = named.groupBy("number").agg(F.min(F.struct("place", "text", "unit")).alias("c")).select("number", "c.text", "c.unit")
    joined = cited.join(held, "number", "left").withColumn("label_state", label_check(F.col("label"), F.col("unit")))
    named, linked = F.regexp_extract("link", CRITERION_IN_LINK, 1), F.coalesce("link", F.lit("")) != ""
    labels = [(F.col("label_state") == state, "UNVERIFIABLE" if state == "no_unit" else "REJECTED", state) for state in ("no_unit", "not_central", "too_strong", "unnamed")]
    return _judged(joined, [
        (F.col("text").isNull(), "UNVERIFIABLE", "not_held"), *labels, (_absent(F.col("pieces"), F.col("text")), "REJECTED", "not_literal"),
        (linked & (named == ""), "REJECTED", "link_without_number"), (linked & ~resolution_key(named).eqNullSafe(resolution_key(F.col("number"))), "REJECTED", "wrong_link"),
    ])


def failure_diagnosis(failed: DataFrame, sources: DataFrame) -> DataFrame:
    """(cite_id, diagnosis) of quotations failed (cite_id, key, literal, text) that their article's version (text) lacks, over sources (source_id, key, enacted, text).

    not_enacted: it stands in a note or remark of the article, or only in such ones of others; other_version: in another
    version of the article; other_article; case_differs or accents_differ: but for these it is in the version; else absent.
    sources holds all versions, notes and remarks; the quotations are located in it as locate does.
    """
    hits = locate(failed.select(F.col("cite_id").alias("literal_id"), "literal"), sources.select(F.col("source_id").alias("doc_id"), "text"))
    asked = failed.select("cite_id", F.col("key").alias("asked"))
    found = hits.select(F.col("literal_id").alias("cite_id"), F.col("doc_id").alias("source_id")).join(sources.select("source_id", "key", "enacted"), "source_id").join(asked, "cite_id")
    own = F.col("key").eqNullSafe(F.col("asked"))
    flags = {"own_note": own & ~F.col("enacted"), "own_text": own & F.col("enacted"), "other_note": ~own & ~F.col("enacted"), "other_text": ~own & F.col("enacted")}
    by_cite = found.groupBy("cite_id").agg(*[F.bool_or(c).alias(name) for name, c in flags.items()])
    joined = failed.join(by_cite, "cite_id", "left").na.fill(False, list(flags))
    literal, text = normal_literal(F.col("literal")), normal_literal(F.coalesce("text", F.lit("")))
    note = F.col("own_note") | (~F.col("own_text") & ~F.col("other_text") & F.col("other_note"))
    near = F.when(F.contains(small_letters(text), small_letters(literal)), "case_differs").when(F.contains(fold(text), fold(literal)), "accents_differ").otherwise("absent")
    return joined.select("cite_id", F.when(note, "not_enacted").when(F.col("own_text"), "other_version").when(F.col("other_text"), "other_article").otherwise(near).alias("diagnosis"))
