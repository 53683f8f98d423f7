"""Ranked keyword search: weighted multi-field index (BM25F), gates, selection, quotas and snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precepta.functions.stem import stem, with_stem
from precepta.functions.text import STOP_WORDS, fold, plain, words
from precepta.sources.readers import cut

# Field weights and length normalisation, saturation, weight of exact forms, state floor, gates.
WEIGHTS, LENGTH_NORM = {"title": 4.0, "context": 0.8, "body": 1.0}, {"title": 0.35, "context": 0.35, "body": 0.75}
K1, EXACT_WEIGHT, STATE_FLOOR, MAX_ABSENT, MIN_COVERAGE, SELECTION = 1.4, 0.45, 2, 0.5, 0.5, 0.7


def fields(docs: DataFrame) -> DataFrame:
    """(doc_id, field, tokens) of docs (doc_id, text, lang, source): first line as title, the source as context, the rest as body.

    A text of one line is title and body alike.
    """
    line_end = F.instr("text", "\n")
    title = F.when(line_end > 0, F.substring_index("text", "\n", 1)).otherwise(F.col("text"))
    body = F.when(line_end > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.col("text"))
    parts = F.array(*[F.struct(F.lit(n).alias("field"), words(c).alias("tokens")) for n, c in (("title", title), ("context", F.concat_ws(" ", "source", "lang")), ("body", body))])
    return docs.select("doc_id", F.explode(parts).alias("f")).select("doc_id", "f.field", "f.tokens")


def postings(fielded: DataFrame) -> DataFrame:
    """(term, doc_id, field, tf)."""
    return fielded.select("doc_id", "field", F.explode("tokens").alias("term")).groupBy("term", "doc_id", "field").agg(F.count("*").alias("tf"))


def document_frequencies(posted: DataFrame) -> DataFrame:
    """(term, df): each document once, whatever the fields."""
    return posted.select("term", "doc_id").distinct().groupBy("term").agg(F.count("*").alias("df"))


def field_stats(fielded: DataFrame) -> DataFrame:
    """(field, n_docs, mean_length): means over all documents, 1 where they are 0."""
    return fielded.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("mean")).select("field", "n_docs", F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0).alias("mean_length"))


def _by_field(values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(F.col("field") == name, F.lit(value)).otherwise(out)
    return out


def bm25f(docs: DataFrame, query: list[str], exact: bool = False) -> DataFrame:
    """(doc_id, score, n_terms) of all documents with a term of the query, each term counted once.

    One scan: only postings of the query's terms and three lengths for each document leave it. The query, its frequencies
    and the field means are a handful of rows.
    """
    spark = docs.sparkSession
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(query)], "term string")
    fielded = fields(docs)
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(query)])
    hits = fielded.withColumn("length", F.size("tokens")).select("doc_id", "field", "length", F.explode(F.filter("tokens", lambda t: F.array_contains(wanted, t))).alias("term"))
    hits = cut(hits.groupBy("term", "doc_id", "field", "length").agg(F.count("*").alias("tf")))
    stats = field_stats(fielded)
    df = hits.groupBy("term").agg(F.count_distinct("doc_id").alias("df"))
    norm = 1 - _by_field(LENGTH_NORM) + _by_field(LENGTH_NORM) * F.col("length") / F.col("mean_length")
    weighted = hits.join(F.broadcast(stats), "field").groupBy("term", "doc_id").agg(F.sum(_by_field(WEIGHTS) * F.col("tf") / norm).alias("wtf"), F.first("n_docs").alias("n"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.lit(EXACT_WEIGHT if exact else 1.0) * idf * F.col("wtf") / (K1 + F.col("wtf"))
    return weighted.join(F.broadcast(df), "term").join(F.broadcast(asked), "term").groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("n_terms"))


def question_terms(question: str) -> tuple[list[str], list[str]]:
    """(stems, exact forms) of a question, each once and in order."""
    exact = [w for w in re.findall("[a-z0-9]+", plain(question)) if w not in STOP_WORDS and (len(w) > 1 or w.isdigit())]
    return list(dict.fromkeys(stem(w) for w in exact)), list(dict.fromkeys(exact))


def _near_stems(tokens: Column, stems: list[str]) -> Column:
    """Those of tokens that may have one of stems: a stem begins with the first three letters of its word."""
    return F.filter(tokens, lambda w: F.substring(w, 1, 3).isin([s[:3] for s in stems]))


def _having(rows: DataFrame, stems: list[str]) -> DataFrame:
    """rows (word, ...) with stem, those of stems only. Each distinct word is stemmed once; a filter on stems never meets their rules."""
    known = cut(with_stem(rows.select("word").distinct(), "word"))
    return rows.join(known.where(F.col("stem").isin(stems)), "word")


def stemmed_contributions(docs: DataFrame, question: str) -> DataFrame:
    """(doc_id, term, score, fields) of what each stem and exact form of the question adds to a document's BM25F score.

    Stems weigh 1, exact forms EXACT_WEIGHT; a stem and a form of one name are one term. A document's lengths count its
    words, which have one stem each. One scan with one split into words: words that can't have a stem of the question
    stay in it, the rest are counted before they are shuffled, and only these few are stemmed. Field means come from the
    same split, in a pass of its own.
    """
    stems, exact = question_terms(question)
    if not stems:
        return docs.sparkSession.createDataFrame([], "doc_id long, term string, score double, fields array<string>")
    fielded = fields(docs)
    near = fielded.select("doc_id", "field", F.size("tokens").alias("length"), F.explode(_near_stems(F.col("tokens"), stems)).alias("word"))
    found = cut(near.groupBy("doc_id", "field", "length", "word").agg(F.count("*").alias("tf")))
    named = F.array(F.struct(F.col("stem").alias("term"), F.lit(False).alias("exact")), F.struct(F.col("word").alias("term"), F.lit(True).alias("exact")))
    each = _having(found, stems).select("doc_id", "field", "length", "tf", F.inline(named)).where(~F.col("exact") | F.col("term").isin(exact))
    hits = cut(each.groupBy("term", "exact", "doc_id", "field", "length").agg(F.sum("tf").alias("tf")))
    stats = field_stats(fielded)
    df = hits.groupBy("term", "exact").agg(F.count_distinct("doc_id").alias("df"))  # as many rows as the question has terms
    norm = 1 - _by_field(LENGTH_NORM) + _by_field(LENGTH_NORM) * F.col("length") / F.col("mean_length")
    weighted = hits.join(F.broadcast(stats), "field").groupBy("term", "exact", "doc_id").agg(F.sum(_by_field(WEIGHTS) * F.col("tf") / norm).alias("wtf"), F.first("n_docs").alias("n"), F.collect_set("field").alias("fields"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(F.col("exact"), EXACT_WEIGHT).otherwise(1.0) * idf * F.col("wtf") / (K1 + F.col("wtf"))
    return weighted.join(F.broadcast(df), ["term", "exact"]).groupBy("doc_id", "term").agg(F.sum(part).alias("score"), F.array_distinct(F.flatten(F.collect_list("fields"))).alias("fields"))


def stemmed_bm25f(docs: DataFrame, question: str) -> DataFrame:
    """(doc_id, score, n_terms, fields, contributions): the sums of stemmed_contributions, the fields touched, and each term's share."""
    each = stemmed_contributions(docs, question)
    fields_ = F.array_sort(F.array_distinct(F.flatten(F.collect_list("fields"))))
    parts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", F.round("score", 6).alias("score")))))  # no more than the question's terms
    return each.groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("n_terms"), fields_.alias("fields"), parts.alias("contributions"))


def stem_counts(docs: DataFrame) -> DataFrame:
    """(stem, df, tf): documents and occurrences of each stem; words are counted first, and each distinct one stemmed once."""
    counted = docs.select("doc_id", F.explode(words(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return counted.join(with_stem(counted.select("term").distinct()), "term").groupBy("stem").agg(F.count_distinct("doc_id").alias("df"), F.sum("tf").alias("tf"))


def stems_found(docs: DataFrame, stems: list[str], key: str = "doc_id") -> DataFrame:
    """(key, found): which of stems a document's text has, for those that have any."""
    near = cut(docs.select(key, F.explode(F.array_distinct(_near_stems(words(F.col("text")), stems))).alias("word")))
    return _having(near, stems).groupBy(key).agg(F.collect_set("stem").alias("found"))


def stemmed_gate(docs: DataFrame, questions: dict[str, str]) -> DataFrame:
    """relevance_gate on stems: one row for each question, from one pass over docs."""
    asked = {q: question_terms(t)[0] for q, t in questions.items()}
    hits = stems_found(docs, sorted({s for x in asked.values() for s in x}))
    table = docs.sparkSession.createDataFrame([(q, x) for q, x in asked.items()], "query string, stems array<string>")
    by_stem = docs.sparkSession.createDataFrame([(q, s) for q, x in asked.items() for s in x], "query string, stem string")
    per_doc = hits.select("doc_id", F.explode("found").alias("stem")).join(F.broadcast(by_stem), "stem").groupBy("query", "doc_id").agg(F.count("*").alias("n"))
    best = per_doc.groupBy("query").agg(F.max("n").alias("best"))
    there = hits.select(F.explode("found").alias("stem")).distinct().join(F.broadcast(by_stem), "stem").groupBy("query").agg(F.count("*").alias("present"))
    joined = table.join(best, "query", "left").join(there, "query", "left").na.fill(0, ["best", "present"])
    absent = F.when(F.size("stems") == 0, 1.0).otherwise(1 - F.col("present") / F.size("stems"))
    out = joined.withColumn("absent_share", absent).withColumn("best_coverage", F.when(F.col("present") > 0, F.col("best") / F.col("present")).otherwise(0.0))
    reason = F.when(F.size("stems") == 0, "no_terms").when(F.col("present") == 0, "none").when(F.col("absent_share") > MAX_ABSENT, "absent").when(F.col("best_coverage") < MIN_COVERAGE, "scattered").otherwise("")
    return out.select("query", F.round("absent_share", 6).alias("absent_share"), F.round("best_coverage", 6).alias("best_coverage"), (reason == "").alias("admitted"), reason.alias("reason"))


def subject_coverage(docs: DataFrame, question: str, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, coverage): the share of the question's stems, of those that known (stem) has, that a text has; documents with none are left out."""
    stems = question_terms(question)[0]
    if known is not None:
        stems = [r[0] for r in cut(known.select("stem").distinct()).where(F.col("stem").isin(stems)).collect()]  # no more than the question's
    if not stems:
        return docs.select("doc_id").limit(0).withColumn("coverage", F.lit(0.0))
    return stems_found(docs, stems).select("doc_id", (F.size("found") / F.lit(float(len(stems)))).alias("coverage"))


def stemmed_top_k(docs: DataFrame, question: str, k: int = 3) -> DataFrame:
    """The k documents that have most of the question's distinct stems; ties by the longer text, then doc_id."""
    found = stems_found(docs.select("doc_id", "text"), question_terms(question)[0])
    return docs.select("doc_id", "n_chars").join(found, "doc_id").select("doc_id", "n_chars", F.size("found").alias("score")).orderBy(F.desc("score"), F.desc("n_chars"), "doc_id").limit(k)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k rows of the largest score, ties by doc_id, with rank. The limit comes first, so one task ranks k rows only."""
    best = scored.orderBy(F.desc("score"), "doc_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def query_orphans(docs: DataFrame, query: list[str]) -> DataFrame:
    """(term): terms of the query that no document has."""
    asked = docs.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(query)], "term string")
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(query)])
    there = docs.select(F.explode(F.array_intersect(words(F.col("text")), wanted)).alias("term")).distinct()
    return asked.join(there, "term", "left_anti")


def coverage(docs: DataFrame, query: list[str]) -> DataFrame:
    """docs with coverage: the share of the query's terms, with multiplicity, that a document has."""
    asked = F.array(*[F.lit(t) for t in query])
    return docs.withColumn("coverage", F.size(F.filter(asked, lambda t: F.array_contains(words(F.col("text")), t))) / F.lit(float(len(query) or 1)))


def relevance_gate(docs: DataFrame, queries: dict[str, list[str]]) -> DataFrame:
    """(query, absent_share, best_coverage, admitted, reason): one row for each query, from one pass over docs.

    A query goes if over half of its terms occur nowhere, or the best document has under half of the usable ones.
    """
    asked = docs.sparkSession.createDataFrame([(q, t) for q, t in queries.items()], "query string, terms array<string>")
    pairs = docs.select("doc_id", F.array_distinct(words(F.col("text"))).alias("words")).join(F.broadcast(asked))  # a stated set of queries
    found = F.transform("terms", lambda t: F.array_contains("words", t).cast("int"))
    # one row for each query and partial aggregate: which terms occur at all, and the most that one document has
    n_terms = F.size("terms")
    hits = pairs.select("query", "terms", found.alias("hit"))
    most = max(len(t) for t in queries.values())
    seen = hits.groupBy("query", "terms").agg(*[F.max(F.get("hit", F.lit(i))).alias(f"t{i}") for i in range(most)], F.max(F.aggregate("hit", F.lit(0), lambda a, x: a + x)).alias("best"))
    present = sum((F.coalesce(F.col(f"t{i}"), F.lit(0)) for i in range(most)), F.lit(0))
    out = seen.select("query", (1 - present / n_terms).alias("absent_share"), F.when(present > 0, F.col("best") / present).otherwise(0.0).alias("best_coverage"))
    reason = F.when(F.col("absent_share") > MAX_ABSENT, "absent").when(F.col("best_coverage") < MIN_COVERAGE, "scattered").otherwise("")
    return out.withColumn("reason", reason).withColumn("admitted", reason == "").select("query", F.round("absent_share", 6).alias("absent_share"), F.round("best_coverage", 6).alias("best_coverage"), "admitted", "reason")


def select_relative(ranked: DataFrame, threshold: float = SELECTION) -> DataFrame:
    """ranked (rank, coverage, ...) with decision: the first always; others from threshold of the first's coverage on."""
    first = F.max(F.when(F.col("rank") == 1, F.greatest("coverage", F.lit(1e-9)))).over(Window.partitionBy())  # a top-k list
    return ranked.withColumn("decision", F.when(F.col("rank") == 1, "first").when(F.col("coverage") >= threshold * first, "covered").otherwise("weak"))


def class_floor(scored: DataFrame, k: int, in_class: Column, floor: int = STATE_FLOOR) -> DataFrame:
    """Top k with at least `floor` rows of a class: the worst others give way, and promoted rows come last. Adds rank, promoted.

    Only the k best and the `floor` best of the class leave the limits.
    """
    order = [F.desc("score"), F.col("doc_id")]
    marked = cut(scored.select("doc_id", "score", in_class.alias("state")))
    top = marked.orderBy(*order).limit(k)
    reserve = marked.where("state").orderBy(*order).limit(floor)
    extra = reserve.join(top.select("doc_id"), "doc_id", "left_anti")
    whole = Window.partitionBy()  # k + floor rows
    need = F.greatest(F.lit(floor) - F.sum(F.when(F.col("state") & ~F.col("new"), 1).otherwise(0)).over(whole), F.lit(0))
    rows = top.withColumn("new", F.lit(False)).unionByName(extra.withColumn("new", F.lit(True)))
    rows = rows.withColumn("need", need).withColumn("n_new", F.sum(F.col("new").cast("int")).over(whole))
    rows = rows.withColumn("moved", F.least("need", "n_new"))
    best_new = F.row_number().over(Window.partitionBy("new").orderBy(*order))
    worst_other = F.row_number().over(Window.partitionBy("new", "state").orderBy(F.asc("score"), F.desc("doc_id")))
    rows = rows.withColumn("best", best_new).withColumn("worst", worst_other)
    kept = rows.where(F.when(F.col("new"), F.col("best") <= F.col("moved")).otherwise(F.col("state") | (F.col("worst") > F.col("moved"))))
    return kept.withColumn("rank", F.row_number().over(Window.orderBy("new", *order))).select("doc_id", "score", "state", F.col("new").alias("promoted"), "rank")


def overlap_top_k(docs: DataFrame, query: list[str], k: int = 3) -> DataFrame:
    """The k documents that have most of the query's distinct terms; ties by the longer text, then doc_id."""
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(query)])
    score = F.size(F.array_intersect(words(F.col("text")), wanted))
    return docs.select("doc_id", "n_chars", score.alias("score")).where("score > 0").orderBy(F.desc("score"), F.desc("n_chars"), "doc_id").limit(k)


def best_lines(docs: DataFrame, query: list[str], k: int = 2) -> DataFrame:
    """(doc_id, line_no, hits, line): the k lines of each document with most distinct terms of the query, ties to the earlier; the first line if none has any.

    Lines are ranked inside their row, so nothing is shuffled.
    """
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(query)])
    lines = F.transform(F.split("text", "\n"), lambda l, i: F.struct((-F.size(F.array_intersect(F.regexp_extract_all(fold(l), F.lit("[a-z0-9]+"), F.lit(0)), wanted))).alias("minus"), i.alias("at"), l.alias("line")))
    hit = F.slice(F.array_sort(F.filter(lines, lambda x: x["minus"] < 0)), 1, k)
    chosen = F.when(F.size(hit) > 0, hit).otherwise(F.slice(lines, 1, 1))
    return docs.where("text IS NOT NULL").select("doc_id", F.explode(chosen).alias("x")).select("doc_id", F.col("x.at").alias("line_no"), (-F.col("x.minus")).alias("hits"), F.col("x.line").alias("line"))


def neighbour_fragments(docs: DataFrame, query: list[str]) -> DataFrame:
    """(doc_id, first_line, last_line): runs of lines that hit the query or stand next to one that does.

    Gaps and islands inside the row: a line begins a run if its forerunner is in none.
    """
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(query)])
    marked = docs.where("text IS NOT NULL").select("doc_id", F.transform(F.split("text", "\n"), lambda l: F.arrays_overlap(F.regexp_extract_all(fold(l), F.lit("[a-z0-9]+"), F.lit(0)), wanted)).alias("hit"))
    near = marked.where(F.exists("hit", lambda x: x)).select("doc_id", F.transform("hit", lambda x, i: x | F.coalesce(F.get("hit", i - 1), F.lit(False)) | F.coalesce(F.get("hit", i + 1), F.lit(False))).alias("near"))
    edge = lambda step: F.filter(F.transform("near", lambda x, i: F.when(x & ~F.coalesce(F.get("near", i + step), F.lit(False)), i)), lambda i: i.isNotNull())
    return near.select("doc_id", F.explode(F.arrays_zip(edge(-1).alias("first_line"), edge(1).alias("last_line"))).alias("run")).select("doc_id", "run.first_line", "run.last_line")
