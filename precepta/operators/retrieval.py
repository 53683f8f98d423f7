"""Whole retrieval for several questions: candidates filtered before ranks are dealt, what they refer to, and what of it is sent."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precepta.operators.search import EXACT_WEIGHT, K1, LENGTH_NORM, SELECTION, STATE_FLOOR, WEIGHTS, _by_field, field_stats, fields
from precepta.sources.readers import cut

# What a question is about, and the candidates that a question gets.
SUBSTANCE, PROCEDURE, CANDIDATES = "substance", "procedure", 5


def scored_candidates(docs: DataFrame, questions: dict[str, list[str]], exact: bool = False) -> DataFrame:
    """(question, node, score, n_terms, useful) of all documents with a term of a question: BM25F over docs (doc_id, text, lang, source).

    useful counts the question's terms that any document has. One scan for all questions: only postings of their terms
    and the means of lengths leave it; the questions' terms are joined by the term.
    """
    asked = docs.sparkSession.createDataFrame([(q, t) for q, terms in questions.items() for t in dict.fromkeys(terms)], "question string, term string")
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(t for terms in questions.values() for t in terms)]).cast("array<string>")
    fielded = fields(docs)
    hits = fielded.withColumn("length", F.size("tokens")).select("doc_id", "field", "length", F.explode(F.filter("tokens", lambda t: F.array_contains(wanted, t))).alias("term"))
    hits = cut(hits.groupBy("term", "doc_id", "field", "length").agg(F.count("*").alias("tf")))
    norm = 1 - _by_field(LENGTH_NORM) + _by_field(LENGTH_NORM) * F.col("length") / F.col("mean_length")
    weighted = hits.join(F.broadcast(field_stats(fielded)), "field").groupBy("term", "doc_id").agg(F.sum(_by_field(WEIGHTS) * F.col("tf") / norm).alias("wtf"), F.first("n_docs").alias("n"))
    df = hits.groupBy("term").agg(F.count_distinct("doc_id").alias("df"))
    useful = asked.join(df, "term").groupBy("question").agg(F.count("*").alias("useful"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.lit(EXACT_WEIGHT if exact else 1.0) * idf * F.col("wtf") / (K1 + F.col("wtf"))
    each = weighted.join(df, "term").join(asked, "term").groupBy("question", "doc_id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("n_terms"))
    return each.join(useful, "question").select("question", F.col("doc_id").alias("node"), "score", "n_terms", "useful")


def _said(value: str) -> Column:
    return F.coalesce(F.trim(value), F.lit(""))


def _asked(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """questions with `known`: whether the corpus has their tax."""
    taxes = nodes.select(_said("tax").alias("wanted")).where("wanted != ''").distinct().withColumn("known", F.lit(True))
    named = questions.select("question", _said("tax").alias("wanted"), _said("region").alias("home"), _said("nature").alias("nature"))
    return named.join(taxes, "wanted", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def _in_place() -> Column:
    return (_said("region") == "") | (_said("region") == F.col("home"))


def _admitted() -> Column:
    """The question's own tax, and general nodes unless the question is one of substance; all for a tax that isn't known."""
    tax = _said("tax")
    return ~F.col("known") | (tax == F.col("wanted")) | ((tax == "") & (F.col("nature") != SUBSTANCE))


def retrieve(scored: DataFrame, nodes: DataFrame, edges: DataFrame, questions: DataFrame, k: int = CANDIDATES, floor: int = STATE_FLOOR) -> DataFrame:
    """(question, node, rank, score, promoted, reserve): the candidates of each question, then its reserve.

    scored has question, node, score; nodes has node, tax and region (null or empty: general, of the state); questions has
    question, tax, region and nature (SUBSTANCE, PROCEDURE or none); edges has origin and target, resolved ones.

    Where the corpus knows the tax, nodes of other taxes and regions go before ranks are dealt, and general ones too if the
    question is one of substance. Of the k best, the worst regional ones give way to state nodes from behind if there are
    fewer than `floor` of these. Where it doesn't know it, nothing is told apart but regions, and those behind the ranks.
    The reserve are nodes that candidates refer to and that couldn't compete for their tax; other regions' stay out.

    Limits are applied in each task before its rows are shuffled, so a question's ranking sees k rows of each task. Nodes
    without a row in nodes are general. Ties are broken by the node; an unknown question has no row.
    """
    asked = _asked(questions, nodes)
    known_nodes = nodes.select("node", "tax", "region").dropDuplicates(["node"])
    order = [F.desc("score"), F.col("node")]
    rows = scored.select("question", "node", "score").join(asked, "question").join(known_nodes, "node", "left")
    fit = cut(rows.where(~F.col("known") | (_in_place() & _admitted())).select("question", "node", "score", "known", _in_place().alias("here"), (_said("region") == "").alias("state")))
    best = lambda df, n: df.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy(*order))).where(F.col("place") <= n)
    top = best(fit, k)
    behind = best(fit.where("known AND state"), floor).join(top.select("question", "node"), ["question", "node"], "left_anti")
    whole = Window.partitionBy("question")  # at most k + floor rows of a question
    both = top.withColumn("promoted", F.lit(False)).unionByName(behind.withColumn("promoted", F.lit(True)))
    missing = F.greatest(F.lit(floor) - F.sum((F.col("state") & ~F.col("promoted")).cast("int")).over(whole), F.lit(0))
    both = both.withColumn("missing", F.when(F.col("known"), missing).otherwise(0)).withColumn("offered", F.sum(F.col("promoted").cast("int")).over(whole))
    both = both.withColumn("moved", F.least("missing", "offered"))
    first = F.row_number().over(Window.partitionBy("question", "promoted").orderBy(*order))
    worst = F.row_number().over(Window.partitionBy("question", "promoted", "state").orderBy(F.asc("score"), F.desc("node")))
    both = both.withColumn("first", first).withColumn("worst", worst)
    kept = both.where(F.when(F.col("promoted"), F.col("first") <= F.col("moved")).otherwise(F.col("state") | (F.col("worst") > F.col("moved"))) & F.col("here"))
    inside = cut(kept.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy("promoted", *order))).select("question", "node", "rank", "score", "promoted"))
    called = inside.join(edges.select(F.col("origin").alias("node"), "target"), "node").groupBy("question", "target").agg(F.min("rank").alias("caller"))
    called = called.withColumnRenamed("target", "node").join(asked.where("known"), "question").join(known_nodes, "node").where(_in_place() & ~_admitted())
    last = inside.groupBy("question").agg(F.count("*").alias("last"))
    at = F.row_number().over(Window.partitionBy("question").orderBy("caller", "node")) + F.col("last")
    reserve = called.join(last, "question").select("question", "node", at.cast("int").alias("rank"), F.lit(0.0).alias("score"), F.lit(False).alias("promoted"), F.lit(True).alias("reserve"))
    return inside.withColumn("reserve", F.lit(False)).unionByName(reserve)


def select_material(candidates: DataFrame, scored: DataFrame, nodes: DataFrame, edges: DataFrame, questions: DataFrame, threshold: float = SELECTION) -> DataFrame:
    """(question, node, rank, relative, sent, decision, round, caller): what of a question's candidates is sent, and why.

    candidates is as retrieve gives it, scored as scored_candidates does. The best one is sent ('first'), and others whose
    coverage of the question is `threshold` of its ('covered'), but neither the reserve ('other_tax') nor general nodes in a
    question that isn't theirs ('support'), nor those below ('weak'). Then each that a sent one refers to is sent as well
    ('referred'), until no new one is: round counts the steps, caller is the earliest sent that refers to it.

    A question is the general nodes' own if it is of PROCEDURE; without a nature, if its best candidate is one. Edges are
    joined to both ends of candidates once; each round joins what the last one sent, and only that is written.
    """
    asked = questions.select("question", _said("nature").alias("nature"))
    general = nodes.select("node", (_said("tax") == "").alias("general")).dropDuplicates(["node"])
    rows = candidates.select("question", "node", "rank", "reserve").join(scored.select("question", "node", (F.col("n_terms") / F.col("useful")).alias("coverage")), ["question", "node"], "left")
    rows = rows.join(asked, "question").join(general, "node", "left").na.fill({"coverage": 0.0, "general": True})
    best = rows.where("rank = 1").select("question", F.greatest("coverage", F.lit(1e-9)).alias("most"), (F.when(F.col("nature") == PROCEDURE, True).when(F.col("nature") == SUBSTANCE, False).otherwise(F.col("general"))).alias("theirs"))
    rows = rows.join(best, "question").withColumn("relative", F.round(F.col("coverage") / F.col("most"), 6))
    decision = F.when(F.col("reserve"), "other_tax").when(F.col("rank") == 1, "first").when(F.col("general") & ~F.col("theirs"), "support").when(F.col("coverage") / F.col("most") >= threshold, "covered").otherwise("weak")
    rows = cut(rows.select("question", "node", "rank", "relative", decision.alias("decision")))
    ends = rows.select("question", "node")
    calls = cut(rows.select("question", F.col("node").alias("origin"), "rank").join(edges.select("origin", "target").distinct(), "origin").join(ends.withColumnRenamed("node", "target"), ["question", "target"]))
    rounds = [cut(rows.where("decision IN ('first', 'covered')").select("question", "node", F.lit(0).alias("round"), F.lit(None).cast("long").alias("caller")))]
    for n in count(1):
        sent = rounds[0]
        for more in rounds[1:]:
            sent = sent.union(more)
        reached = rounds[-1].select("question", F.col("node").alias("origin")).join(calls, ["question", "origin"]).groupBy("question", F.col("target").alias("node")).agg(F.min_by("origin", "rank").alias("caller"))
        new = cut(reached.join(sent.select("question", "node"), ["question", "node"], "left_anti").select("question", "node", F.lit(n).alias("round"), F.col("caller").cast("long").alias("caller")))
        if new.isEmpty():
            break
        rounds.append(new)
    joined = rows.join(sent, ["question", "node"], "left")
    return joined.select("question", "node", "rank", "relative", F.col("round").isNotNull().alias("sent"), F.when(F.col("round") > 0, "referred").otherwise(F.col("decision")).alias("decision"), "round", "caller")
