"""Evaluation: golden ranks, stability, reformulations within sessions, funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds between questions of a session, likeness of a reformulation and of a repetition.
GAP_SECONDS, REFORMULATED, REPEATED = 900, 0.35, 0.98


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two arrays as sets, 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def golden_ranks(ranked: DataFrame, golden: DataFrame) -> DataFrame:
    """(question, rank, passed) of ranked (question, doc_id, rank) against golden (question, doc_id, limit): the first acceptable one."""
    best = golden.join(ranked, ["question", "doc_id"], "left").groupBy("question").agg(F.min("rank").alias("rank"), F.max("limit").alias("limit"))
    return best.select("question", "rank", F.coalesce(F.col("rank") <= F.col("limit"), F.lit(False)).alias("passed"))


def stability(runs: DataFrame) -> DataFrame:
    """(question, stable) of runs (question, run, state, keys): one state and one set of keys over all runs."""
    return runs.groupBy("question").agg(((F.count_distinct("state") == 1) & (F.count_distinct(F.array_sort("keys")) == 1)).alias("stable"))


def followed(rows: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """rows with the columns of the row before (prefixed before_) of the same key."""
    over = Window.partitionBy(by).orderBy(order)
    return rows.select("*", *[F.lag(c).over(over).alias(f"before_{c}") for c in columns])


def reformulations(asked: DataFrame, by: str, order: str) -> DataFrame:
    """(by, order, likeness, reformulated) of asked (by, order, words) against the question before; repetitions are left out."""
    pairs = followed(asked, by, order, ["words"]).where("before_words IS NOT NULL").withColumn("likeness", jaccard(F.col("words"), F.col("before_words")))
    kept = pairs.where(~((F.col("likeness") > REPEATED) & (F.size("words") == F.size("before_words"))))
    return kept.select(by, order, F.round("likeness", 6).alias("likeness"), (F.col("likeness") >= REFORMULATED).alias("reformulated"))


def gap_sessions(events: DataFrame, by: str, ts: str, gap: int = GAP_SECONDS) -> DataFrame:
    """events with session, numbered from 1 on for each key: a new one begins after more than gap seconds."""
    over = Window.partitionBy(by).orderBy(ts, *[c for c in events.columns if c not in (by, ts)][:1])
    before = F.lag(ts).over(over)
    begins = F.when(before.isNull() | (F.col(ts) - before > F.make_dt_interval(secs=F.lit(gap))), 1).otherwise(0)
    return events.withColumn("_begins", begins).withColumn("session", F.sum("_begins").over(over.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")


def retry_funnel(attempts: DataFrame) -> DataFrame:
    """(cohort, first_rejected, second_passed) of attempts (trace, cohort, n, passed)."""
    per = attempts.groupBy("trace", "cohort").agg(F.bool_or((F.col("n") == 1) & ~F.col("passed")).alias("first"), F.bool_or((F.col("n") == 2) & F.col("passed")).alias("second"))
    return per.groupBy("cohort").agg(F.count_if("first").alias("first_rejected"), F.count_if(F.col("first") & F.col("second")).alias("second_passed"))


def step_sums(calls: DataFrame, by: str, step: str, part: str, values: list[str]) -> DataFrame:
    """(by, values...): sums of values over the calls whose step contains part, 0 where there are none."""
    inside = F.contains(F.col(step), F.lit(part))
    return calls.groupBy(by).agg(*[F.sum(F.when(inside, F.col(v)).otherwise(0)).alias(v) for v in values])


def means_by(sums: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by..., n, values...): the mean of each value."""
    return sums.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(v), 6).alias(v) for v in values])


# Verdicts of citations, the worst first, and of whole texts.
WORST_FIRST, OF_TEXTS, NO_CITATIONS = ["REJECTED", "UNVERIFIABLE", "VERIFIED"], ["ACCEPTED", "REFUSED"], "NO_CITATIONS"


def battery(cases: DataFrame, judged: DataFrame) -> DataFrame:
    """cases (case_id, expected) with obtained and ok, of the verdicts of their citations judged (case_id, verdict).

    Where a text's verdict is expected, all citations must be verified and there must be one; else the worst verdict counts.
    """
    per = judged.groupBy("case_id").agg(F.min(F.array_position(F.array(*map(F.lit, WORST_FIRST)), F.col("verdict"))).cast("int").alias("worst"))
    joined = cases.join(per, "case_id", "left")
    whole = F.when(F.col("worst") == len(WORST_FIRST), OF_TEXTS[0]).otherwise(OF_TEXTS[1])
    worst = F.coalesce(F.get(F.array(*map(F.lit, WORST_FIRST)), F.col("worst") - 1), F.lit(NO_CITATIONS))
    obtained = F.when(F.col("expected").isin(OF_TEXTS), whole).otherwise(worst)
    return joined.select("case_id", "expected", obtained.alias("obtained"), (obtained == F.col("expected")).alias("ok"))
