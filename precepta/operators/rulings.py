"""Rulings and criteria: coverage by source, disagreement, selection by overlap and level, signals, failure causes, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from precepta.functions.text import fold

# Least share of a question's terms in a criterion's subject, and criteria kept for each question.
SUBJECT_SHARE, CRITERIA = 0.2, 3


def coverage_pivot(findings: DataFrame, sources: list[str]) -> DataFrame:
    """(class, one column of distinct documents for each source) of findings (doc_id, class, source); no class is GENERAL."""
    named = findings.select("doc_id", F.coalesce(F.nullif("class", F.lit("")), F.lit("GENERAL")).alias("class"), "source").distinct()
    return named.groupBy("class").pivot("source", sources).agg(F.count(F.lit(1))).na.fill(0, sources)


def multi_class(findings: DataFrame) -> DataFrame:
    """(documents, in_several): distinct documents, and those of two or more classes."""
    per = findings.groupBy("doc_id").agg(F.count_distinct("class").alias("n"))
    return per.agg(F.count("*").alias("documents"), F.count_if(F.col("n") > 1).alias("in_several"))


def disagreements(rulings: DataFrame) -> DataFrame:
    """(subject, rulings, years, first_year, last_year) of subjects with two or more rulings of two or more years."""
    per = rulings.groupBy("subject").agg(F.count("*").alias("rulings"), F.count_distinct("year").alias("years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return per.where("rulings > 1 AND years > 1")


def uncovered(rulings: DataFrame, verified: DataFrame) -> DataFrame:
    """The ruling_id none of whose subjects is among the verified ones (subject)."""
    touched = rulings.join(verified.select("subject").distinct(), "subject", "left_semi").select("ruling_id").distinct()
    return rulings.select("ruling_id").distinct().join(touched, "ruling_id", "left_anti")


def level(unit: Column, unifies: Column, qualification: Column) -> Column:
    """Legal level, the lower the stronger: 0 unifying criteria of the central unit, 1 its doctrine, 2 its others, 3 other units."""
    central = F.upper(F.regexp_replace(F.trim(unit), r"\s+", " ")) == "TEAC"
    return F.when(central & unifies, 0).when(central & F.lower(qualification).contains("doctrina"), 1).when(central, 2).otherwise(3)


def select_criteria(criteria: DataFrame, wanted: DataFrame, k: int = CRITERIA, least_share: float = SUBJECT_SHARE) -> DataFrame:
    """Per question, the k criteria on its subjects: (question, criterion_id, place, reason), rejected ones with their reason.

    criteria (criterion_id, subject, level, year, share), wanted (question, subject). Order: level, then the latest year.
    """
    hits = criteria.join(wanted.distinct(), "subject").groupBy("question", "criterion_id")
    hits = hits.agg(F.min(F.struct("level", (-F.col("year")).alias("before"), (-F.col("share")).alias("less"))).alias("best"))  # a repeated criterion at its best
    hits = hits.select("question", "criterion_id", "best.level", (-F.col("best.before")).alias("year"), (-F.col("best.less")).alias("share"))
    fit = F.col("share") >= least_share
    place = F.row_number().over(Window.partitionBy("question", fit).orderBy("level", F.desc("year"), "criterion_id"))
    ranked = hits.withColumn("place", F.when(fit, place))
    return ranked.select("question", "criterion_id", F.when(F.col("place") <= k, F.col("place")).alias("place"), F.when(~fit, "other_matter").when(F.col("place") > k, "beyond_limit").otherwise("").alias("reason"))


def doctrine_signals(criteria: DataFrame, cited: DataFrame, verified: DataFrame) -> DataFrame:
    """(criterion_id, signal): strong if it cites a cited ruling (ruling_id), weak if it is on a verified subject only."""
    strong = criteria.select("criterion_id", F.explode("cites").alias("ruling_id")).join(cited.distinct(), "ruling_id", "left_semi").select("criterion_id").distinct()
    weak = criteria.select("criterion_id", F.explode("subjects").alias("subject")).join(verified.distinct(), "subject", "left_semi").select("criterion_id").distinct().join(strong, "criterion_id", "left_anti")
    return strong.withColumn("signal", F.lit("strong")).union(weak.withColumn("signal", F.lit("weak")))


def cause(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The name of the first of rules (name, pattern) that a text matches; empty if none does."""
    out = F.lit("")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def pack(items: DataFrame, budgets: DataFrame) -> DataFrame:
    """items (question, item_id, kind, size) with sent and reason, under budgets (question, budget) of characters.

    Central items come first in order of item_id, those that don't fit are skipped; what is left is shared equally among
    rulings, what a short one leaves going to the later ones; then regional items. Each item's room depends on all before
    it, so a question's items are sorted in one partition and read as a stream: a task holds what is left, not the list.
    """
    kind = F.when(F.col("kind") == "central", 0).when(F.col("kind") == "ruling", 1).otherwise(2)
    rulings = items.groupBy("question").agg(F.count_if(F.col("kind") == "ruling").alias("rulings"))
    asked = budgets.groupBy("question").agg(F.max("budget").cast("long").alias("budget")).join(rulings, "question")
    rows = items.join(asked, "question").select("question", F.col("item_id").cast("long").alias("item_id"), "kind", F.col("size").cast("long").alias("size"), kind.alias("k"), "budget", "rulings")
    schema = StructType(rows.select("question", "item_id", "kind", "size").schema.fields).add("sent", "long").add("reason", "string")
    names = schema.fieldNames()

    def fill(batches):
        import pyarrow as pa

        question, left, more = None, 0, 0
        for batch in batches:
            sent, reasons = [], []
            for q, _, _, size, k, budget, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (q,) != question:
                    question, left, more = (q,), budget or 0, n
                size = size or 0
                room = min(size, left // max(more, 1)) if k == 1 else size if size <= left else 0
                more -= k == 1
                left -= room
                sent.append(room)
                reasons.append("" if room == size else "no_room" if room == 0 else "cut")
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sent, pa.int64()), pa.array(reasons, pa.string())], names)

    return rows.repartition("question").sortWithinPartitions("question", "k", "item_id", "kind", "size").mapInArrow(fill, schema)


# The central tribunal, and what labels and forces are called.
CENTRAL, DOCTRINE, NOT_BINDING = "TEAC", "doctrina", "no vinculante"
NO_LABEL, CENTRAL_LABEL, REGIONAL_LABEL = "Resolucion economico-administrativa", "Criterio TEAC", "Resolucion del "


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def is_central(unit: Column) -> Column:
    return F.upper(_plain(unit)) == CENTRAL


def tribunal_label(unit: Column) -> Column:
    """How a resolution is named after its unit: neutral without one, a criterion only of the central tribunal."""
    return F.when(_plain(unit) == "", NO_LABEL).when(is_central(unit), CENTRAL_LABEL).otherwise(F.concat(F.lit(REGIONAL_LABEL), _plain(unit)))


def binding_force(unit: Column, qualification: Column) -> Column:
    """What may be said of a resolution's force: binding, regional_doctrine, not_binding, unstated or unknown."""
    said = F.lower(_plain(qualification))
    return F.when(said.startswith(DOCTRINE), F.when(is_central(unit), "binding").otherwise("regional_doctrine")).when(said.startswith(NOT_BINDING), "not_binding").when(said == "", "unstated").otherwise("unknown")


def label_check(label: Column, unit: Column) -> Column:
    """Whether a citation's label names the tribunal: ok, no_unit where it can't be known, else what is wrong.

    not_central: the central tribunal's criterion isn't called so; too_strong: another's is; unnamed: the unit isn't named.
    """
    said, real = F.trim(F.regexp_replace(fold(F.coalesce(label, F.lit(""))), r"\s+", " ")), fold(_plain(unit))
    central = said.rlike(r"\b(criterio\s+teac|del\s+teac)\b|^teac\b")
    wrong = F.when(is_central(unit), F.when(central, "ok").otherwise("not_central")).when(central, "too_strong").when(F.contains(said, real), "ok").otherwise("unnamed")
    return F.when(real == "", "no_unit").otherwise(wrong)


def resolution_key(identifier: Column) -> Column:
    """The resolution that an identifier belongs to: its first five parts, the fifth as a number; shorter ones as they are, null if empty."""
    parts = F.filter(F.split(F.trim(F.coalesce(identifier, F.lit(""))), "/"), lambda x: x != "")
    fifth = F.coalesce(F.get(parts, F.lit(4)).try_cast("int").cast("string"), F.get(parts, F.lit(4)))
    key = F.when(F.size(parts) < 5, F.array_join(parts, "/")).otherwise(F.concat_ws("/", F.slice(parts, 1, 4), fifth))
    return F.nullif(key, F.lit(""))


def article_of(precept: Column) -> Column:
    """The article number, with its suffix, that a precept begins with; empty if it begins with none."""
    found = F.regexp_extract(F.coalesce(precept, F.lit("")), r"(?i)^\s*(\d+(?:\s+(?:bis|ter|quater|quinquies|sexies|septies|octies|nonies|decies)(?!\w))?)", 1)
    return F.lower(F.trim(F.regexp_replace(found, r"\s+", " ")))


def names_other_tax(concepts: Column, any_tax: str, own_tax: str) -> Column:
    """Whether concepts (an array) name taxes, but not the corpus's own; those that name none pass."""
    named = F.filter(F.coalesce(concepts, F.array().cast("array<string>")), lambda c: c.rlike(any_tax))
    return (F.size(named) > 0) & ~F.exists(named, lambda c: c.rlike(own_tax))


def answer_state(cases: DataFrame) -> DataFrame:
    """cases (results, accepted, verified, disagreements, ...) with state and reason.

    NOT_FOUND without results, without an accepted draft, or without a verified precept; else DISPUTED with any signal of
    disagreement, and CLEAR without. Gaps of coverage never change the state.
    """
    reason = F.when(F.coalesce("results", F.lit(0)) == 0, "no_results").when(~F.coalesce("accepted", F.lit(False)), "not_verified").when(F.coalesce("verified", F.lit(0)) == 0, "no_precept").otherwise("")
    state = F.when(reason != "", "NOT_FOUND").when(F.coalesce("disagreements", F.lit(0)) > 0, "DISPUTED").otherwise("CLEAR")
    return cases.select("*", state.alias("state"), reason.alias("reason"))
