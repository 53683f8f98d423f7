"""Quality audits, seals, catalogues, snapshot differences, plans and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def audit(rows: DataFrame, controls: dict[str, Column]) -> DataFrame:
    """(control, failures, total): how many rows each control finds, in one pass."""
    counts = rows.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in controls.items()])
    return counts.select("total", F.explode(F.array(*[F.struct(F.lit(n).alias("control"), F.col(n).alias("failures")) for n in controls])).alias("c")).select("c.control", "c.failures", "total")


def gate(rows: DataFrame, unrecognised: Column, most: float = 0.05, forced: bool = False) -> DataFrame:
    """rows, if the share that isn't recognised is within bounds and below the recognised rows; else an error, unless forced."""
    total, bad = rows.agg(F.count("*"), F.count_if(unrecognised)).first()
    if total and not forced and (bad > most * total or bad > total - bad):
        raise ValueError(f"{bad} of {total} rows are not recognised")
    return rows


def seal(rows: DataFrame, group: str, key: str, content: Column) -> DataFrame:
    """(group, rows, bytes, checksum) of each group: the checksum is that of its rows' checksums, whatever their order.

    A row's SHA-256 is summed by parts, so nothing but four numbers a group is shuffled.
    """
    own = rows.select(group, F.octet_length(content).alias("bytes"), F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), content), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return own.groupBy(group).agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"), F.concat_ws("-", *parts).alias("checksum"))


def check_seals(now: DataFrame, sealed: DataFrame, group: str) -> DataFrame:
    """(group, problem, delta): missing seals, groups gone, row deltas and changed contents; groups that match are left out."""
    a, b = now.alias("a"), sealed.alias("b")
    joined = a.join(b, F.col(f"a.{group}") == F.col(f"b.{group}"), "full_outer")
    problem = F.when(F.col(f"b.{group}").isNull(), "unsealed").when(F.col(f"a.{group}").isNull(), "unreadable").when(F.col("a.rows") != F.col("b.rows"), "rows").when(F.col("a.checksum") != F.col("b.checksum"), "content")
    return joined.select(F.coalesce(f"a.{group}", f"b.{group}").alias(group), problem.alias("problem"), (F.coalesce("a.rows", F.lit(0)) - F.coalesce("b.rows", F.lit(0))).alias("delta")).where("problem IS NOT NULL")


def upsert(table: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """table with the rows of new in place of those of the same keys."""
    return table.join(new, list(keys), "left_anti").unionByName(new)


def merge_catalogue(published: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """All keys of both, never fewer; local values win. Adds origin."""
    a, b = local.alias("a"), published.alias("b")
    values = [c for c in published.columns if c != key]
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    origin = F.when(F.col(f"a.{key}").isNull(), "published").when(F.col(f"b.{key}").isNull(), "local").otherwise("both")
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in values], origin.alias("origin"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, verdict: str) -> DataFrame:
    """(key, before, after, change): new, vanished, regression (green to red), fixed, changed; equal rows are left out."""
    a, b = before.alias("a"), after.alias("b")
    old, new = F.col(f"a.{verdict}"), F.col(f"b.{verdict}")
    change = F.when(old.isNull(), "new").when(new.isNull(), "vanished").when((old == "green") & (new == "red"), "regression").when((old == "red") & (new == "green"), "fixed").when(old != new, "changed")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), old.alias("before"), new.alias("after"), change.alias("change")).where("change IS NOT NULL")


def metric_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta) of two tables (metric, value), those that differ."""
    joined = before.toDF("metric", "before").join(after.toDF("metric", "after"), "metric", "full_outer")
    return joined.withColumn("delta", F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).where("delta != 0")


def round_robin(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """rows with turn, their place in their group, and the group's size: ordering by turn, then size, deals the groups in turn."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).withColumn("group_size", F.count("*").over(Window.partitionBy(group)))


def seeding_scores(hits: DataFrame, edges: DataFrame, weight: int = 12, least: int = 2) -> DataFrame:
    """(key, score): weight times the questions that send a key, and its incoming references; without questions, least references at least."""
    asked, incoming = hits.groupBy("key").agg(F.count("*").alias("asked")), edges.groupBy(F.col("target").alias("key")).agg(F.count("*").alias("incoming"))
    both = asked.join(incoming, "key", "full_outer").na.fill(0)
    return both.where(f"asked > 0 OR incoming >= {least}").select("key", (weight * F.col("asked") + F.col("incoming")).alias("score"))


def usage_rollup(calls: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Sums by all prefixes of `by`, the total included; level is the number of columns that are summed over."""
    return calls.rollup(*by).agg(*[F.sum(m).alias(m) for m in measures], F.count("*").alias("calls"), F.grouping_id().alias("gid"))


def cost(usage: DataFrame, rates: dict[str, float]) -> DataFrame:
    """usage with cost: units times the rate of each kind."""
    return usage.withColumn("cost", sum((F.coalesce(F.col(k), F.lit(0)) * F.lit(r) for k, r in rates.items()), F.lit(0.0)))


def oldest(rows: DataFrame, key: str, date: str, today: Column) -> DataFrame:
    """(oldest, key, days, undated): the oldest date with its key, its age, and the rows without one."""
    return rows.agg(F.min(date).alias("oldest"), F.min_by(key, date).alias(key), F.count_if(F.col(date).isNull()).alias("undated")).withColumn("days", F.datediff(today, "oldest"))


def seal_state(groups: DataFrame, problems: DataFrame, group: str) -> DataFrame:
    """(state, groups, broken, unsealed, oldest, forced) in one row, of groups (group, sealed date, forced) and the problems of check_seals.

    state: unsealed if nothing is, mismatch with any problem but a missing seal, else match. forced lists groups sealed by force.
    """
    joined = groups.join(problems.select(group, "problem"), group, "left")
    broken = F.count_if(F.col("problem").isNotNull() & (F.col("problem") != "unsealed"))
    one = joined.agg(F.count("*").alias("groups"), broken.alias("broken"), F.count_if(F.col("sealed").isNull()).alias("unsealed"), F.min("sealed").alias("oldest"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("forced"), F.col(group).cast("string")))), ",").alias("forced"))
    state = F.when(F.col("unsealed") == F.col("groups"), "unsealed").when(F.col("broken") > 0, "mismatch").otherwise("match")
    return one.select(state.alias("state"), "*")


def label_histogram(rows: DataFrame, label: str) -> DataFrame:
    """(label, n): rows by label, the most common first."""
    return rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def consolidation_lag(norms: DataFrame, today: Column) -> DataFrame:
    """(behind, current, unknown, worst_days) in one row, of norms (consolidated, last_reform): reforms that the text doesn't have yet."""
    known = F.col("consolidated").isNotNull() & F.col("last_reform").isNotNull()
    behind = known & (F.col("last_reform") > F.col("consolidated"))
    return norms.agg(F.count_if(behind).alias("behind"), F.count_if(known & ~behind).alias("current"), F.count_if(~known).alias("unknown"), F.max(F.when(behind, F.datediff(today, "last_reform"))).alias("worst_days"))


def unanswered(asked: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """(key, times): keys of asked that covered lacks, the most asked first."""
    return asked.groupBy(key).agg(F.count("*").alias("times")).join(covered.select(key).distinct(), key, "left_anti").orderBy(F.desc("times"), key)


# What a call's usage is called by its source.
USAGE = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_input_tokens", "cache_written": "cache_creation_input_tokens"}


def usage_fields(usage: Column) -> list[Column]:
    """The four counts of a call's usage, a JSON object; what is missing or null counts as 0, and cached tokens are no input."""
    return [F.coalesce(F.get_json_object(usage, f"$.{name}").try_cast("long"), F.lit(0)).alias(k) for k, name in USAGE.items()]


def version_label(commit: Column, unsaved: Column) -> Column:
    """'3c3c7f4 (+2 unsaved)', or unknown without a commit."""
    return F.when(F.coalesce(commit, F.lit("")).isin("", "unknown"), "unknown").otherwise(F.concat(commit, F.when(unsaved > 0, F.concat(F.lit(" (+"), unsaved.cast("string"), F.lit(" unsaved)"))).otherwise("")))
