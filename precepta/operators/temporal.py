"""Versions in force: as-of selection, repair of effective dates, warnings for a year, strict date readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precepta.functions.text import years_in

# Years before this are taken for errors; an effective date so many years before publication is reported.
LEAST_YEAR, MOST_YEARS_BEFORE = 1900, 5
FIRST_YEAR, LATEST_YEAR = 1993, 2100
BLOCKING = ("no_existia", "caducado", "sin_fechas")
#: Days of a span that as-of joins deal a key's rows over.
SPAN_DAYS = 32


def compact_date(value: Column) -> Column:
    """yyyyMMdd as a date, null if it is none."""
    return F.when(value.rlike(r"^\d{8}$"), F.try_to_date(value, "yyyyMMdd"))


def slashed_date(value: Column) -> Column:
    """dd/MM/yyyy as a date, null if it is none."""
    return F.when(value.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(value, "dd/MM/yyyy"))


def number_year(number: Column, date: Column) -> Column:
    """Year of a ruling: the suffix of its number (two digits: 20yy under 80, else 19yy), else the year of its date."""
    suffix = F.regexp_extract(number, r"-(\d{2,4})$", 1)
    short = suffix.try_cast("int")
    return F.coalesce(F.when(F.length(suffix) == 2, short + F.when(short < 80, 2000).otherwise(1900)).when(F.length(suffix) == 4, short), F.year(date))


def repaired_date(effective: Column, published: Column) -> Column:
    """struct(date, reason): a missing effective date or one before LEAST_YEAR is the publication's; one far before it stays, with a reason."""
    far = effective < F.add_months(published, -12 * MOST_YEARS_BEFORE)
    return F.struct(
        F.when(effective.isNull() | (F.year(effective) < LEAST_YEAR), published).otherwise(effective).alias("date"),
        F.when(effective.isNull(), "missing").when(F.year(effective) < LEAST_YEAR, "impossible").when(far, "far_before").otherwise("").alias("reason"),
    )


def applicable(versions: Column, day: Column) -> Column:
    """Of an array of structs with `effective`, the last in list order that is in force on a day; null if none is."""
    return F.try_element_at(F.filter(versions, lambda v: v["effective"] <= day), F.lit(-1))


def as_of_join(facts: DataFrame, versions: DataFrame, key: str, day: str, effective: str, order: list[str], span_days: int = SPAN_DAYS) -> DataFrame:
    """facts with the columns of the version of the same key that is last in order among those effective by the fact's day.

    Versions and facts of a key and a span of days are sorted together and the last version is carried forward, so a key's
    facts never meet all its versions in pairs, and one key that has a large share of the rows is dealt over its spans.
    What a span begins with is carried over from the last versions of those before, a row for each key and span. Facts
    without such a version have nulls. Order must follow the effective dates; for lists that don't, use applicable().
    """
    carried = [c for c in versions.columns if c != key]
    version, ranks = F.struct(*carried), [F.col(effective), *map(F.col, order)]
    span = lambda c: F.floor(F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")) / span_days).alias("_span")
    of = versions.select(F.struct(version).alias("x")).schema[0].dataType[0].dataType
    left = facts.select(*[F.col(c) for c in facts.columns], span(day), F.col(day).alias("_at"), F.lit(1).alias("_fact"), F.lit(None).cast(of).alias("_version"), *[F.lit(None).cast(versions.schema[o].dataType).alias(f"_o{i}") for i, o in enumerate(order)])
    right = versions.select(*[(F.col(key) if c == key else F.lit(None).cast(facts.schema[c].dataType).alias(c)) for c in facts.columns], span(effective), F.col(effective).alias("_at"), F.lit(0).alias("_fact"), version.alias("_version"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    ends = versions.groupBy(F.col(key).alias("_key"), span(effective)).agg(F.max_by(version, F.struct(*ranks)).alias("_end"))
    spans = ends.unionByName(left.select(F.col(key).alias("_key"), "_span").distinct().withColumn("_end", F.lit(None).cast(of))).groupBy("_key", "_span").agg(F.first("_end", ignorenulls=True).alias("_end"))
    earlier = Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    before = spans.select("_key", F.col("_span").alias("_of"), F.last("_end", ignorenulls=True).over(earlier).alias("_before")).where("_before IS NOT NULL")
    over = Window.partitionBy(key, "_span").orderBy("_at", "_fact", *[f"_o{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_last", F.last("_version", ignorenulls=True).over(over)).where("_fact = 1")
    joined = both.join(before, (F.col(key) == F.col("_key")) & (F.col("_span") == F.col("_of")), "left").withColumn("_last", F.coalesce("_last", "_before"))
    return joined.select(*facts.columns, *[F.col(f"_last.{c}").alias(f"version_{c}") for c in carried])


def date_warnings(rows: DataFrame, year: int) -> DataFrame:
    """rows (versions array<struct<n, effective date>>, expired date) with warnings, an array of keys, for a year.

    sin_fechas and no_existia end the list; caducado or caduca_durante; texto_cambiado where the last version isn't the
    one in force at the year's end; cambio_durante; cambio_posterior if the text is the same. Before these, where rows have
    the columns: consolidacion_incompleta if consolidated (date) is before the year's end, modificado_sin_incorporar if
    blocked_by (the norm that changes it) isn't empty.
    """
    start, end = F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year), F.lit(12), F.lit(31))
    dates = F.filter(F.transform("versions", lambda v: v["effective"]), lambda d: d.isNotNull())
    expired = F.when(F.col("expired") <= start, "caducado").when(F.col("expired") <= end, "caduca_durante")
    now = applicable(F.col("versions"), end)
    changed = now["n"] != F.element_at("versions", -1)["n"]
    during = F.exists(dates, lambda d: (d > start) & (d <= end))
    later = F.exists(dates, lambda d: d > end) & ~F.coalesce(changed, F.lit(False))
    full = F.array_compact(F.array(expired, F.when(changed, "texto_cambiado"), F.when(during, "cambio_durante"), F.when(later, "cambio_posterior")))
    none = F.array().cast("array<string>")
    behind = F.when(F.col("consolidated") < end, F.array(F.lit("consolidacion_incompleta"))) if "consolidated" in rows.columns else none
    changing = F.when(F.coalesce("blocked_by", F.lit("")) != "", F.array(F.lit("modificado_sin_incorporar"))) if "blocked_by" in rows.columns else none
    keys = F.when(F.size(dates) == 0, F.array(F.lit("sin_fechas"))).when(F.array_min(dates) > end, F.array(F.lit("no_existia"))).otherwise(full)
    keys = F.concat(F.coalesce(behind, none), F.coalesce(changing, none), keys)
    return rows.withColumn("warnings", keys).withColumn("blocked", F.arrays_overlap(keys, F.array(*[F.lit(b) for b in BLOCKING])))


def read_year(raw: Column, low: int = FIRST_YEAR, high: int = LATEST_YEAR) -> Column:
    """struct(year, reason) of a year as people write it: four digits, or null with why not (missing, empty, two_years, not_a_year, not_four_digits, outside)."""
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    reason = (
        F.when(raw.isNull(), "missing").when(text == "", "empty").when(text.rlike(r"^\d{4}\s*[-/aA]\s*\d{4}$"), "two_years").when(~text.rlike(r"^\d+$"), "not_a_year").when(F.length(text) != 4, "not_four_digits")
        .when(~text.try_cast("int").between(low, high), "outside").otherwise("")
    )
    return F.struct(F.when(reason == "", text.try_cast("int")).alias("year"), reason.alias("reason"))


def resolve_year(question: Column, guessed: Column, given: Column) -> Column:
    """struct(year, reason) of a case: the given one if there is one, else the guessed one if the question has it written (guessed otherwise)."""
    by_hand = read_year(given)
    written = F.array_contains(years_in(question, FIRST_YEAR, LATEST_YEAR), guessed.cast("int"))
    own = F.when(guessed.isNull(), F.struct(F.lit(None).cast("int").alias("year"), F.lit("missing").alias("reason"))).when(written, F.struct(guessed.cast("int").alias("year"), F.lit("").alias("reason")))
    return F.when(given.isNotNull(), by_hand).otherwise(F.coalesce(own, F.struct(F.lit(None).cast("int").alias("year"), F.lit("not_written").alias("reason"))))
