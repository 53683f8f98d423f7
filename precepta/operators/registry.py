"""Norms and their names: aliases, longest-prefix resolution, subjects, roles, admission filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precepta.functions.text import acronym, comparison_key, fold


def parsed_name(title: Column) -> Column:
    """struct(kind, number, subject) of an official title such as 'Ley 37/1992, de 28 de diciembre, del Impuesto ...'."""
    return F.struct(
        F.trim(F.regexp_extract(title, r"^(\D+?)\s+\d+/\d{4}", 1)).alias("kind"),
        F.regexp_extract(title, r"(\d+/\d{4})", 1).alias("number"),
        F.trim(F.regexp_extract(title, r"^[^,]*,[^,]*,\s*(.*?)\.?$", 1)).alias("subject"),
    )


def is_tax_subject(subject: Column) -> Column:
    """Whether a subject, without leading articles and prepositions, begins with 'impuesto'."""
    return F.regexp_replace(fold(subject), r"^((por la que se |sobre|reguladora?|de|del|el|la|los|las)\s+)+", "").startswith("impuesto")


def aliases(bodies: DataFrame) -> DataFrame:
    """(body, alias) of bodies (body, kind, number, subject): kind and number, the acronym, prefixes of the subject of two words on."""
    words = F.split(comparison_key(F.col("subject")), " ")
    prefixes = F.when(F.size(words) >= 2, F.transform(F.sequence(F.lit(2), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).otherwise(F.array().cast("array<string>"))
    own = F.array(comparison_key(F.concat_ws(" ", "kind", "number")), fold(acronym(F.col("subject"))))
    return bodies.select("body", F.explode(F.array_distinct(F.filter(F.concat(own, prefixes), lambda a: F.length(a) > 1))).alias("alias"))


def resolve_names(names: DataFrame, alias: DataFrame) -> DataFrame:
    """(name_id, body, state) of names (name_id, name): the body whose alias is the longest prefix; several decline.

    Each name is split into its prefixes, up to the length of the longest alias, which join the aliases by equality.
    """
    most_words = alias.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    words = F.split(comparison_key(F.col("name")), " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(most_words))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(words, F.lit(1), n), " ").alias("alias")))
    hits = names.select("name_id", F.explode(prefixes).alias("p")).select("name_id", "p.n", "p.alias").join(alias, "alias")
    by_length = hits.groupBy("name_id", "n").agg(F.count_distinct("body").alias("bodies"), F.min("body").alias("body"))
    best = by_length.groupBy("name_id").agg(F.max_by("bodies", "n").alias("bodies"), F.max_by("body", "n").alias("body"))
    joined = names.select("name_id").join(best, "name_id", "left")
    return joined.select("name_id", F.when(F.col("bodies") == 1, F.col("body")).alias("body"), F.when(F.col("bodies") == 1, "resolved").when(F.col("bodies") > 1, "ambiguous").otherwise("external").alias("state"))


def body_tax(bodies: DataFrame) -> DataFrame:
    """bodies (document, position, tax) with tax filled from the first sibling body of the document that has one."""
    over = Window.partitionBy("document").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return bodies.withColumn("tax", F.coalesce("tax", F.first("tax", ignorenulls=True).over(over)))


def norm_roles(bodies: DataFrame) -> DataFrame:
    """(document, role): tax if any of its bodies has one, or none of the corpus has; else general."""
    own = bodies.groupBy("document").agg(F.bool_or(F.col("tax").isNotNull()).alias("has"))
    none = own.where("has").isEmpty()
    return own.select("document", F.when(F.col("has") | F.lit(none), "tax").otherwise("general").alias("role"))


def admitted(tax: Column, wanted: str | None, substance: bool, known: list[str]) -> Column:
    """Whether rows of a tax may answer: all without a tax or for an unknown one; general ones ('') not for questions of substance."""
    if not wanted or wanted not in known:
        return F.lit(True)
    return tax.isin([wanted] if substance else [wanted, ""])


def in_region(region: Column, wanted: str = "") -> Column:
    """State rows (no region) always, regional ones for their own region only."""
    own = F.coalesce(F.trim(region), F.lit(""))
    return (own == "") | (own == wanted) if wanted else own == ""


def corpus_taxes(bodies: DataFrame, precepts: DataFrame, general: str = "GENERAL") -> DataFrame:
    """(tax, precepts): precepts (tax) by their tax, where a body of bodies (tax) is dedicated to it; all others count as general."""
    own = bodies.where("tax IS NOT NULL").select("tax").distinct().withColumn("own", F.lit(True))
    joined = precepts.select("tax").join(own, "tax", "left")
    return joined.groupBy(F.when(F.col("own"), F.col("tax")).otherwise(general).alias("tax")).agg(F.count("*").alias("precepts"))


def covered_taxes(bodies: DataFrame) -> DataFrame:
    """(tax): the distinct taxes of bodies, in order."""
    return bodies.where("tax IS NOT NULL").select("tax").distinct().orderBy("tax")


def tax_gate(questions: DataFrame, bodies: DataFrame) -> DataFrame:
    """questions (tax, ...) with admitted and reason: 'unknown' without a tax, 'outside' where no body of the corpus has it."""
    own = covered_taxes(bodies).withColumn("inside", F.lit(True))
    joined = questions.join(own, "tax", "left")
    reason = F.when(F.coalesce("tax", F.lit("")) == "", "unknown").when(F.col("inside").isNull(), "outside").otherwise("")
    return joined.select(*questions.columns, (reason == "").alias("admitted"), reason.alias("reason"))


def norm_numbers(aliases: DataFrame) -> DataFrame:
    """(number): the distinct norm numbers such as 37/1992 in aliases (alias)."""
    return aliases.select(F.explode(F.regexp_extract_all("alias", F.lit(r"\b(\d{1,4}/\d{4})\b"), F.lit(1))).alias("number")).distinct()
