"""Free-text norm fields of rulings: the articles they name, each with its norm, what stays unread, and why a field names none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precepta.functions.text import expand_abbreviations
from precepta.operators.graph import MOST_SPAN, NUMBER_WORDS, SUFFIX
from precepta.operators.registry import resolve_names
from precepta.sources.readers import cut

# How fields mark articles, norms and lists.
MARK = r"(?:\bart[íi]culos?\b\.?|\barts?\b\.?)"
NORM = r"(?:\b(?:Ley\s+Org[aá]nica|Ley|Real\s+Decreto(?:\s+Legislativo|-ley)?|RD\s*-?\s*Leg\.?|RDL(?![a-z])|RD|Reglamento|Decreto|Orden|Directiva)\s+\d+/\d{2,4})"
LOOKS_LIKE_NORM = r"(?iU)\b(?:ley|real\s+decreto|rd|reglamento|decreto|orden|directiva|l[a-z]{2,5}|r[a-z]{2,5})\b"
DOUBLED_MARK = r"(?iU)\b(arts?\.?)\s*[:.]?\s+(?:arts?)\b\.?\s*-?\s*"
DASHED_MARK = r"(?iU)\b(arts?\.)\s+-\s+(?=\d)"
DASH_SUFFIX = r"(?:\s+(?:bis|ter|qu[aá]ter|quinquies|sexies|septies|octies|nonies|decies))?"
DASH_ITEM = r"\s+-\s+(\d+" + DASH_SUFFIX + r")(?=[\s.,;)ºª-]|$)"
BETWEEN = r"(?:de\s+(?:la|el|los|las)|del|de)\s+"
#: Sections stuck to a number. They take the blanks behind them, so that "44-4 y 54" ends at 44.
STUCK = r"(?:[ \t]*+[-.][ \t]*+(?:[a-záéíóúñ]++|\d++)[ \t]*+[ºª]?+)*+"
TIED = (
    r"(?:\s*[ºª]|\s*\.\s*(?:\d+|[ºª]|(?:" + NUMBER_WORDS + r")\b)|\s*,?\s*apartad[oa]s?\s+[\wªº]+(?:\s+y\s+[\wªº]+)?|"
    r"\s*,?\s*n[uú]meros?\s+[\d.ºª]+|\s*,?\s*letras?\s+[a-z]['’]?\)|\s*,?\s*p[aá]rrafos?\s+\w+)*+"
)
LISTED = r"(\d++(?:\s+" + SUFFIX + ")?+)" + STUCK + TIED + r"(\s*,?\s+a\s+(?=\d))?"
COMMA = r"(?:\s*,\s*(?:y|e|o|u)\s+|\s*,\s*|\s+(?:y|e|o|u)\s+)(?=\s*\d)"
LIST = r"\s*" + LISTED.replace("(\\d++", "(?:\\d++", 1).replace("(\\s*,?\\s+a", "(?:\\s*,?\\s+a", 1)

# Causes by which a field names no article of the corpus, in order, each with its sign.
NO_MARK, ABBREVIATION, FOREIGN, NO_ARTICLES = "formato nuevo sin marca de articulo", "abreviatura RD / RDLeg no reconocida", "solo cita normas que no tenemos", "la fuente no cita ningun articulo"
NO_MARK_SIGN = r"\b(?:Ley|Real\s+Decreto)\s+\d+/\d{4}[^\n]{0,90}?\s-\s\d"
ABBREVIATION_SIGN = r"\bRD\s*-?\s*Leg\.?\s*\d|\bRDLeg\.?\s*\d|\bRD\.?\s+\d+/\d"
LATER_SIGNS = (
    ("errata de la fuente", r"37/1192|27/20014|R\.eal|art\.\s*art\b|Ley 39/1987"),
    ("sigla + numero, sin la palabra Ley", r"\b(?:LIRPF|LIVA|LIS|LGT|LIP|RIRPF|RIVA|RIS)[.,]?\s+\d+/\d{4}"),
    ("dos puntos tras la marca de articulo", r"(?i)\bArt[íi]culos?\s*:|\barts?\.?\s*:"),
    ("la norma va entre parentesis detras de su nombre", r"\((?:Ley|Real\s+Decreto)\s+\d+/\d{4}"),
    ("norma ajena mezclada con una nuestra", r"Directiva|Reglamento\s*\(|Regl\.|Convenio|Constituci[oó]n|Ley 1/2000|Ley 40/2015|Ley 39/2015|Ley 49/2002|Ley 10/2012|Ley 38/1992"),
    ("punto y coma dentro de la lista de articulos", r"\d\s*;\s*\d"),
    ("el apartado con punto corta la lista de articulos", r"\b\d+\.\d"),
)
SOME_ARTICLE = r"(?i)\bart[íi]culos?\b\.?\s*:?\s*\d|\barts?\b\.?\s*:?\s*\d"


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ ,.;:]+|[ ,.;:]+$", "")


def field_pieces(fields: DataFrame) -> DataFrame:
    """(ruling, place, piece) of fields (ruling, text): parts between line breaks and semicolons, in order, without blank ones.

    A part that goes on to a further norm after a norm and its article mark is cut before it. Doubled article marks are one.
    """
    text = F.regexp_replace(F.regexp_replace("text", DOUBLED_MARK, "$1 "), DASHED_MARK, "$1 ")
    own = rf"(?isU)\G((?:(?!{MARK}|{NORM}).)*+{NORM}(?:(?!{MARK}).)*+{MARK}(?:(?!{NORM}).)*+)(?={NORM})"
    parts = F.flatten(F.transform(F.split(text, r"[;\r\n]+"), lambda p: F.split(F.regexp_replace(p, own, "$1\u0001"), "\u0001")))
    trimmed = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    return fields.select("ruling", F.posexplode(trimmed).alias("place", "piece"))


def listed_numbers(found: Column, ranged: Column) -> Column:
    """array of article numbers of the items found in a list, in order; a range, which ranged tells behind its low end, is written out up to MOST_SPAN."""
    number = lambda x: F.regexp_extract(x, r"^(\d+)", 1).try_cast("int")

    def each(item: Column, i: Column) -> Column:
        clean = F.lower(F.regexp_replace(item, r"\s+", " "))
        low, high = number(F.get(found, i - 1)), number(item)
        inner = F.when((F.get(ranged, i - 1) != "") & (low > 0) & (high - low > 1) & (high - low <= MOST_SPAN), F.transform(F.sequence(low + 1, F.greatest(high - 1, low + 1)), lambda n: n.cast("string")))
        return F.concat(F.coalesce(inner, F.array().cast("array<string>")), F.array(clean))

    return F.flatten(F.transform(found, each))


def _read_pieces(fields: DataFrame) -> DataFrame:
    """The pieces with the list behind a mark, what is left behind it, and the name of the norm before the mark, or else right behind the list."""
    pieces = field_pieces(fields)
    marked = F.col("piece").rlike(rf"(?iU){MARK}")
    tail = F.regexp_extract("piece", rf"(?isU)^.*?{MARK}(.*)$", 1)
    out = pieces.withColumn("marked", marked).withColumn("tail", tail).withColumn("list", F.regexp_extract("tail", rf"(?iU)^({LIST}(?:(?:{COMMA}|(?<=\sa\s)){LIST})*+)", 1))
    out = out.withColumn("rest", F.expr("substr(tail, length(list) + 1)"))
    before = _bare(F.when(F.col("marked"), F.regexp_extract("piece", rf"(?isU)^(.*?){MARK}", 1)).otherwise(F.col("piece")))
    behind = F.regexp_replace(F.when(F.col("rest") != "", F.col("rest")).otherwise(F.col("tail")), r"^[ ,.;:]+", "")
    after = _bare(F.regexp_extract(behind, rf"(?isU)^(?:{BETWEEN})?({NORM}(?:(?!{NORM}|{MARK}).)*)", 1))
    return out.withColumn("designation", F.when(F.col("marked") & (before == ""), after).otherwise(before))


def field_articles(fields: DataFrame) -> DataFrame:
    """(ruling, place, n, number, designation): the articles of fields (ruling, text), in order, each with its norm as it is written.

    The norm stands before the article mark; only where nothing does, it is the one right behind the numbers. Parts without a
    mark may list numbers between dashes with blanks behind a norm.
    """
    read = _read_pieces(fields)
    items = [F.regexp_extract_all("list", F.lit("(?iU)" + LISTED), F.lit(g)).alias(name) for g, name in ((1, "found"), (2, "ranged"))]
    lists = read.where("marked").select("ruling", "place", "designation", *items)  # a column each, so that no item reads the list anew
    lists = lists.select("ruling", "place", "designation", F.lit(0).alias("sub"), listed_numbers(F.col("found"), F.col("ranged")).alias("numbers"))
    named = F.regexp_extract_all("piece", F.lit(rf"(?isU)({NORM}(?:(?!{NORM}).)*)"), F.lit(1))
    dashed = read.where(~F.col("marked") & F.col("piece").rlike("(?iU)" + DASH_ITEM)).select("ruling", "place", F.posexplode(named).alias("sub", "part"))
    head = _bare(F.regexp_extract("part", rf"(?isU)^(.*?){DASH_ITEM}", 1))
    dashed = dashed.select("ruling", "place", head.alias("designation"), "sub", F.regexp_extract_all("part", F.lit("(?iU)" + DASH_ITEM), F.lit(1)).alias("numbers"))
    each = lists.unionByName(dashed).select("ruling", "place", "sub", "designation", F.posexplode("numbers").alias("n", "number"))
    return each.select("ruling", "place", "sub", "n", "number", "designation")


def unread_fields(fields: DataFrame) -> DataFrame:
    """(ruling, place, piece, rest): pieces with an article mark behind whose list digits are left unread."""
    return _read_pieces(fields).where(F.col("marked") & F.col("rest").rlike(r"\d")).select("ruling", "place", "piece", "rest")


def resolved_designations(designations: DataFrame, alias: DataFrame) -> DataFrame:
    """(designation, body, state) of distinct designations (designation) against alias (alias, body).

    The whole, each norm in it and its parts between commas are looked up; all that are found must agree on one body.
    Otherwise the state is external where it looks like a norm, and none where it doesn't or two bodies are named.
    """
    whole = F.col("designation")
    spellings = F.array_distinct(F.filter(F.concat(F.array(whole), F.regexp_extract_all(whole, F.lit("(?iU)" + NORM), F.lit(0)), F.transform(F.split(whole, ","), lambda p: F.trim(p))), lambda p: p != ""))
    each = designations.select("designation", F.explode(spellings).alias("name"))
    names = each.select(F.col("name").alias("name_id"), "name").distinct()
    found = resolve_names(names, alias).where("body IS NOT NULL").select(F.col("name_id").alias("name"), "body")
    agreed = each.join(found, "name").groupBy("designation").agg(F.count_distinct("body").alias("bodies"), F.min("body").alias("body"))
    joined = designations.join(agreed, "designation", "left")
    state = F.when(F.col("bodies") == 1, "loaded").when(F.col("bodies").isNull() & whole.rlike(LOOKS_LIKE_NORM), "external").otherwise("none")
    return joined.select("designation", F.when(F.col("bodies") == 1, F.col("body")).alias("body"), state.alias("state"))


def field_precepts(fields: DataFrame, alias: DataFrame, articles: DataFrame) -> DataFrame:
    """field_articles with body, state, corrected_from, expanded, comparable and group_key, against alias (alias, body) and articles (body, document, number).

    An article that its body lacks and one other body of the document has goes to that one. A norm that isn't found is looked
    up with its abbreviations written out, and counts if the article exists there. Names are looked up once each and (name,
    number) pairs once each, and kept; only their results meet the fields' rows.
    """
    rows = field_articles(fields)
    pairs = cut(rows.select("designation", "number").distinct()).withColumn("wide", expand_abbreviations(F.col("designation")))
    names = pairs.select("designation").union(pairs.select("wide")).distinct()
    found = cut(resolved_designations(names, alias))
    wide = found.select(F.col("designation").alias("wide"), F.col("body").alias("wide_body"))
    asked = pairs.join(found, "designation").join(wide, "wide").withColumn("asked", F.coalesce("body", "wide_body"))
    own = articles.select(F.col("body").alias("asked"), "number").distinct().withColumn("has", F.lit(True))
    where = articles.select(F.col("body").alias("asked"), "document").distinct()
    siblings = articles.groupBy("document", "number").agg(F.count_distinct("body").alias("bodies"), F.min("body").alias("sibling"))
    joined = asked.join(own, ["asked", "number"], "left").join(where, "asked", "left").join(siblings, ["document", "number"], "left")
    moved = F.col("has").isNull() & (F.coalesce("bodies", F.lit(0)) == 1)
    opened = (F.col("state") != "loaded") & F.col("wide_body").isNotNull() & (F.coalesce("has", F.lit(False)) | moved)
    loaded = (F.col("state") == "loaded") | opened
    pairs = joined.select(
        "designation", "number",
        F.when(loaded, F.when(moved, F.col("sibling")).otherwise(F.col("asked"))).alias("body"), F.when(opened, "loaded").otherwise(F.col("state")).alias("state"),
        F.when(moved & (F.col("state") == "loaded"), F.col("asked")).alias("corrected_from"), opened.alias("expanded"),
    )
    group = F.concat_ws("|", F.coalesce("body", F.concat(F.lit("externa:"), F.lower("designation"))), F.lower("number"))
    return rows.join(pairs, ["designation", "number"]).select("ruling", "place", "sub", "n", "number", "designation", "body", "state", "corrected_from", "expanded", ((F.col("state") == "loaded") & F.col("body").isNotNull()).alias("comparable"), group.alias("group_key"))


def field_causes(fields: DataFrame, alias: DataFrame, articles: DataFrame, numbers: DataFrame) -> DataFrame:
    """(ruling, cause, reads): why a field (ruling, text) names no article of the corpus; empty if it does, which reads tells, or if no known cause fits.

    numbers (number) are the corpus's norm numbers, such as 37/1992. An abbreviation is a cause only if the field, written out,
    still names no article. Null and blank fields cite none.
    """
    flat = fields.select("ruling", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")).alias("text"))
    both = flat.select(F.struct("ruling", F.lit(False).alias("wide")).alias("ruling"), "text").union(flat.select(F.struct("ruling", F.lit(True)), expand_abbreviations(F.col("text"))))
    reads = field_precepts(both, alias, articles).where("comparable").select("ruling.*").groupBy("ruling").agg(F.bool_or(~F.col("wide")).alias("plain_reads"), F.bool_or("wide").alias("wide_reads"))
    cited = flat.select("ruling", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b\d+/\d{4}\b"), F.lit(0)))).alias("number"))
    known = cited.join(numbers.select("number").distinct().withColumn("ours", F.lit(True)), "number", "left").groupBy("ruling").agg(F.bool_or(F.coalesce("ours", F.lit(False))).alias("ours"))
    text = F.col("text")
    cause = F.when(text == "", NO_ARTICLES).when(F.col("plain_reads"), "").when(text.rlike(NO_MARK_SIGN), NO_MARK).when(text.rlike(ABBREVIATION_SIGN) & ~F.coalesce("wide_reads", F.lit(False)), ABBREVIATION).when(~F.col("ours"), FOREIGN)
    for name, sign in LATER_SIGNS:
        cause = cause.when(text.rlike(sign), name)
    cause = cause.when(~text.rlike(SOME_ARTICLE), NO_ARTICLES).otherwise("")
    return flat.join(reads, "ruling", "left").join(known, "ruling", "left").select("ruling", cause.alias("cause"), F.coalesce("plain_reads", F.lit(False)).alias("reads"))


def reach_report(causes: DataFrame) -> DataFrame:
    """(outcome, rulings) of field_causes: reached, unexplained, or a cause. Unexplained fields are of a new form, which a load should stop at."""
    outcome = F.when(F.col("reads"), "reached").when(F.col("cause") == "", "unexplained").otherwise(F.col("cause"))
    return causes.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("rulings"))


def uncovered_articles(asked: DataFrame, precepts: DataFrame) -> DataFrame:
    """(body, number, times): the articles asked for (body, number) that no comparable precept of a ruling covers, most often asked first."""
    wanted = asked.groupBy("body", "number").agg(F.count("*").alias("times"))
    covered = precepts.where("comparable").select("body", "number").distinct()
    return wanted.join(covered, ["body", "number"], "left_anti").orderBy(F.desc("times"), "body", "number")


def coverage_counts(precepts: DataFrame) -> DataFrame:
    """(body, number, rulings): how many rulings name each article of the corpus."""
    return precepts.where("comparable").groupBy("body", "number").agg(F.count_distinct("ruling").alias("rulings"))
