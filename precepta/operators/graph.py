"""Reference graphs as edge tables: reference lists in texts, resolution, adjacency, closure, chains."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precepta.functions.text import fold
from precepta.sources.readers import cut

# A longer range isn't expanded.
MOST_SPAN = 400
#: Ordinal suffixes of article numbers, with the misspellings that occur.
SUFFIX = (
    r"(?i:bis|ter|qu[aá]ter|quinquies|sexies|septies|octies|nonies|decies|undecies|duodecies|terdecies|quaterdecies|quindecies|quinquiesdecies|sexiesdecies|septiesdecies|octiesdecies|noniesdecies|"
    r"vicies|unvicies|duovicies|tervicies|quatervicies|quinvicies|sexvicies|septvicies|octovicies|novovicies|cuarter|quinque|sexvivies)(?![\wáéíóúüñ])"
)
#: A reference list: article mark, then numbers with suffixes joined by commas, "y", "o", "a" or "al".
MENTION = r"(?i)\b(?:art[íi]culos?|arts?\.|articles?)\s+((?:\d+(?:\s+" + SUFFIX + r")?(?:\s*,\s*|\s+(?:y|o|e|and|or|a|al|to)\s+)?)+)"


# What hangs on an article number and is no article of its own, and what joins numbers.
NUMBER_WORDS = "uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez|once|doce|trece|catorce|quince|diecis[eé]is|diecisiete|dieciocho|diecinueve|veinte"
ATTACHED = (
    r"(?:[ \t]*[-.][ \t]*(?:\d+|(?:" + NUMBER_WORDS + r"|[a-z])(?![\wáéíóúñ]))[ \t]*(?:\.?[ºª])?|\s*[ºª]|\s*,?\s*apartad[oa]s?\s+[\wªº]+(?:\s+[ya]\s+[\wªº]+)?|"
    r"\s*,?\s*n[uú]meros?\s+\d[\d.]*[ºª]?|\s*,?\s*letras?\s+[a-z]['’]?\)|\s*,?\s*p[aá]rrafos?\s+\w+)"
)
NUMBER = r"\d+(?:\s+" + SUFFIX + r")?"
CONNECTED = r"(?:\s*,\s*(?:y|e|o|u)\s+|\s*,\s*|\s+(?:y|e|o|u)\s+|\s*,?\s+al?\s+)"
ARTICLES = r"(?i)\b(?:art[íi]culos?|arts?\.)\s+(" + NUMBER + ATTACHED + "*(?:" + CONNECTED + NUMBER + ATTACHED + r"*)*)"
#: What stands between a list and the next mention or the end of its sentence.
BEHIND = r"((?:(?!\bart[íi]culos?\b|\barts?\.|[.;]\s).)*)"
KINDS = "adicional|transitoria|derogatoria|final"
OWN_NORM = r"(?i)^[\s,;]*(?:de\s+)?(?:est[ae]|la\s+presente|el\s+presente)\s+(?:ley|reglamento|real\s+decreto)\b"
ANAPHORA = r"(?i)\bde(?:l)?\s+(?:dich[oa]|citad[oa]|mencionad[oa]|referid[oa])\s+(?:ley|reglamento|real\s+decreto)\b"
NORM_NUMBER = r"(?i)\b(?:ley(?:\s+org[áa]nica)?|real\s+decreto(?:-ley|\s+legislativo)?|directiva|orden|reglamento)\s+(?:\([A-Z]+\)\s+)?(\d+/\d{2,4}|[A-Z]{3}/\d+/\d{4})"


def list_numbers(listed: Column) -> Column:
    """array of the article numbers of a list as ARTICLES finds it: what hangs on numbers dropped, ranges expanded up to MOST_SPAN."""
    bare = F.regexp_replace(listed, "(?i)(?<=\\d|[a-z])" + ATTACHED, "")
    items = F.regexp_extract_all(bare, F.lit(r"(?i)(" + NUMBER + r"(?:\s*,?\s+al?\s+" + NUMBER + r")?)"), F.lit(1))

    def expand(item: Column) -> Column:
        clean = F.lower(F.regexp_replace(item, r"\s+", " "))
        high = F.regexp_extract(clean, r"\d.*? al? (\d.*)$", 1)
        low = F.when(high == "", clean).otherwise(F.regexp_extract(clean, r"^(.*?),? al? \d", 1))
        a, b = F.regexp_extract(low, r"^(\d+)", 1).try_cast("int"), F.regexp_extract(high, r"^(\d+)", 1).try_cast("int")
        inner = F.when((b > a) & (b - a <= MOST_SPAN), F.transform(F.sequence(a + 1, F.greatest(b, a + 1)), lambda n: n.cast("string"))).otherwise(F.array(high))
        return F.when(high == "", F.array(low)).otherwise(F.concat(F.array(low), inner, F.when(high.rlike("[a-z]"), F.array(high)).otherwise(F.array().cast("array<string>"))))

    return F.array_distinct(F.flatten(F.transform(items, expand)))


def scoped_references(docs: DataFrame, norms: DataFrame) -> DataFrame:
    """(origin, number, scope, norm) of the articles that docs (origin, text) mention, against the corpus's norms (norm).

    What stands between a list and the next mention, or the end of the sentence, tells its norm: a number of a norm
    (corpus, or external if norms lack it), the text's own one (own), or one named before, which declines (unclear).
    Without any of these it is the own one.
    """
    found = F.regexp_extract_all("text", F.lit(ARTICLES + BEHIND), F.lit(1)), F.regexp_extract_all("text", F.lit(ARTICLES + BEHIND), F.lit(2))
    each = docs.select("origin", F.explode(F.arrays_zip(found[0].alias("listed"), found[1].alias("behind"))).alias("m")).select("origin", "m.*")
    norm = F.nullif(F.regexp_extract("behind", NORM_NUMBER, 1), F.lit(""))
    named = each.select("origin", F.explode(list_numbers(F.col("listed"))).alias("number"), "behind", norm.alias("norm")).distinct()
    known = norms.select("norm").distinct().withColumn("known", F.lit(True))
    scope = F.when(F.col("behind").rlike(OWN_NORM), "own").when(F.col("norm").isNotNull(), F.when(F.col("known"), "corpus").otherwise("external")).when(F.col("behind").rlike(ANAPHORA), "unclear").otherwise("own")
    return named.join(known, "norm", "left").select("origin", "number", scope.alias("scope"), F.when(scope.isin("corpus", "external"), F.col("norm")).alias("norm")).distinct()


def ordinal_numbers() -> dict[str, int]:
    """Folded feminine and masculine ordinal words without blanks, up to 99, and 0 for the only one."""
    ones = "primer segund tercer cuart quint sext septim octav noven".split()
    tens = "decim vigesim trigesim cuadragesim quincuagesim sexagesim septuagesim octogesim nonagesim".split()
    out = {f"unic{e}": 0 for e in "ao"}
    for e in "ao":
        out |= {f"{w}{e}": i + 1 for i, w in enumerate(ones)} | {f"undecim{e}": 11, f"duodecim{e}": 12}
        for t, ten in enumerate(tens):
            out[f"{ten}{e}"] = 10 * (t + 1)
            out |= {f"{ten}{f}{w}{e}": 10 * (t + 1) + i + 1 for i, w in enumerate(ones) for f in "oa"}
    return out


def provision_references(docs: DataFrame) -> DataFrame:
    """(origin, kind, number) of the provisions that docs (origin, text) mention: kind, and the number of their ordinal, 0 for the only one.

    Ordinals are words, in one or in two, or numbers; a list is read up to what is no ordinal, and a mention without one is none.
    """
    word = r"(?:\d{1,3}\.?\s?[ªº]?|[a-z]+(?:\s+(?:primer|segund|tercer|cuart|quint|sext|septim|octav|noven)[ao])?)"
    pattern = r"disposicion(?:es)?\s+(" + KINDS + r")(?:es|s)?\s+(" + word + r"(?:(?:\s*,\s*|\s+y\s+)" + word + ")*)"
    text = fold(F.col("text"))
    each = docs.select("origin", F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("kind"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("listed"))).alias("m")).select("origin", "m.*")
    parts = each.select("origin", "kind", F.posexplode(F.split("listed", r"\s*,\s*|\s+y\s+")).alias("place", "part"), "listed")
    words = parts.sparkSession.createDataFrame(list(ordinal_numbers().items()), "word string, value int")
    keyed = parts.withColumn("word", F.regexp_replace("part", r"\s+", "")).withColumn("first", F.regexp_extract("part", r"^([a-z]+)", 1))
    both = keyed.join(F.broadcast(words), "word", "left").join(F.broadcast(words.toDF("first", "first_value")), "first", "left")
    number = F.coalesce(F.regexp_extract("part", r"^(\d+)", 1).try_cast("int"), F.col("value"), F.col("first_value"))
    # a list ends before its first part that is no ordinal
    read = both.withColumn("number", number).groupBy("origin", "kind", "listed").agg(F.min(F.when(F.col("number").isNull(), F.col("place"))).alias("stop"), F.collect_set(F.when(F.col("number").isNotNull(), F.struct("place", "number"))).alias("found"))
    return read.select("origin", "kind", "stop", F.explode("found").alias("f")).where("stop IS NULL OR f.place < stop").select("origin", "kind", F.col("f.number").alias("number")).distinct()


def annex_references(docs: DataFrame, norms: DataFrame) -> DataFrame:
    """(origin, annex, norm) of annexes of norms that the corpus (norm) doesn't have; those of its own are precepts already."""
    pattern = r"(?i)\banexo\s*([IVXLC]*|\d*)\s+de(?:l|\s+la|\s+el)?\s+" + NORM_NUMBER.removeprefix("(?i)\\b")
    each = docs.select("origin", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("annex"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("norm"))).alias("m")).select("origin", "m.*")
    return each.join(norms.select("norm").distinct(), "norm", "left_anti").select("origin", F.upper("annex").alias("annex"), "norm").distinct()


def quoted_blocks(docs: DataFrame, most_before: int = 220) -> DataFrame:
    """(origin, n, norm, block): what docs (origin, text, own) quote in «» behind words that name another norm than own, the text's own number.

    Such blocks are put into that norm, and the articles they mention are its own. The last most_before characters before
    a block, behind the quotation before it, are read.
    """
    quotes = F.arrays_zip(*[F.regexp_extract_all("text", F.lit("(?s)([^«»]*)«([^»]*)»"), F.lit(g)).alias(name) for g, name in ((1, "before"), (2, "block"))])
    each = docs.select("origin", "own", F.posexplode(quotes).alias("n", "q")).select("origin", "own", "n", "q.*")
    norm = F.regexp_extract(F.right("before", F.lit(most_before)), NORM_NUMBER, 1)
    return each.withColumn("norm", norm).where((F.col("norm") != "") & ~F.col("norm").eqNullSafe(F.col("own"))).select("origin", "n", "norm", "block")


def references_with_blocks(docs: DataFrame, norms: DataFrame) -> DataFrame:
    """scoped_references of docs (origin, text, own), but that own mentions in quoted_blocks are of the norm that the block goes into."""
    blocks = quoted_blocks(docs)
    cuts = blocks.groupBy("origin").agg(F.collect_set("block").alias("blocks"))
    bare = docs.join(cuts, "origin", "left").select("origin", F.aggregate(F.coalesce("blocks", F.array().cast("array<string>")), F.col("text"), lambda t, b: F.replace(t, F.concat(F.lit("«"), b, F.lit("»")), F.lit("«»"))).alias("text"))
    keyed = blocks.select(F.struct("origin", "norm").alias("origin"), F.col("block").alias("text"))
    known = norms.select(F.col("norm").alias("into")).distinct().withColumn("known", F.lit(True))
    inner = scoped_references(keyed, norms).select(F.col("origin.origin").alias("origin"), "number", "scope", "norm", F.col("origin.norm").alias("into")).join(known, "into", "left")
    own = F.col("scope") == "own"
    moved = inner.select("origin", "number", F.when(own, F.when(F.col("known"), "corpus").otherwise("external")).otherwise(F.col("scope")).alias("scope"), F.when(own, F.col("into")).otherwise(F.col("norm")).alias("norm"))
    return scoped_references(bare, norms).union(moved).distinct()


def pending_edges(edges: DataFrame) -> DataFrame:
    """The edges that aren't resolved."""
    return edges.where("state != 'resolved'")


def cross_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_norm, to_norm, edges): resolved edges (origin, target, state) by the norms of both ends, of nodes (node, norm)."""
    one, two = nodes.toDF("origin", "from_norm"), nodes.toDF("target", "to_norm")
    return edges.where("state = 'resolved'").join(one, "origin").join(two, "target").groupBy("from_norm", "to_norm").agg(F.count("*").alias("edges"))


def mentioned_numbers(text: Column) -> Column:
    """array of the article numbers a text mentions, ranges expanded up to MOST_SPAN, in order, distinct."""
    lists = F.regexp_extract_all(text, F.lit(MENTION), F.lit(1))
    ranged = F.flatten(F.transform(lists, lambda l: F.regexp_extract_all(l, F.lit(r"(\d+(?:\s+" + SUFFIX + r")?(?:\s+(?:a|al|to)\s+\d+)?)"), F.lit(1))))

    def expand(item: Column) -> Column:
        low, high = F.regexp_extract(item, r"^(\d+)", 1).try_cast("int"), F.regexp_extract(item, r"(?:a|al|to)\s+(\d+)$", 1).try_cast("int")
        ends = F.array(low.cast("string"), high.cast("string"))
        run = F.when((high >= low) & (high - low <= MOST_SPAN), F.transform(F.sequence(low, F.greatest(low, high)), lambda n: n.cast("string"))).otherwise(ends)
        return F.when(high.isNull(), F.array(F.regexp_replace(F.trim(item), r"\s+", " "))).otherwise(run)

    return F.array_distinct(F.flatten(F.transform(ranged, expand)))


def mentions(docs: DataFrame) -> DataFrame:
    """(origin, number) of docs (origin, text); single-line texts are headings and have none."""
    body = F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\n') + 1)"))
    return docs.select("origin", F.explode(mentioned_numbers(body)).alias("number"))


def classified(asked: DataFrame, own: DataFrame, siblings: DataFrame) -> DataFrame:
    """(origin, number, target, state) of asked (origin, body, document, number).

    The own body's article first (own: body, number, own); else the only one of that number in the document (siblings:
    document, number, sibling, n); several make it ambiguous.
    """
    joined = asked.distinct().join(own, ["body", "number"], "left").join(siblings, ["document", "number"], "left")
    target = F.coalesce("own", F.when(F.col("n") == 1, F.col("sibling")))
    state = F.when(target.isNotNull(), "resolved").when(F.col("n") > 1, "ambiguous").otherwise("not_found")
    return joined.select("origin", "number", target.alias("target"), state.alias("state"))


def resolved_edges(found: DataFrame, articles: DataFrame) -> DataFrame:
    """found (origin, body, number) against articles (body, document, number, key): origin, number, target, state."""
    asked = found.join(articles.select("body", "document").distinct(), "body", "left")
    own = articles.groupBy("body", "number").agg(F.min("key").alias("own"))
    siblings = articles.groupBy("document", "number").agg(F.min("key").alias("sibling"), F.count("*").alias("n"))
    return classified(asked, own, siblings)


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct (origin, target) of resolved edges but self-references."""
    return edges.where("state = 'resolved' AND origin != target").select("origin", "target").distinct()


def range_expand(ranges: DataFrame, existing: DataFrame, width: int = MOST_SPAN) -> DataFrame:
    """(range_id, number) of the existing numbers within each range (range_id, low, high).

    A range join by bins: a range is put into the bins it touches (a wide one is bounded by width), numbers into theirs, so
    that the join has an equality.
    """
    binned = ranges.where(f"high >= low AND high - low <= {width}").withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    return binned.join(existing.withColumn("bin", F.floor(F.col("number") / width)), "bin").where("number BETWEEN low AND high").select("range_id", "number")


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, hops) of all nodes reached from seeds (seed) over edges (origin, target), each at its fewest hops.

    Rounds of frontier joins until nothing new is reached, as many as the graph is deep; each round's table is cut off
    from its lineage.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = cut(edges.select("origin", "target").distinct())
    reached = cut(seeds.select("seed", F.col("seed").alias("node")).distinct().withColumn("hops", F.lit(0)))
    frontier = reached
    for hop in count(1):
        step = frontier.join(edges, F.col("node") == F.col("origin")).select("seed", F.col("target").alias("node")).distinct()
        frontier = cut(step.join(reached, ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            return reached
        reached = cut(reached.union(frontier).coalesce(parts))


def chain_roots(parents: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, root, depth) over parents (id, parent; null at a root) by pointer doubling; members of a cycle have no root."""
    state = cut(parents.select("id", F.col("parent").alias("up"), F.lit(0).alias("depth"), F.when(F.col("parent").isNull(), F.col("id")).alias("root")).withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1)))
    for _ in range(rounds):
        above = state.select(F.col("id").alias("up"), F.col("up").alias("upper"), F.col("depth").alias("more"), F.col("root").alias("found"))
        joined = state.join(above, "up", "left")
        state = cut(joined.select("id", F.when(F.col("root").isNull(), F.col("upper")).alias("up"), (F.col("depth") + F.when(F.col("root").isNull(), F.coalesce("more", F.lit(0))).otherwise(0)).alias("depth"), F.coalesce("root", "found", F.when(F.col("more").isNull(), F.col("up"))).alias("root")))
        if state.where("root IS NULL AND up IS NOT NULL AND depth <= 1000000").isEmpty():
            break
    return state.select("id", "root", F.when(F.col("root").isNotNull(), F.col("depth")).alias("depth"))


def edge_statistics(edges: DataFrame) -> DataFrame:
    """(state, edges, self_references)."""
    return edges.groupBy("state").agg(F.count("*").alias("edges"), F.count_if(F.col("origin") == F.col("target")).alias("self_references"))


def first_edges(edges: DataFrame, by: str, order: str) -> DataFrame:
    """The first edge in order for each (by, other end)."""
    other = "target" if by == "origin" else "origin"
    return edges.withColumn("n", F.row_number().over(Window.partitionBy(by, other).orderBy(order))).where("n = 1").drop("n")
