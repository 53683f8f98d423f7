"""URL filtering by list rules and by association rules mined from labelled pages."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precepta.llm.common import ascii_lower, checked_broadcast, cut

#: (host, path, verdict) of list rules: each fits its host and all subdomains, for paths that start with its path.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Least support of a token combination with its label among the labelled pages, least confidence of a rule (a lower
#: bound of it, at Z standard deviations), most items of a rule, most labelled pages that are mined, and most items of a
#: page that FP-growth takes: those of pages with more are counted combination by combination.
SUPPORT, CONFIDENCE, Z, MOST_TOKENS, MINED_PAGES, MINED_ITEMS = 0.002, 0.5, 2.0, 4, 200_000, 16
BLOCK, ALLOW = "=block", "=allow"


def url_host(url: Column) -> Column:
    """From behind the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """From behind the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url: host labels and the whole host, path words without digits, extension, query keys, scheme."""
    tagged = lambda tag, words: F.transform(words, lambda w: F.concat(F.lit(tag), w))
    labels = F.filter(F.split(host, r"\."), lambda w: w != "")
    words = F.filter(F.split(ascii_lower(path), r"[^a-z\x80-\x{10FFFF}]+"), lambda w: w != "")
    keys = F.regexp_extract_all(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(r"([^&=]+)(?:=[^&]*)?"), F.lit(1))
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    anchor = F.when(url.contains("#"), F.array(F.lit("#"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(tagged("h:", labels), F.array(F.concat(F.lit("H:"), host)), tagged("p:", words), tagged("q:", keys), F.array(F.concat(F.lit("s:"), scheme)), anchor))


def list_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, else null."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def url_items(rows: DataFrame) -> DataFrame:
    """(item, tokens, n, n_blocked) of rows (row, tokens, blocked): tokens of exactly the same rows are one item.

    An item is named by its smallest token; n and n_blocked count its rows. Sets of rows are told apart by their size and
    two hashes. The tokens of an item stand together in a url, so they are no more than its tokens.
    """
    row = F.xxhash64("row")
    each = rows.select("row", "blocked", F.explode("tokens").alias("token"))
    tokens = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("n_blocked"), F.bit_xor(row).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit("sum"), "row"), 24)).alias("s"))
    return tokens.groupBy("n", "n_blocked", "x", "s").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("tokens")).select("item", "tokens", "n", "n_blocked")


def _sure(rules: DataFrame, confidence: float) -> DataFrame:
    p = F.col("confidence")
    return rules.where(p - Z * F.sqrt(p * (1 - p) / F.col("n") + 0.25 / (F.col("n") * F.col("n"))) >= confidence)


def _frequent(baskets: DataFrame, least: int, most: int) -> DataFrame:
    """(items, n, n_blocked) of the combinations of 2 to most items of baskets (found, blocked), blocked in `least` of them or more, by FP-growth."""
    n = baskets.count()
    if not n:
        return baskets.sparkSession.createDataFrame([], "items array<string>, n long, n_blocked long")
    marked = baskets.select(F.array_append("found", F.when(F.col("blocked"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))).alias("items"))
    growth = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), numPartitions=baskets.sparkSession.sparkContext.defaultParallelism)
    bad = F.array_contains("items", BLOCK)
    sets = growth.fit(marked).freqItemsets.where(~F.array_contains("items", ALLOW) & (F.size("items") - bad.cast("int")).between(2, most))
    sets = cut(sets.select(F.array_sort(F.array_remove("items", BLOCK)).alias("items"), "freq", bad.alias("bad")))
    return sets.where("NOT bad").select("items", F.col("freq").alias("n")).join(sets.where("bad").select("items", F.col("freq").alias("n_blocked")), "items")


def _frequent_wide(baskets: DataFrame, least: float, most: int) -> DataFrame:
    """(items, n, n_blocked) of the combinations of 2 to most items of baskets (found, n, n_blocked) whose n_blocked is `least` or more.

    Each is one with an item less, of the start of it, which is as frequent, and a later item of the same basket.
    """
    added = [F.sum(c).alias(c) for c in ("n", "n_blocked")]
    level = baskets.select(F.array().cast("array<string>").alias("items"), F.col("found").alias("rest"), "n", "n_blocked")
    out = []
    for _ in range(most):
        longer = level.select("items", "rest", "n", "n_blocked", F.posexplode("rest").alias("i", "item"))
        longer = longer.select(F.array_append("items", F.col("item")).alias("items"), F.slice("rest", F.col("i") + 2, F.size("rest")).alias("rest"), "n", "n_blocked")
        out.append(cut(longer.groupBy("items").agg(*added).where(F.col("n_blocked") >= F.lit(least))))
        if len(out) < most:
            level = longer.where(F.size("rest") > 0).join(checked_broadcast(out[-1].select("items")), "items", "left_semi")
            level = cut(level.groupBy("items", "rest").agg(*added))
    return reduce(DataFrame.union, out).where(F.size("items") > 1)


def _counts(sets: DataFrame, baskets: DataFrame, items: DataFrame) -> DataFrame:
    """(items, n, n_blocked) of sets (items) in baskets (found, n, n_blocked), which are met by each set's rarest item (see url_items)."""
    rare = sets.select("items", F.explode("items").alias("item")).join(items.select("item", F.col("n").alias("pages")), "item")
    keyed = rare.groupBy("items").agg(F.min(F.struct("pages", "item"))["item"].alias("key"))
    each = baskets.select("*", F.explode("found").alias("key")).join(checked_broadcast(keyed), "key").where(F.forall("items", lambda i: F.array_contains("found", i)))
    return each.groupBy("items").agg(F.sum("n").alias("n"), F.sum("n_blocked").alias("n_blocked"))


def combinations(found: DataFrame, items: DataFrame, least: float, most: int, mined_items: int) -> DataFrame:
    """(items, n, n_blocked) of the combinations of 2 to most items of found (found, blocked), blocked on `least` pages or more.

    FP-growth takes the pages of up to mined_items items, as it forms all combinations of a page's items, of any length.
    What is frequent on all pages is so on these or on the others, each with a part of `least`; combinations that are
    frequent on either are counted on both, so the numbers are those of all pages and items.
    """
    wide = cut(found.where(F.size("found") > mined_items).groupBy("found").agg(F.count("*").alias("n"), F.count_if("blocked").alias("n_blocked")))
    narrow = found.where(F.size("found") <= mined_items).select("found", "blocked")
    n_wide, blocked_wide = (int(x or 0) for x in wide.agg(F.sum("n"), F.sum("n_blocked")).first())
    part = max(least / 2, least - blocked_wide)
    sets = cut(_frequent(narrow, math.ceil(part), most))
    if n_wide:
        further = cut(_frequent_wide(wide, least - part, most)) if blocked_wide > least - part else sets.limit(0)
        here = _counts(sets.join(further, "items", "left_anti").select("items"), wide, items)
        there = _counts(further.join(sets, "items", "left_anti").select("items"), narrow.groupBy("found").agg(F.count("*").alias("n"), F.count_if("blocked").alias("n_blocked")), items)
        sets = sets.union(further).union(here).union(there).groupBy("items").agg(F.sum("n").alias("n"), F.sum("n_blocked").alias("n_blocked"))
    return sets.where(F.col("n_blocked") >= F.lit(least))


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, most_tokens: int = MOST_TOKENS, mined_items: int = MINED_ITEMS) -> DataFrame:
    """(rule_id, items, tokens, confidence, n, key) mined from labelled (tokens array<string>, blocked boolean).

    Combinations of up to most_tokens items (see url_items) that occur with the label block in a share `support` of the
    pages, and are blocked with a lower confidence bound of `confidence`. A rule goes if one with fewer of its items is
    as confident. tokens has the tokens of each item, any of which stands for it; key is the place of the rarest item.

    Single items are counted. Combined are those that are blocked on some of their pages only and on enough of them, as
    no rule with any other is kept; see combinations for pages of many.
    """
    spark = labelled.sparkSession
    rows = cut(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "blocked"))
    schema = "rule_id long, items array<string>, tokens array<array<string>>, confidence double, n long, key int"
    total, blocked = rows.agg(F.count("*"), F.count_if("blocked")).first()
    if not blocked:
        return spark.createDataFrame([], schema)
    least = max(support * total, 10)
    items = cut(url_items(rows).where(F.col("n_blocked") >= F.lit(least)).withColumn("confidence", F.col("n_blocked") / F.col("n")))
    single = items.select(F.array("item").alias("items"), "confidence", "n")
    mixed = items.where("n_blocked < n").select(F.element_at("tokens", 1).alias("token"), "item")
    found = cut(rows.select("row", "blocked", F.explode("tokens").alias("token")).join(checked_broadcast(mixed), "token").groupBy("row", "blocked").agg(F.array_sort(F.collect_list("item")).alias("found")))
    several = combinations(found, items, least, most_tokens, mined_items).select("items", F.col("n_blocked") / F.col("n"), "n")
    rules = cut(_sure(single.union(several), confidence).select(F.monotonically_increasing_id().alias("rule_id"), "items", "confidence", "n"))
    # subsets of at most most_tokens items are few for each rule, so that redundant ones are found by an equi-join
    parts = rules.select("rule_id", "items", F.col("confidence").alias("own"), F.expr("explode(sequence(1, shiftleft(1, size(items)) - 2)) AS mask")).where("size(items) > 1")
    subset = F.expr("filter(items, (x, i) -> shiftright(mask, i) % 2 = 1)")
    redundant = parts.select("rule_id", "own", subset.alias("items")).join(rules.select("items", "confidence"), "items").where("confidence >= own").select("rule_id").distinct()
    kept = rules.join(redundant, "rule_id", "left_anti").select("*", F.posexplode("items").alias("place", "item"))
    named = kept.join(items.select("item", "tokens", F.col("n").alias("pages")), "item").groupBy("rule_id", "items", "confidence", "n")
    named = named.agg(F.array_sort(F.collect_list(F.struct("place", "tokens"))).alias("all"), F.min(F.struct("pages", "place"))["place"].alias("key"))
    return cut(named.select("rule_id", "items", F.col("all")["tokens"].alias("tokens"), "confidence", "n", "key"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, mined_pages: int = MINED_PAGES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule, verdict, mined_rule, mined_confidence.

    rule and verdict are those of the longest list rule that fits; without one, rule is null and the verdict is block
    if a mined rule fits, else allow. mined_rule is the most confident one that fits (ties by its tokens), given for all.

    Rules are mined from pages whose page_id is a doc_id of labels (doc_id, quality, toxic), blocked where the quality
    is 0 or the page toxic; of more than about mined_pages of them, a share is taken by a hash of page_id. They are
    matched by an inverted index from each rule's rarest item, so a page meets only rules that may fit; the index is
    broadcast up to a counted size and shuffled beyond.

    A null url, or one without ://, has an empty host and path and fits no rule. Rows are told apart by their place:
    repeated rows and null ids are each judged. Conflicting labels count as blocked. Without labels no rule is mined;
    an empty table gives an empty result. Further columns are ignored.
    """
    url = F.col("url").cast("string")
    parsed = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id"), F.coalesce(url, F.lit("")).alias("url"), url_host(url).alias("host"), url_path(url).alias("path"))
    tokens = F.when(F.col("url").contains("://"), url_tokens(F.col("url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>"))
    parsed = cut(parsed.select("row", "page_id", "host", "path", tokens.alias("tokens")))
    bad = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("blocked"))
    labelled = cut(parsed.select("page_id", "tokens").join(bad, "page_id"))
    n = labelled.count()
    if n > mined_pages:
        labelled = labelled.where(F.pmod(F.xxhash64("page_id"), F.lit(n)) < mined_pages)
    mined = mined_rules(labelled, support, confidence)
    index = mined.select("items", F.col("tokens").alias("needed"), "confidence", F.explode(F.col("tokens")[F.col("key")]).alias("token"))
    fits = F.forall("needed", lambda any_of: F.arrays_overlap(any_of, "tokens"))
    hits = parsed.select("row", "tokens", F.explode("tokens").alias("token")).join(checked_broadcast(index), "token").where(fits)
    best = hits.groupBy("row").agg(F.max(F.struct("confidence", F.array_join("items", " ").alias("items"))).alias("best"))
    fit = list_rule(F.col("host"), F.col("path"), rules)
    out = parsed.join(best, "row", "left").withColumn("fit", fit)
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("best").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.col("best.items").alias("mined_rule"), F.col("best.confidence").alias("mined_confidence"))
