"""Benchmark decontamination by a positional inverted index of the corpus. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precepta.llm.common import alphanumeric_words, checked_broadcast, cut, forget, is_small

WINDOW_WORDS = 10
#: Words before and behind that a posting carries, so that windows of up to one more word can be checked on it.
AROUND = WINDOW_WORDS - 1
#: A proximity match has its two rarest terms up to so many words off their distance, and such a share of its terms around.
SLOP, NEAR_SHARE = 3, 0.8
#: The document's end as a term: no word has a blank, and its position is the document's length.
END = " "


def test_windows(items: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """(window, terms, item_ids) of the distinct windows of items (item_id, text).

    A window is window_words consecutive words; an item of fewer words, but not none, is one window.
    """
    words = items.select("item_id", alphanumeric_words(F.col("text")).alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - F.lit(window_words - 1), F.lit(1)))
    windows = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, window_words))).alias("terms"))
    return windows.groupBy("terms").agg(F.collect_set("item_id").alias("item_ids")).select(F.monotonically_increasing_id().alias("window"), "terms", "item_ids")


def _scan(docs: DataFrame) -> DataFrame:
    """(row, doc_id, words): row numbers the rows of docs, words end with END."""
    words = F.concat(alphanumeric_words(F.col("text").cast("string")), F.array(F.lit(END)))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), words.alias("words"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in all of docs of those of terms (term) that occur."""
    # words are never empty; the plain explode would have them split twice, for a filter on their number
    found = _scan(docs).select(F.explode_outer("words").alias("term"))
    if is_small(terms):
        return found.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    return found.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term")  # counted before words are shuffled


def postings(docs: DataFrame, terms: DataFrame, around: int = AROUND) -> DataFrame:
    """The positional index of docs (doc_id, text) for terms (term): term, row, doc_id, position, near, shift.

    near are the words around the position, shift is the position's place among them. Each row of docs also has one
    posting of the term END, whose position is its number of words, so that the index knows every document and length.
    Terms that are too many to be broadcast meet the words in a shuffle, each with the words around it only.
    """
    terms = terms.select("term").union(terms.sparkSession.createDataFrame([(END,)], "term string")).distinct()
    near = lambda term, position: F.when(term != END, F.slice("words", F.greatest(position - around, F.lit(0)) + 1, 2 * around + 1)).alias("near")
    shift = F.least("position", F.lit(around)).alias("shift")
    if is_small(terms):
        each = _scan(docs).select("row", "doc_id", "words", F.posexplode("words").alias("position", "term"))
        return each.join(F.broadcast(terms), "term").select("term", "row", "doc_id", "position", near(F.col("term"), F.col("position")), shift)
    places = F.transform("words", lambda w, i: F.struct(w.alias("term"), i.alias("position"), near(w, i)))
    each = _scan(docs).select("row", "doc_id", F.inline(places))
    return each.join(terms, "term").select("term", "row", "doc_id", "position", "near", shift)


def _anchors(windows: DataFrame, counts: DataFrame, n: int, share: float = NEAR_SHARE) -> DataFrame:
    """(window, terms, rank, term, place, whole) of each window's n places of rarest terms that occur.

    whole: all of the window's terms occur. Windows of which less than the share occur are left out.
    """
    places = windows.select("window", "terms", F.posexplode("terms").alias("place", "term")).join(counts, "term", "left")
    by = Window.partitionBy("window")  # as many rows as a window has words
    ranked = places.withColumn("present", F.size(F.collect_set(F.when(F.col("n").isNotNull(), F.col("term"))).over(by)))
    ranked = ranked.withColumn("rank", F.row_number().over(by.orderBy(F.col("n").asc_nulls_last(), "term", "place"))).withColumn("distinct", F.size(F.array_distinct("terms")))
    kept = ranked.where((F.col("present") >= share * F.col("distinct")) & F.col("n").isNotNull() & (F.col("rank") <= n))
    return kept.select("window", "terms", "rank", "term", "place", (F.col("present") == F.col("distinct")).alias("whole"))


def phrase_matches(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(row, doc_id, window, start, n_terms) of all exact occurrences of the windows.

    The posting list of a window's rarest term, shifted by the term's place in the window, is intersected with that of
    its next rarest; what is left is compared word by word with the words around the posting.
    """
    rare, next_ = (checked_broadcast(anchors.where(f"whole AND rank = {k}").select("window", "terms", "term", "place")) for k in (1, 2))
    start = (F.col("position") - F.col("place")).alias("start")
    first = index.join(rare, "term").where("position >= place").select("row", "doc_id", "window", "terms", start, "near", (F.col("shift") - F.col("place")).alias("at"))
    second = index.join(next_, "term").select("row", "window", start)
    alone = first.where("size(terms) = 1")
    both = first.where("size(terms) > 1").join(second, ["row", "window", "start"])
    checked = both.select(*alone.columns).union(alone).where("at >= 0 AND slice(near, greatest(at, 0) + 1, size(terms)) = terms")
    return checked.select("row", "doc_id", "window", "start", F.size("terms").alias("n_terms")).distinct()


def proximity_matches(index: DataFrame, anchors: DataFrame, slop: int = SLOP, share: float = NEAR_SHARE) -> DataFrame:
    """(row, doc_id, window, start) where the two rarest terms of a window stand up to slop words off their distance.

    The words around the rarest one have at least the share of the window's terms, in any order. Starts are put in bins
    of slop + 1, and each is held against the same and the next bins only.
    """
    width = slop + 1
    rare, next_ = (checked_broadcast(anchors.where(f"rank = {k}").select("window", "terms", "term", "place")) for k in (1, 2))
    start = F.col("position") - F.col("place")
    enough = F.size(F.array_intersect("terms", "near")) >= share * F.size(F.array_distinct("terms"))
    first = index.join(rare, "term").where(enough).select("row", "doc_id", "window", start.alias("start")).withColumn("bin", F.explode(F.array(*[F.floor((F.col("start") + d) / width) for d in (-width, 0, width)])))
    second = index.join(next_, "term").select("row", "window", start.alias("other"), F.floor(start / width).alias("bin"))
    return first.join(second, ["row", "window", "bin"]).where(F.abs(F.col("start") - F.col("other")) <= slop).select("row", "doc_id", "window", "start").distinct()


def build_index(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows, anchors, index): the test windows, their two rarest terms each, and the postings of those terms."""
    windows = cut(test_windows(items, window_words))
    counts = cut(term_counts(docs, windows.select(F.explode("terms").alias("term")).distinct()))
    anchors = cut(_anchors(windows, counts, 2))
    forget(counts)
    return windows, anchors, cut(postings(docs, anchors.select("term").distinct(), window_words - 1))


def contamination(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items.

    docs and items (item_id, text) may have further columns, which are ignored. Texts are lower-cased (A-Z); words are
    runs of letters, digits and other non-ASCII characters. n_hit: the words inside any occurrence of any window of an
    item; n_items: the items with such windows; items_sha256: of their ids, sorted as strings, with commas between.
    n_near_items: the items with proximity matches (see proximity_matches), also of windows with some words that occur
    nowhere; they alone contaminate no document.

    The corpus is read twice: to count the test terms over all documents, and to store the postings of each window's two
    rarest terms. Only those leave the scans, so shuffles grow with the matches, not with the texts. Lists of test terms
    are broadcast only up to a counted size, and shuffled beyond.

    Null or empty texts have no words and no hits; an item without words is never found. Rows are told apart by their
    place, so repeated rows and null ids are each judged on their own text. Empty tables give empty results or no hits.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    windows, anchors, index = build_index(docs, items, window_words)
    matches = cut(phrase_matches(index.where(F.col("term") != END), anchors))
    hit = matches.select("row", F.explode(F.sequence("start", F.col("start") + F.col("n_terms") - 1)).alias("position")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    found = matches.select("row", "window").distinct().join(windows.select("window", F.explode("item_ids").alias("item")), "window").select("row", F.col("item").cast("string").alias("item")).distinct()
    named = found.groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    near = proximity_matches(index.where(F.col("term") != END), anchors).select("row", "window").distinct().join(windows.select("window", F.explode("item_ids").alias("item")), "window")
    near = near.groupBy("row").agg(F.count_distinct("item").alias("n_near_items"))
    lengths = index.where(F.col("term") == END).select("row", "doc_id", F.col("position").cast("long").alias("n_words"))
    joined = lengths.join(hit, "row", "left").join(named, "row", "left").join(near, "row", "left")
    return joined.select("doc_id", "n_words", _or(F.col("n_hit"), 0).alias("n_hit"), _or(F.col("n_items"), 0).alias("n_items"), F.sha2(_or(F.col("items"), ""), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), _or(F.col("n_near_items"), 0).alias("n_near_items"))


def _or(column: Column, value) -> Column:
    return F.coalesce(column, F.lit(value))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT r, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY r),
-- proximity: the two rarest occurring words of a window up to 3 words off their distance, with 0.8 of its words around
wl AS (SELECT row_number() OVER () AS win, ws FROM (SELECT DISTINCT w[i:i + 9] AS ws FROM (SELECT w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0))),
wi AS (SELECT DISTINCT win, item_id FROM wl JOIN bw ON array_to_string(ws, ' ') = g),
dp AS (SELECT r, w, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS p FROM d),
tc AS (SELECT term, count(*) AS c FROM dp GROUP BY term),
wp AS (SELECT win, ws, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS place FROM wl),
wr AS (SELECT win, ws, term, place, row_number() OVER (PARTITION BY win ORDER BY c NULLS LAST, term, place) AS k, count(DISTINCT CASE WHEN c IS NOT NULL THEN term END) OVER (PARTITION BY win) AS present, c FROM wp LEFT JOIN tc USING (term)),
wa AS (SELECT * FROM wr WHERE c IS NOT NULL AND present >= 0.8 * len(list_distinct(ws)) AND k <= 2),
n1 AS (SELECT r, win, p - place AS s FROM dp JOIN wa USING (term) WHERE k = 1 AND len(list_intersect(ws, w[greatest(p - 9, 1):p + 9])) >= 0.8 * len(list_distinct(ws))),
n2 AS (SELECT r, win, p - place AS s FROM dp JOIN wa USING (term) WHERE k = 2),
nn AS (SELECT r, count(DISTINCT item_id) AS n_near FROM (SELECT DISTINCT n1.r, n1.win FROM n1 JOIN n2 ON n1.r = n2.r AND n1.win = n2.win AND abs(n1.s - n2.s) <= 3) JOIN wi USING (win) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r) LEFT JOIN nn USING (r)
"""
