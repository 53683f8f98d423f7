"""Quality rules over whole texts, with repetition measured by suffix arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precepta.llm import textbytes as tb
from precepta.llm.common import in_python

#: Repeats of so many words count for the covered fraction, which may be so much; no repeat may be longer than this.
REPEAT_WORDS, MAX_COVERED, MAX_LONGEST = 10, 0.15, 100
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, place of the first equal key in that order) of keys."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def longest_repeats(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word, the words of the longest substring of its own text that begins there and occurs again in it.

    Suffix arrays of all texts at once, by prefix doubling: each round ranks by twice as many words, and goes on only
    with suffixes that still tie. The ranks of all rounds then give the common prefixes of neighbours in the suffix
    array; the larger one of a suffix's two is the longest LCP interval that it lies in.
    """
    n = len(words)
    best = np.zeros(n, np.int64)
    if not n:
        return best
    counts = np.diff(first)
    text, stop = np.repeat(np.arange(len(counts)), counts), np.repeat(first[1:], counts)
    kinds = np.unique(words, return_inverse=True)[1].astype(np.int64)
    order, group = _ranked(text * (int(kinds.max()) + 1) + kinds)
    rank = np.empty(n, np.int64)
    rank[order] = group
    levels, step = [rank.copy()], 1
    while True:
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(tied):
            break
        after = tied + step
        second = np.where(after < stop[tied], rank[np.minimum(after, n - 1)] + 1, 0)
        order, group = _ranked(rank[tied] * (n + 1) + second)
        tied = tied[order]
        old = rank[tied]
        begins = np.ones(len(tied), bool)
        begins[1:] = old[1:] != old[:-1]
        rank[tied] = old + group - np.maximum.accumulate(np.where(begins, np.arange(len(tied)), 0))
        levels.append(rank.copy())
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    pairs = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]])
    a, b, common = suffixes[pairs], suffixes[pairs + 1], np.zeros(len(pairs), np.int64)
    i, j = a.copy(), b.copy()
    for k in range(len(levels) - 1, -1, -1):
        same = (i < stop[a]) & (j < stop[b])
        same &= levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)]
        i, j, common = i + same * (1 << k), j + same * (1 << k), common + same * (1 << k)
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    return best


def covered(first: np.ndarray, lengths: np.ndarray, least: int) -> np.ndarray:
    """Words of each text in the union of the spans of lengths of at least `least`."""
    long = lengths >= least
    change = np.zeros(len(lengths) + 1, np.int64)
    at = np.flatnonzero(long)
    change[at] += 1
    np.subtract.at(change, at + lengths[at], 1)
    return np.diff(np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])[first])


def _measurer(least: int):
    def measure(batches):
        for batch in batches:
            for begin, data, offsets in tb.slices(batch.column(1)):
                n = len(offsets) - 1
                start, end, first = tb.split(data, offsets)
                total = lambda marks, at: np.diff(np.concatenate([[0], np.cumsum(marks)])[at])
                lengths = longest_repeats(tb.word_hashes(data, start, end, fold=False), first)
                longest = np.zeros(n, np.int64)
                some = np.flatnonzero(np.diff(first))
                if len(some):
                    longest[some] = np.maximum.reduceat(lengths, first[some])
                breaks = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
                lines, ends = breaks[:-1], breaks[1:].copy()
                ends -= data[ends - 1] == 10 if len(ends) else 0
                ends = np.maximum(ends, lines)
                spoken = np.diff(np.searchsorted(start, breaks)) > 0
                lines, ends = lines[spoken], ends[spoken]
                owner = np.searchsorted(offsets, lines, "right") - 1
                _, each = tb.distinct(tb.word_hashes(data, lines, ends, fold=False), owner, n)
                repeated = np.bincount(owner, minlength=n) - np.diff(each)
                points = tb.SPACED[data] & ((data & 0xC0) != 0x80)
                columns = [np.diff(first), total(points, offsets), total(_SYMBOL[data], offsets), repeated, covered(first, np.minimum(lengths, 5), 5), covered(first, lengths, least), longest]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, n), *(pa.array(x.astype(np.int64)) for x in columns)], ["doc_id", *MEASURES])

    return measure


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def quality_rules(docs: DataFrame, repeat_words: int = REPEAT_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """doc_id, the measures, base_failed and kept; a row for each row of docs (doc_id, text; further columns are ignored).

    Words lie between white space. word_chars: code points in words; n_symbols: characters of # * $ % & | < >;
    n_dup_lines: lines with a word that equal an earlier one; n_repeat_words: words in windows of five that occur twice
    or more in the text; covered_words: words in the union of all maximal repeated substrings of at least repeat_words
    words; longest_repeat: words of the longest one. base_failed: under 10 words, or over 20 % n_repeat_words. kept:
    not base_failed, at most max_covered of the words covered, and no repeat over max_longest words.

    A null text counts as an empty one, and fails. Repeats may overlap. Texts are measured where they lie: nothing is
    shuffled, and memory grows with the longest single text only.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = in_python(texts, _measurer(repeat_words), "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest))


_WINDOWS = "SELECT r, i, array_to_string(w[i:i + {k} - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM d WHERE len(w) >= {k})"
_TWICE = "SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM x{k}) WHERE n > 1"
#: A maximal repeat of at least k words is made of windows of k words that occur twice; the longest one is the longest run of equal windows on one diagonal.
ORACLE_SQL = (
    r"WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), "
    + ", ".join(f"x{k} AS ({_WINDOWS.format(k=k)})" for k in (1, 2, 3, 4, 5, 10))
    + "".join(f", s{k} AS (SELECT DISTINCT r FROM ({_TWICE.format(k=k)}))" for k in (1, 2, 3, 4))
    + "".join(f", c{k} AS (SELECT r, count(DISTINCT p) AS n{k} FROM (SELECT r, unnest(range(i, i + {k})) AS p FROM ({_TWICE.format(k=k)})) GROUP BY r)" for k in (5, 10))
    + r""", y AS (SELECT a.r AS r, a.i AS i, b.i - a.i AS apart FROM x5 a JOIN x5 b ON a.r = b.r AND a.g = b.g AND a.i < b.i),
m AS (SELECT r, max(n) + 4 AS longest FROM (SELECT r, count(*) AS n FROM (SELECT r, apart, i - row_number() OVER (PARTITION BY r, apart ORDER BY i) AS run FROM y) GROUP BY r, apart, run) GROUP BY r),
v AS (SELECT d.r AS r, doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
 coalesce(n5, 0) AS n_repeat_words, coalesce(n10, 0) AS covered_words, coalesce(longest, CASE WHEN d.r IN (SELECT r FROM s4) THEN 4 WHEN d.r IN (SELECT r FROM s3) THEN 3 WHEN d.r IN (SELECT r FROM s2) THEN 2 WHEN d.r IN (SELECT r FROM s1) THEN 1 ELSE 0 END) AS longest_repeat
 FROM d LEFT JOIN c5 ON c5.r = d.r LEFT JOIN c10 ON c10.r = d.r LEFT JOIN m ON m.r = d.r),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM v)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
CAST(covered_words AS BIGINT) AS covered_words, CAST(longest_repeat AS BIGINT) AS longest_repeat, base_failed, NOT base_failed AND covered_words <= 0.15::DOUBLE * n_words AND longest_repeat <= 100 AS kept FROM f"""
)
