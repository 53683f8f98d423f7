"""Phrase collocations by position bitmaps: words' bitmaps are shifted, intersected and counted, depth first."""

from __future__ import annotations

from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precepta.llm import textbytes as tb
from precepta.llm.common import checked_broadcast, cut, forget, in_python

#: Words of a phrase at most, occurrences at least, phrases of a language, and the share of a phrase's occurrences that a longer one takes over.
LONGEST, LEAST, BEST, COVERED = 3, 10, 2000, 50
#: Bits of the filters of frequent words and phrases, which are broadcast, so a fixed size; a filter that fills up prunes less, but never loses any.
FILTER_BITS = 1 << 26
#: A bitmap is kept as its bytes that aren't empty, so of eight positions each. Intersections that are worked on at a time.
BLOCK, CHUNK = 8, 1 << 21
#: Parts that a language's phrases are ranked in before the best of all parts are.
PARTS = 64
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD, _ENDS = np.ones(256, bool), np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD[list(b" \t")] = False
_WORD &= ~_ENDS
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _lang_hash(lang: str, seed: int) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8, salt=seed.to_bytes(4, "little")).digest(), "little")


def _shards(batches, seed: int):
    """(bytes, start, end, hash, position, row of the batch, batch) of the words of slices of texts.

    Hashes are of a word and its text's language. Between two pieces a position stays empty, so that nothing extends over it.
    """
    for batch in batches:
        langs = batch.column(1).dictionary_encode()
        named = np.array([_lang_hash(x, seed) for x in langs.dictionary.to_pylist()], np.uint64)
        of_row = langs.indices.to_numpy(zero_copy_only=False)
        for begin, data, offsets in tb.slices(batch.column(0)):
            start, end, first = tb.split(data, offsets, _WORD)
            if not len(start):
                continue
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            piece = np.cumsum(_ENDS[data])[start] + text
            position = np.arange(len(start)) + np.cumsum(np.diff(piece, prepend=piece[0]) > 0)
            hashes = tb.mix(tb.word_hashes(data, start, end) ^ named[of_row[begin + text]])
            yield data, start, end, hashes, position, begin + text, batch


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The lower-cased words as strings."""
    ends = np.cumsum(end - start)
    at = np.arange(ends[-1]) - np.repeat(ends - (end - start), end - start) + np.repeat(start, end - start)
    kind = np.int32 if ends[-1] < 1 << 31 else np.int64
    return (pa.StringArray if kind == np.int32 else pa.LargeStringArray).from_buffers(len(ends), pa.py_buffer(np.append(0, ends).astype(kind)), pa.py_buffer(_LOWER[data[at]])).cast(pa.string())


def _word_counter(seed: int):
    def words(batches):
        for data, start, end, hashes, _, row, batch in _shards(batches, seed):
            found, at, n = np.unique(hashes, return_index=True, return_counts=True)
            langs = batch.column(1).take(pa.array(row[at]))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), langs, _strings(data, start[at], end[at]), pa.array(n)], ["h", "lang", "word", "n"])

    return words


def chained(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each phrase, of the hashes of its words."""
    out = columns[0]
    for c in columns[1:]:
        out = tb.mix(out * _ODD + c)
    return out


def _among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(FILTER_BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


class Bitmaps:
    """The bitmaps of a shard's frequent words, as entries (word, block, mask) ordered by block."""

    def __init__(self, hashes: np.ndarray, position: np.ndarray):
        self.names, word = np.unique(hashes, return_inverse=True)
        key = position // BLOCK * len(self.names) + word
        order = np.argsort(key, kind="stable")
        key, mask = key[order], np.left_shift(1, position % BLOCK).astype(np.uint8)[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.block, self.word = key[first] // max(len(self.names), 1), key[first] % max(len(self.names), 1)
        self.mask = np.bitwise_or.reduceat(mask, first) if len(first) else mask

    def extended(self, phrase: np.ndarray, block: np.ndarray, mask: np.ndarray):
        """(phrase, word, block, mask) of the places where a word follows a phrase, for phrases' entries, in chunks.

        A phrase's bitmap, of the places of its last words, is shifted by one position, into the next byte where need be,
        and intersected with the words that have bits in that byte.
        """
        carried = mask >= 1 << (BLOCK - 1)
        phrase, block = np.append(phrase, phrase[carried]), np.append(block, block[carried] + 1)
        mask = np.append((mask << 1).astype(np.uint8), np.ones(carried.sum(), np.uint8))
        phrase, block, mask = (x[mask > 0] for x in (phrase, block, mask))
        low, high = np.searchsorted(self.block, block), np.searchsorted(self.block, block, "right")
        upto = np.cumsum(high - low)
        begin = 0
        while begin < len(phrase):
            done = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, done + CHUNK, "right")))
            width = (high - low)[begin:end]
            of = np.repeat(np.arange(begin, end), width)
            at = np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width) + low[of]
            both = mask[of] & self.mask[at]
            hit = both > 0
            yield phrase[of[hit]], self.word[at[hit]], block[of[hit]], both[hit]
            begin = end

    def phrases(self, longest: int, filters: list[np.ndarray]):
        """(hashes of the words of phrases of `longest` words, popcounts), depth first; filters: those of the phrases of fewer words, by words from 2 on."""
        order = np.argsort(self.word, kind="stable")
        yield from self._deepen([np.arange(len(self.names))], self.word[order], self.block[order], self.mask[order], longest, filters)

    def _deepen(self, columns, phrase, block, mask, longest, filters):
        depth = len(columns) + 1
        for longer, word, at, both in self.extended(phrase, block, mask):
            key = longer * len(self.names) + word
            order = np.argsort(key, kind="stable")
            key, at, both = key[order], at[order], both[order]
            new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            if not len(first):
                continue
            below, last = key[first] // len(self.names), key[first] % len(self.names)
            own = [*(c[below] for c in columns), last]
            # a phrase can be frequent only if that without its first word is, and that without its last, which was asked before
            keep = np.ones(len(first), bool) if depth == 2 else _among(filters[depth - 3], chained([self.names[c] for c in own[1:]]))
            if depth == longest:
                n = np.add.reduceat(np.bitwise_count(both).astype(np.int64), first)
                yield [self.names[c[keep]] for c in own], n[keep]
                continue
            keep &= _among(filters[depth - 2], chained([self.names[c] for c in own]))
            number = np.cumsum(keep) - 1
            of = np.cumsum(new) - 1
            entries = keep[of]
            yield from self._deepen([c[keep] for c in own], number[of[entries]], at[entries], both[entries], longest, filters)


def _phrase_counter(longest: int, frequent, filters: list, seed: int):
    names = [f"h{i + 1}" for i in range(longest)]

    def phrases(batches):
        bits, others = frequent.value, [f.value for f in filters]
        for _, _, _, hashes, position, _, _ in _shards(batches, seed):
            kept = _among(bits, hashes)
            for columns, n in Bitmaps(hashes[kept], position[kept]).phrases(longest, others):
                yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(n)], [*names, "n"])

    return phrases


def _filter(counted: DataFrame, columns: list[str]):
    """A broadcast bit table of the phrases of counted; as large for any number of them."""
    def marked(batches):
        for batch in batches:
            at = chained([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]) & np.uint64(FILTER_BITS - 1)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["at", "bit"])

    rows = in_python(counted.select(*columns), marked, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[rows["at"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)
    return counted.sparkSession.sparkContext.broadcast(bits)


def word_counts(texts: DataFrame) -> tuple[DataFrame, int]:
    """((h, lang, word, n, ...) of all words of texts (text, lang), the seed of their hashes): one under which no two words meet."""
    for seed in count():
        found = in_python(texts, _word_counter(seed), "h long, lang string, word string, n long").groupBy("h")
        words = cut(found.agg(F.min("lang").alias("lang"), F.max("lang").alias("other"), F.min("word").alias("word"), F.max("word").alias("second"), F.sum("n").alias("n")))
        if words.where("lang != other OR word != second").isEmpty():
            return words, seed
        forget(words)


def phrase_counts(texts: DataFrame, words: DataFrame, seed: int, longest: int = LONGEST, least: int = LEAST) -> list[DataFrame]:
    """[(h1, h2, n), (h1, h2, h3, n), ...]: phrases that occur `least` times, by the hashes of their words."""
    frequent, filters, out = _filter(words.where(F.col("n") >= least), ["h"]), [], []
    for size in range(2, longest + 1):
        names = [f"h{i + 1}" for i in range(size)]
        found = in_python(texts, _phrase_counter(size, frequent, filters, seed), ", ".join(f"{n} long" for n in [*names, "n"]))
        out.append(cut(found.groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least)))
        if size < longest:
            filters = [*filters, _filter(out[-1], names)]
    return out


def _scored(levels: list[DataFrame], size: int) -> DataFrame:
    """The phrases of `size` words with lang, phrase, a, and l, r and score of their lowest-scoring cut."""
    names = [f"h{i + 1}" for i in range(size)]
    out = levels[size - 1].withColumnRenamed("n", "a")
    for begin in range(size):
        for end in range(begin + 1, size + 1):
            part = levels[end - begin - 1]
            if end - begin == size or end - begin > 1 and 0 < begin and end < size:
                continue
            own = [F.col(f"h{i + 1}").alias(names[begin + i]) for i in range(end - begin)]
            words = [F.col("word").alias(f"word{begin}")] if end - begin == 1 else []
            extra = ["lang"] if (begin, end) == (0, 1) else []
            out = out.join(part.select(*own, *extra, *words, F.col("n").alias(f"n{begin}_{end}")), names[begin:end])
    product = lambda k: f"cast(n0_{k} as decimal(19, 0)) * cast(n{k}_{size} as decimal(19, 0))"
    cuts = [f"struct(cast((cast(a as decimal(19, 0)) * a * 1000000) div ({product(k)}) as long) AS score, {k} AS k, n0_{k} AS l, n{k}_{size} AS r)" for k in range(1, size)]
    lowest = F.expr(f"array_min(array({', '.join(cuts)}))")
    phrase = F.concat_ws(" ", *[f"word{i}" for i in range(size)])
    return out.select(*names, "lang", phrase.alias("phrase"), "a", lowest.alias("cut")).select(*names, "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _without_covered(scored: DataFrame, size: int, levels: list[DataFrame], covered: int) -> DataFrame:
    """scored without phrases of which a longer one that holds them has `covered` hundredths of the occurrences."""
    names, longer = [f"h{i + 1}" for i in range(size)], None
    for level in range(size + 1, len(levels) + 1):
        for begin in range(level - size + 1):
            held = levels[level - 1].select(*[F.col(f"h{begin + i + 1}").alias(names[i]) for i in range(size)], "n")
            longer = held if longer is None else longer.union(held)
    if longer is None:
        return scored
    joined = scored.join(longer.groupBy(*names).agg(F.max("n").alias("longer")), names, "left")
    return joined.where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, best: int = BEST, covered: int = COVERED) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    docs has text and lang (null: und). Texts (null: empty) are lower-cased (A-Z), cut into pieces at [.,;:!?] and line
    ends, and these into words between blanks and tabs. All is counted for each language: n all words, a a phrase of 2 to
    `longest` words, wherever it stands inside a piece. Of a phrase's cuts in two, found l and r times, that of the lowest
    floor(1000000 a a / (l r)) counts, on ties the first. Phrases found fewer than `least` times are none; one that lies in
    a longer phrase with `covered` hundredths of its occurrences is dropped.

    Slices of texts are shards: the positions of a frequent word are a bitmap, kept as its bytes that aren't empty; a
    phrase's bitmap, shifted by one position and intersected with those of words, gives longer phrases, and popcounts,
    depth first, their occurrences. Popcounts of all shards are summed up, a level of lengths at a time, as a phrase can be
    frequent only if its parts are; which are is told to the shards by bit tables of fixed size, which may let others
    pass, but lose none. Counts are keyed by 64-bit hashes of words; should two words share one, others are taken.

    Empty texts have no words. Repeated rows count each; doc_id and further columns are ignored; an empty table gives an
    empty result. Ranks are by score, then a, then the phrase's bytes, first in parts of a language.
    """
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    words, seed = word_counts(texts)
    counted = phrase_counts(texts, words, seed, longest, least)
    totals = cut(words.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = words.where(F.col("n") >= least).select(F.col("h").alias("h1"), "lang", "word", "n")
    levels = [checked_broadcast(frequent), *counted]
    found = None
    for size in range(2, longest + 1):
        own = _without_covered(_scored(levels, size), size, levels, covered).select("lang", "phrase", "a", "l", "r", "score")
        found = own if found is None else found.union(own)
    found = cut(found.withColumn("bucket", F.floor(50 * F.log2(F.col("score") + 1)).cast("int")))
    forget(words, *counted)
    # of each language, the scores from which on there are enough: a table of at most a thousand buckets
    over = Window.partitionBy("lang").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = found.groupBy("lang", "bucket").count().withColumn("before", F.coalesce(F.sum("count").over(over), F.lit(0)))
    lowest = buckets.where(F.col("before") < best).groupBy("lang").agg(F.min("bucket").alias("lowest"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    near = found.join(lowest, "lang").where("bucket >= lowest").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= best)
    top = ranked(ranked(near, "lang", "part"), "lang")
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same by counting n-grams of pieces.
ORACLE_SQL = r"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, row_number() OVER () AS t, p.i, string_split_regex(p.piece, '[ 	]+') AS ws FROM (
    SELECT lang, UNNEST(list_transform(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]'),
      lambda x, i: {'piece': x, 'i': i})) AS p FROM documents)),
w AS (SELECT lang, list_filter(ws, lambda x: x <> '') AS ws FROM pieces),
f AS (SELECT lang, 1 AS k, UNNEST(list_transform(ws, lambda x: [x])) AS g FROM w
  UNION ALL SELECT lang, 2, UNNEST(list_transform(range(1, len(ws)), lambda i: ws[i:i + 1])) FROM w WHERE len(ws) > 1
  UNION ALL SELECT lang, 3, UNNEST(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) FROM w WHERE len(ws) > 2),
c AS (SELECT lang, k, g, count(*)::HUGEINT AS a FROM f GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, count(*) AS n FROM f WHERE k = 1 GROUP BY lang),
cuts AS (SELECT x.lang, x.k, x.g, x.a, j.k AS place, l.a AS l, r.a AS r, (1000000 * x.a * x.a) // (l.a * r.a) AS score
  FROM c x JOIN (VALUES (1), (2)) j(k) ON j.k < x.k JOIN c l ON l.lang = x.lang AND l.g = x.g[1:j.k] JOIN c r ON r.lang = x.lang AND r.g = x.g[j.k + 1:x.k]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, place) = 1),
longer AS (SELECT lang, g[s:s + 1] AS g, max(a) AS a FROM c, (VALUES (1), (2)) p(s) WHERE k = 3 GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.g = b.g WHERE b.k = 3 OR o.a IS NULL OR 100 * o.a < 50 * b.a),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase FROM kept)
SELECT ranked.lang, row_number() OVER (PARTITION BY ranked.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) QUALIFY rank <= 2000
"""
