"""Removal of passages that repeat anywhere in the corpus, by hashed runs of consecutive sentences."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from precepta.llm import textbytes as tb
from precepta.llm.common import cut, in_python

#: A run is the fewest consecutive sentences, but at least two, that have so many words together.
RUN_SENTENCES, RUN_WORDS = 2, 20
#: Inside a sentence, the least hash of each window of half so many words ends a clause, which counts as a sentence of its own.
CLAUSE_EVERY = 16

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def _clause_ends(words: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash, the last of equal ones, of each window of so many words that no sentence end divides."""
    n = len(words) - window + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least, at = words[:n].copy(), np.arange(n)
    for k in range(1, window):
        lower = words[k : k + n] <= least
        least[lower] = words[k : k + n][lower]
        at[lower] = np.flatnonzero(lower) + k
    sentence = np.cumsum(last) - last
    return at[sentence[:n] == sentence[window - 1 :]]


def sentences(data: np.ndarray, offsets: np.ndarray, clause_every: int = CLAUSE_EVERY):
    """(first byte, hash, words, first) of the sentences of a slice of texts.

    A sentence ends with a word that ends in . ! or ?, before a line feed, or at a clause end (see _clause_ends), so it
    has at most w = clause_every // 2 words. A clause end depends on fewer than w words to either side, so a passage falls
    into the same sentences wherever it stands, but for its first 2 w - 1 and its last w words at most. With w = 8 these
    leave a whole run of 20 to 27 words in every passage of over 50 words.
    """
    start, end, first = tb.split(data, offsets)
    if not len(start):
        return start, np.zeros(0, np.uint64), start, np.zeros(len(offsets), np.int64)
    words = tb.word_hashes(data, start, end)
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    last = np.ones(len(start), bool)
    last[:-1] = feeds[start[1:]] > feeds[end[:-1]]
    last |= _ENDS[data[end - 1]]
    last[first[1:][np.diff(first) > 0] - 1] = True
    last[_clause_ends(words, last, clause_every // 2)] = True
    begins = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    counts = np.diff(np.append(begins, len(start)))
    up, down = tb.powers(len(words) + 1)
    run = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=run[1:])
    hashes = tb.mix((run[begins + counts] - run[begins]) * down[begins] + counts.astype(np.uint64))
    return start[begins], hashes, counts, np.searchsorted(begins, first)


def runs(hashes: np.ndarray, counts: np.ndarray, first: np.ndarray, least: int, words: int):
    """(hash, first sentence, last sentence) of the run that begins at each sentence; none where the text ends before."""
    n = len(hashes)
    if not n:
        return hashes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(n)
    last = np.maximum(np.searchsorted(upto, upto[:-1] + words) - 1, at + least - 1)
    whole = last < np.repeat(first[1:], np.diff(first))
    at, last = at[whole], last[whole]
    up, down = tb.powers(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=run[1:])
    return tb.mix((run[last + 1] - run[at]) * down[at] + (last - at).astype(np.uint64)), at, last


def _earlier(keys: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Whether each key, in order of place, has stood before in its own text."""
    order = np.lexsort((keys, texts))
    before = np.zeros(len(keys), bool)
    before[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (texts[order[1:]] == texts[order[:-1]])
    return before


def _span_maker(least: int, words: int, clause_every: int):
    def spans(batches):
        for batch in batches:
            for begin, data, offsets in tb.slices(batch.column(1)):
                _, hashes, counts, first = sentences(data, offsets, clause_every)
                keys, at, _ = runs(hashes, counts, first, least, words)
                text = np.searchsorted(first, at, "right") - 1
                new = ~_earlier(keys, text)
                ids = batch.column(0).slice(begin, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), ids.take(pa.array(text[new]))], ["span", "doc_id"])

    return spans


def _remover(least: int, words: int, clause_every: int):
    def remove(batches):
        for batch in batches:
            for begin, data, offsets in tb.slices(batch.column(1)):
                starts, hashes, counts, first = sentences(data, offsets, clause_every)
                n = len(offsets) - 1
                keys, at, last = runs(hashes, counts, first, least, words)
                text = np.searchsorted(first, at, "right") - 1
                bad = _earlier(keys, text)
                known = batch.column(2).slice(begin, n)
                lengths = np.fromiter((len(x) if x.is_valid else 0 for x in known), np.int64, n)
                if lengths.any():
                    values = known.flatten().to_numpy().view(np.uint64)
                    mine = np.repeat(np.arange(n), lengths)
                    both = np.concatenate([values, keys]), np.concatenate([mine, text])
                    bad |= _earlier(*both)[len(values) :]
                change = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(change, at[bad], 1)
                np.subtract.at(change, last[bad] + 1, 1)
                gone = np.cumsum(change[:-1]) > 0
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
                texts = batch.column(1).slice(begin, n).to_pylist()
                for i in np.flatnonzero(removed):
                    mine = gone[first[i] : first[i + 1]]
                    edges = np.append(starts[first[i] : first[i + 1]], offsets[i + 1])
                    kept = data[offsets[i] : edges[0]].tobytes() + b"".join(data[edges[k] : edges[k + 1]].tobytes() for k in np.flatnonzero(~mine))
                    texts[i] = kept.decode().strip() if mine[-1] or mine[0] else kept.decode()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, n), pa.array(np.diff(first).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(texts, pa.string()), batch.column(3).slice(begin, n)], ["doc_id", "n_sentences", "n_removed", "text", "others"])

    return remove


def repeated_spans(docs: DataFrame, run_sentences: int = RUN_SENTENCES, run_words: int = RUN_WORDS, clause_every: int = CLAUSE_EVERY) -> DataFrame:
    """(doc_id, span): hashes of the runs of a document that occur in a document of smaller doc_id as well.

    Every run of the corpus is hashed, and the hashes are joined globally, each once for a document: a hash aggregate
    finds those of several documents and the first of these, and a shuffled join, whose hot keys adaptive execution
    splits, finds the other places. The runs are hashed twice, as that costs less than to keep them.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    spans = in_python(texts, _span_maker(run_sentences, run_words, clause_every), "span long, doc_id long")
    known = cut(spans.groupBy("span").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("span", "low"))
    return spans.join(known, "span").where("doc_id != low").select("doc_id", "span")


def substring_dedup(docs: DataFrame, run_sentences: int = RUN_SENTENCES, run_words: int = RUN_WORDS, clause_every: int = CLAUSE_EVERY, carry: Sequence[str] = ()) -> DataFrame:
    """Each document without its repeated passages: doc_id, n_sentences, n_removed, text; a row for each row of docs.

    docs has doc_id (long) and text; further columns are ignored, but those named in carry come in a struct, others. A sentence goes if any run of several consecutive
    sentences that covers it has occurred before, in a document of smaller doc_id or earlier in this one (words compared
    with A-Z lower-cased, white space alike). The rest stays byte for byte; if an end of the text went, it is trimmed.

    A null text stays null, with no sentences; texts shorter than a run stay as they are. A row of a null doc_id is held
    against no other: it loses only what it repeats itself. Rows that share a doc_id are one document: what another one
    has before goes in all of them, what they have in common stays. A text all of whose sentences go is empty. An empty
    table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(carry or [F.lit(None).cast("int").alias("none")])).alias("others"))
    spans = repeated_spans(texts, run_sentences, run_words, clause_every).groupBy("doc_id").agg(F.collect_set("span").alias("spans"))
    joined = texts.join(spans, "doc_id", "left").select("doc_id", "text", "spans", "others")
    schema = StructType.fromDDL("doc_id long, n_sentences long, n_removed long, text string").add("others", texts.schema["others"].dataType)
    cleaned = in_python(joined, _remover(run_sentences, run_words, clause_every), schema)
    return cleaned if carry else cleaned.drop("others")
