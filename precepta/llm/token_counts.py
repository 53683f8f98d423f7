"""Token counts of sections, from whole documents that are encoded once."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precepta.llm import textbytes as tb
from precepta.llm.common import in_python

#: A vocabulary of token bytes in base 64 and ranks, and the pattern of the pieces that are encoded apart.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "share")


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes, pattern: str):
    """(encoding, bytes of each token) of a vocabulary file's content; kept in each worker."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_ends(text: str, vocabulary: bytes, pattern: str = PATTERN) -> np.ndarray:
    """Where each token of text ends, in bytes of UTF-8. The tokens of a text are its bytes in order, without gaps."""
    encoding, lengths = _encoding(vocabulary, pattern)
    return np.cumsum(lengths[encoding.encode_ordinary(text)]) if text else np.zeros(0, np.int64)


def attribute(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section starts[i]:stops[i], in bytes, ordered and apart from each other.

    first: a token belongs to the section that has its first byte; last: its last byte; share: to each by its bytes in
    it. A token that lies in no section so is counted nowhere. Crossing tokens reach into a section but lie partly
    outside.
    """
    n = len(starts)
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    if not n or not len(ends):
        return np.zeros(n), np.zeros(n, np.int64)
    if rule == "share":
        # token bytes up to a place: whole tokens and a part of the one that lies there
        upto = lambda at: (i := np.minimum(np.searchsorted(ends, at, "right"), len(ends) - 1)) + np.clip((at - begins[i]) / (ends[i] - begins[i]), 0, 1)
        counts = upto(stops) - upto(starts)
    else:
        at = begins if rule == "first" else ends - 1
        i = np.searchsorted(starts, at, "right") - 1
        counts = np.bincount(i[(i >= 0) & (at < stops[i])], minlength=n).astype(float)
    cut_at = lambda at: (at > 0) & (at < ends[-1]) & (ends[np.minimum(np.searchsorted(ends, at, "left"), len(ends) - 1)] != at)
    low, high = np.searchsorted(ends, starts, "right"), np.searchsorted(ends, stops, "left")
    filled = stops > starts
    both = filled & cut_at(starts) & cut_at(stops) & (low == high)
    return counts, ((filled & cut_at(starts)).astype(np.int64) + (filled & cut_at(stops)) - both)


def _line_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.concatenate([[0], np.flatnonzero(data == 10) + 1, [len(data)]])
    edges = np.unique(edges)
    return (edges[:-1], edges[1:]) if len(data) else (np.zeros(1, np.int64), np.zeros(1, np.int64))


def _counter(vocabulary, pattern: str, rule: str, given: bool):
    def count(batches):
        content = vocabulary.value
        for batch in batches:
            for begin, data, offsets in tb.slices(batch.column(1)):
                n = len(offsets) - 1
                columns: list[list[np.ndarray]] = [[] for _ in range(6)]
                spans = batch.column(2).slice(begin, n).to_pylist() if given else None
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                for k in range(n):
                    own = data[offsets[k] : offsets[k + 1]]
                    ends = token_ends(own.tobytes().decode(), content, pattern)
                    if given:
                        listed = sorted((s["start"], s["stop"], s["section"]) for s in spans[k] or [])
                        chars = np.array([x[:2] for x in listed], np.int64).reshape(-1, 2)
                        names = np.array([x[2] for x in listed], np.int64)
                        at = np.append(np.flatnonzero((own & 0xC0) != 0x80), len(own))
                        starts, stops = (at[np.clip(chars[:, i], 0, len(at) - 1)] for i in (0, 1))
                    else:
                        starts, stops = _line_spans(own)
                        chars = np.stack([points[offsets[k] + x] - points[offsets[k]] for x in (starts, stops)], axis=1)
                        names = np.arange(len(starts))
                    counts, crossing = attribute(ends, starts, stops, rule)
                    for into, values in zip(columns, (np.full(len(names), k), names, chars[:, 0], chars[:, 1], counts, crossing), strict=True):
                        into.append(values)
                joined = [np.concatenate(x) if x else np.zeros(0) for x in columns]
                ids = batch.column(0).slice(begin, n).take(pa.array(joined[0].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int64)) for x in joined[1:4]), pa.array(joined[4].astype(float)), pa.array(joined[5].astype(np.int64))], ["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"])

    return count


def section_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, rule: str = "first", sections: DataFrame | None = None) -> DataFrame:
    """Tokens of each section of each document: doc_id, section, start, stop, n_tokens, n_crossing.

    docs has doc_id (long) and text. Sections are its lines, each with its line feed, numbered from 0 on, or those of
    sections (doc_id, section, start, stop: characters, of one document apart from each other). A whole text is encoded
    once with the byte-level vocabulary of the named file; its tokens are joined to the sections by their spans, and one
    that crosses a boundary is allocated by the rule (see attribute): by default to the section it begins in. So over
    lines the counts of a document add up to its tokens, which counting line by line would not give.

    Null and empty texts have one section without tokens (of lines; none of given sections). Repeated rows and null ids
    are each counted; given sections of unknown documents are ignored, bounds behind a text's end are moved to it.
    Further columns are ignored; an empty table gives an empty result. The vocabulary, of fixed size, is read on the
    driver and broadcast. Texts are not shuffled, unless sections are given.
    """
    if rule not in RULES:
        raise ValueError(f"rule is none of {RULES}: {rule}")
    content = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if sections is not None:
        fields = [F.col(c).cast("long").alias(c) for c in ("section", "start", "stop")]
        texts = texts.join(sections.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(F.struct(*fields)).alias("spans")), "doc_id", "left")
    return in_python(texts, _counter(content, pattern, rule, sections is not None), "doc_id long, section long, start long, stop long, n_tokens double, n_crossing long")
