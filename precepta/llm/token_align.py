"""Alignment of two tokenizers over a corpus: groups and links of tokens, and how often each pair of ids is linked."""

from __future__ import annotations

import json
import math
import os
import uuid
from functools import lru_cache
from hashlib import sha256
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precepta.llm.common import cut, forget, in_python, shared_folder
from precepta.llm.token_counts import PATTERN

#: The vocabularies: a byte-level one as JSON, and a piece model.
BYTE_VOCABULARY, PIECE_MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: A pair of ids is one key: the piece's id, then so many bits of the byte-level token's id.
BITS = 32
#: Pairs that a task holds before it sums them up, those of a shard at most, and the fewest shards of a sort that is dealt no wider.
HELD, SHARD, SHARDS = 1 << 21, 1 << 22, 32
LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoders:
    """Both tokenizers, the bytes of their tokens, and the decimal text of ids."""

    def __init__(self, vocabulary: bytes, model: bytes):
        import sentencepiece
        import tiktoken

        read, letters = json.loads(vocabulary), _byte_letters()
        added = {t["content"] for t in read["added_tokens"]}
        ids = {t: i for t, i in read["model"]["vocab"].items() if t not in added}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in ids.items()}
        merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in read["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the vocabulary's merges aren't in the order of their ids")
        self.of_bytes = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.of_pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a[i] = token
        self.b = [self._piece(i) for i in range(self.of_pieces.get_piece_size())]
        self.a_length, self.b_length = (np.array([len(t) for t in tokens], np.int64) for tokens in (self.a, self.b))
        self.decimal = [f"{i}{mark}".encode() for i in range(max(len(self.a), len(self.b))) for mark in ",|;"]

    def _piece(self, i: int) -> bytes:
        piece = self.of_pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.of_pieces.is_byte(i) else piece.replace("▁", " ").encode()


@lru_cache(maxsize=2)
def _encoders(vocabulary: bytes, model: bytes) -> Encoders:
    return Encoders(vocabulary, model)


def linked(text: str | None, by: Encoders) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(ids of A, ids of B, A's token of each link, B's token of each link); None if the tokens of text don't give its bytes.

    Two tokens whose bytes overlap share one run of bytes without an end of either side inside, so links are the places
    where either side ends.
    """
    if not text:
        return None
    whole = " " + text
    data, of_a, of_b = whole.encode(), by.of_bytes.encode_ordinary(whole), by.of_pieces.encode(text)
    if b"".join(map(by.a.__getitem__, of_a)) != data or b"".join(map(by.b.__getitem__, of_b)) != data:
        return None
    a, b = np.array(of_a, np.int64), np.array(of_b, np.int64)
    a_ends, b_ends = np.cumsum(by.a_length[a]), np.cumsum(by.b_length[b])
    ends = np.zeros(len(data) + 1, bool)
    ends[a_ends] = ends[b_ends] = True
    at = np.flatnonzero(ends)
    return a, b, np.searchsorted(a_ends, at), np.searchsorted(b_ends, at)


def group_text(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, by: Encoders) -> tuple[int, bytes]:
    """(number of groups, their text): a group ends with a link that ends a token of both sides."""
    a_last, b_last = np.append(np.flatnonzero(np.diff(of_a)), len(of_a) - 1), np.append(np.flatnonzero(np.diff(of_b)), len(of_b) - 1)
    common = np.zeros(len(of_a), np.int64)
    common[a_last] += 1
    common[b_last] += 1
    common //= 2
    group = np.cumsum(common) - common
    a_group, b_group = group[a_last], group[b_last]
    n = int(common.sum())
    a_count, b_count = np.cumsum(np.bincount(a_group, minlength=n)), np.cumsum(np.bincount(b_group, minlength=n))
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + np.append(0, b_count)[a_group]] = 3 * a + common[a_last]
    codes[np.arange(len(b)) + a_count[b_group]] = 3 * b + 2 * common[b_last]
    return n, b"".join(map(by.decimal.__getitem__, codes.tolist()))[:-1]


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def _packed(values: np.ndarray) -> bytes:
    """Values from 0 on, in the fewest bytes of one width; the width stands first."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << min(8 * w, 63))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


def _pairs(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Ordered keys as two packed columns: steps of the upper ids, and the lower ids."""
    upper = keys >> BITS
    return _packed(np.diff(upper, prepend=0)), _packed(keys & ((1 << BITS) - 1))


def _keys(pairs: bytes) -> np.ndarray:
    n = int.from_bytes(pairs[:8], "little")
    return (np.cumsum(_unpacked(pairs[8 : 8 + n])) << BITS) | _unpacked(pairs[8 + n :])


def _linker(vocabulary, model):
    def link(batches):
        by = _encoders(vocabulary.value, model.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                ids, rows = batch.column(0).slice(begin, 256), []
                for text in batch.column(1).slice(begin, 256):
                    found = linked(text.as_py(), by)
                    if found is None:
                        rows.append((0, 0, 0, 0, "", b"", b""))
                        continue
                    a, b, of_a, of_b = found
                    n, named = group_text(a, b, of_a, of_b, by)
                    keys, times = np.unique((b[of_b] << BITS) | a[of_a], return_counts=True)
                    upper, lower = _pairs(keys)
                    rows.append((len(a), len(b), n, len(of_a), sha256(named).hexdigest(), len(upper).to_bytes(8, "little") + upper + lower, _packed(times)))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return link


def _counted(keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], ["key", "n"])


def partial_counts(batches):
    """(key, n) of the pairs of a partition, summed up whenever HELD of them have come together."""
    held, size = [], 0
    for batch in batches:
        for pairs, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.append((_keys(pairs), _unpacked(times)))
            size += len(held[-1][0])
            if size >= HELD:
                held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if 2 * size >= HELD:
                    yield _counted(*held[0])
                    held, size = [], 0
    if held:
        yield _counted(*_summed(*map(np.concatenate, zip(*held, strict=True))))


def run_lengths(batches):
    """(key, n) of ordered (key, n) with equal keys summed up; a run may go on in the next batch."""
    last = None
    for batch in batches:
        keys, times = _summed(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))
        if not len(keys):
            continue
        if last and last[0] == keys[0]:
            times[0] += last[1]
        elif last:
            yield _counted(*(np.array([x], np.int64) for x in last))
        last = int(keys[-1]), int(times[-1])
        yield _counted(keys[:-1], times[:-1])
    if last:
        yield _counted(*(np.array([x], np.int64) for x in last))


def _shards(batches):
    """Rows (shard): keys and their counts as raw bytes, SHARD of them at most, in the order of keys; of one range (part) each."""
    held, size, own = [], 0, None
    for batch in batches:
        keys, times, parts = (batch.column(i).to_numpy(zero_copy_only=False).astype("<i8") for i in range(3))
        edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(keys)]
        for begin, end in zip(edges, edges[1:]):
            if begin == end:
                continue
            if held and (parts[begin] != own or size + end - begin > SHARD):
                yield _as_bytes(held)
                held, size = [], 0
            held.append((keys[begin:end], times[begin:end]))
            size, own = size + end - begin, parts[begin]
    if held:
        yield _as_bytes(held)


def _as_bytes(held) -> pa.RecordBatch:
    raw = b"".join(x.tobytes() for x in chain.from_iterable(zip(*held, strict=True)))
    return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["shard"])


@lru_cache(maxsize=2)
def _mapped(names: tuple[str, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of each shard, mapped into memory, in the order of keys."""
    out = []
    for name in names:
        path = SparkFiles.get(name)
        n = os.path.getsize(path) // 16
        if n:
            out.append(tuple(np.memmap(path, "<i8", "r", 8 * n * i, (n,)) for i in (0, 1)))
    return sorted(out, key=lambda x: x[0][0])


def _looker(names: tuple[str, ...], best):
    def look(batches):
        shards, most = _mapped(names), best.value
        lows = np.array([int(k[0]) for k, _ in shards], np.int64)
        for batch in batches:
            n_best, sums = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, (pairs, times) in enumerate(zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)):
                if not pairs:
                    continue
                keys, times = _keys(pairs), _unpacked(times)
                found, edges = np.empty(len(keys), np.int64), np.append(np.searchsorted(keys, lows[1:]), len(keys))
                begin = 0
                for (known, counts), end in zip(shards, edges.tolist(), strict=True):
                    if end > begin:
                        found[begin:end] = counts[np.searchsorted(known, keys[begin:end])]
                        begin = end
                n_best[row] = times[found == most[keys >> BITS]].sum()
                sums[row] = (times * found).sum()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(n_best), pa.array(sums)], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])

    return look


def pair_counts(links: DataFrame) -> DataFrame:
    """(key, n, part) of all linked pairs of ids, in order, by parts that hold ranges of keys: partial counts, sorted globally, runs summed up."""
    partial = cut(in_python(links.where("n_links > 0").select("pairs", "times"), partial_counts, "key long, n long"))
    wide = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(min(wide, SHARDS), math.ceil(partial.count() / SHARD))
    summed = in_python(partial.repartitionByRange(parts, "key").sortWithinPartitions("key"), run_lengths, "key long, n long")
    counted = cut(summed.withColumn("part", F.spark_partition_id()))
    forget(partial)
    return counted


def aligned_tokens(docs: DataFrame, vocabulary: str = BYTE_VOCABULARY, model: str = PIECE_MODEL) -> DataFrame:
    """How the tokens of two vocabularies meet in each text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    docs has doc_id (long) and text. A text behind a blank is encoded by the byte-level vocabulary (A), and the text by the
    piece model (B), which adds that blank. Places where tokens of both end cut them into groups; tokens whose bytes
    overlap are linked. A pair of ids counts as often as it is linked in all texts; n_best are the links whose pair counts
    as much as any of its B id, count_sum adds up the counts of all links. groups_sha256 is of `a1,a2|b1;a3|b2,b3`.

    Each text is encoded once, and its distinct pairs are kept as packed keys. Partial counts of partitions are sorted
    globally by ranges of keys and runs summed up. The counts become shards of raw ordered keys, which Spark sends to each
    executor once, as files; tasks map them into memory and search them, so that no task holds them all and no text is
    shuffled. The most that a B id has is a row for each id, so vocabularies bound it; they too are read on the driver.

    Null and empty texts, and texts whose tokens don't give their bytes (as where a model changes characters), have no
    tokens: zeros, and an empty groups_sha256. Repeated rows and null ids count each. Further columns are ignored; an empty
    table gives an empty result. Shards stay in the folder of spark.checkpoint.dir, for executors that come later.
    """
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    links = cut(in_python(texts, _linker(send(Path(vocabulary).read_bytes()), send(Path(model).read_bytes())), LINKED))
    counted = pair_counts(links)
    best = counted.groupBy(F.shiftright("key", BITS).alias("b")).agg(F.max("n").alias("n")).toArrow()
    most = np.zeros(max(best["b"].to_pylist(), default=0) + 1, np.int64)
    most[best["b"].to_numpy()] = best["n"].to_numpy()
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    in_python(counted, _shards, "shard binary").select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = [f.getPath() for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place) if f.getPath().getName().startswith("part-")]
    for file in files:
        spark.sparkContext.addFile(file.toString())
    forget(counted)
    return in_python(links, _looker(tuple(sorted(f.getName() for f in files)), send(most)), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
