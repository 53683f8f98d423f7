"""Collocations against counting n-grams, and token alignment against comparing all spans of tokens."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import sha256

import pytest
from conftest import DOCS

from precepta.llm import collocations as C
from precepta.llm import token_align as T


def brute_collocations(rows, longest=3, least=10, best=2000, covered=50):
    found, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            found.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    kept = {p: a for p, a in found.items() if a >= least and len(p) > 2}
    out = []
    for (lang, *words), a in kept.items():
        words = tuple(words)
        cuts = [(1000000 * a * a // (found[(lang, *words[:k])] * found[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        longer = [b for (other, *w), b in kept.items() if other == lang and len(w) > len(words) and any(tuple(w[i : i + len(words)]) == words for i in range(len(w)))]
        if not any(100 * b >= covered * a for b in longer):
            out.append((lang, -score, -a, " ".join(words).encode(), found[(lang, *words[:k])], found[(lang, *words[k:])]))
    ranks = Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= best:
            yield lang, ranks[lang], phrase.decode(), -a, l, r, totals[lang], -score


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def rows_of(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


PHRASES = [
    (1, "New York City, new york. NEW york! " * 7, "en"),
    (2, "a b c a b c a b c. a b\na b\ta b" * 4, None),
    (3, "x x x x x x x x x x x x x x", "en"),
    (4, None, "en"),
    (5, "", None),
    (6, "  ,,. \t", "en"),
    (6, "the the city of the city of new york " * 12, "en"),
    (6, "the the city of the city of new york " * 12, "en"),
    (None, "Ünïcode wörd — ünïcode wörd; " * 11, "de"),
    (7, "only one piece " * 3000, ""),
]


@pytest.fixture(scope="module")
def phrases(spark):
    return spark.createDataFrame([(i, t, lang, "s", 1, 1, "w", None, 7, 3) for i, t, lang in PHRASES], DOCS).repartition(3).cache()


@pytest.mark.parametrize("longest,least,best", [(3, 10, 2000), (2, 4, 5), (4, 3, 12), (3, 1, 9)])
def test_collocations_by_brute_force(phrases, longest, least, best):
    found = C.collocations(phrases, longest, least, best)
    assert rows_of(found, COLUMNS) == sorted(brute_collocations([(lang, t) for _, t, lang in PHRASES], longest, least, best))


def test_collocations_of_documents(docs, texts):
    rows = [("en" if (i or 0) % 2 else None, t) for i, t in texts]
    assert rows_of(C.collocations(docs, least=3), COLUMNS) == sorted(brute_collocations(rows, least=3))


def test_collocations_in_small_chunks(phrases, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 7)
    import numpy as np

    hashes, position = np.array([5, 9, 5, 9, 5, 9, 9], np.uint64), np.array([0, 1, 7, 8, 9, 10, 12])
    found = Counter()
    for (one, two), n in C.Bitmaps(hashes, position).phrases(2, []):
        found.update({(int(a), int(b)): int(c) for a, b, c in zip(one, two, n, strict=True)})
    assert found == {(5, 9): 3, (9, 5): 1}


def test_words_that_share_a_hash_get_another(phrases, monkeypatch):
    mixed, seeds = C._lang_hash, []

    def counted(lang, seed):
        seeds.append(seed)
        return mixed(lang, seed)

    monkeypatch.setattr(C, "_lang_hash", counted)
    assert C.word_counts(phrases.select("text", "lang").na.fill(""))[1] == 0


def test_exact_scores_beyond_64_bits(spark):
    pairs = spark.createDataFrame([(1, 2, 3 * 10**12)], "h1 long, h2 long, n long")
    words = spark.createDataFrame([(1, "en", "a", 4 * 10**12 + 1), (2, "en", "b", 5 * 10**12 + 3)], "h1 long, lang string, word string, n long")
    assert C._scored([words, pairs], 2).first()["score"] == 10**6 * (3 * 10**12) ** 2 // ((4 * 10**12 + 1) * (5 * 10**12 + 3))


def test_empty_collocations(empty):
    assert C.collocations(empty).collect() == []


def spans(tokens):
    at = 0
    for i, token in tokens:
        yield i, at, at + len(token)
        at += len(token)


def brute_alignment(texts):
    """Links by comparing all spans; encoded by the library that the JSON is made for."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, letters = Tokenizer.from_file(T.BYTE_VOCABULARY), T._byte_letters()
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=T.PIECE_MODEL)

    def piece(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    read, counts = [], Counter()
    for text in texts:
        a = [(i, bytes(letters[c] for c in a_side.id_to_token(i))) for i in a_side.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, piece(i)) for i in b_side.encode(text)] if text else []
        if b"".join(t for _, t in a) != (" " + (text or "")).encode() or b"".join(t for _, t in b) != (" " + (text or "")).encode():
            a, b = [], []
        a, b = list(spans(a)), list(spans(b))
        links = [(i, j) for i, low, high in a for j, begin, end in b if low < end and begin < high]
        counts.update(links)
        read.append((a, b, links))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    for a, b, links in read:
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [(",".join(str(i) for i, _, e in a if low < e <= high), ",".join(str(i) for i, _, e in b if low < e <= high)) for low, high in zip([0, *ends], ends)]
        text = ";".join(f"{x}|{y}" for x, y in groups)
        yield len(a), len(b), len(groups), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), sha256(text.encode()).hexdigest() if text else ""


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["<|endoftext|> and </s> <s> <unk> <0x41>", "a▁b", "  two  blanks ", "\ttab\r\nline \n\n", "İstanbul ΑΒΓ 漢字かな 한국어 🙂👩‍👩‍👧", " nbsp　wide", "é ﬁ Å", "x" * 300, "don't we'll 12345 ½ ²", "\x00\x07"]


def test_alignment_by_brute_force(spark, texts):
    short = [t for _, t in texts if t is None or len(t) < 900] + ODD
    docs = spark.createDataFrame([(i if i % 7 else None, t, None, None, 0, 1, "w", None, 7, 3) for i, t in enumerate(short)], DOCS).repartition(4)
    assert rows_of(T.aligned_tokens(docs), ALIGNED) == sorted(brute_alignment(short))


def test_alignment_in_small_parts(spark, docs, texts, monkeypatch):
    whole = rows_of(T.aligned_tokens(docs), ALIGNED)
    monkeypatch.setattr(T, "SHARD", 500)
    monkeypatch.setattr(T, "SHARDS", 1)
    assert rows_of(T.aligned_tokens(docs), ALIGNED) == whole
    assert len(whole) == len(texts)


def test_partial_counts_and_runs():
    import numpy as np
    import pyarrow as pa

    keys = np.sort(np.random.default_rng(3).integers(0, 40, 500)) << T.BITS | 7
    batches = [T._counted(keys[i : i + 9], np.ones(len(keys[i : i + 9]), np.int64)) for i in range(0, 500, 9)]
    summed = pa.Table.from_batches(T.run_lengths(iter(batches))).to_pydict()
    assert dict(zip(summed["key"], summed["n"], strict=True)) == Counter(keys.tolist())
    assert len(summed["key"]) == len(set(summed["key"]))


def test_packing_is_a_round_trip():
    import numpy as np

    keys = np.array([0, 3, 5 << T.BITS | 70_000, 5 << T.BITS | 70_001, 9 << T.BITS], np.int64)
    upper, lower = T._pairs(keys)
    assert T._keys(len(upper).to_bytes(8, "little") + upper + lower).tolist() == keys.tolist()


def test_empty_alignment(empty):
    assert T.aligned_tokens(empty).collect() == []
