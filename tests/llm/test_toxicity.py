"""Toxicity: the kernel against counting subsequences, scores of planted insults, and rows of all kinds."""

from __future__ import annotations

import math
from itertools import combinations
from random import Random

import numpy as np
import pyarrow as pa
import pytest

from precepta.llm import toxicity as X

INSULTS = ["blorvak", "snirgle", "quuftop"]
DOCS = "doc_id long, text string"
LABELS = "doc_id long, toxic int"


def subsequences(word):
    out = {}
    for at in combinations(range(len(word)), 3):
        if at[2] - at[0] < X.SPAN:
            key = "".join(word[i] for i in at)
            out[key] = out.get(key, 0.0) + X.DECAY ** (at[2] - at[0] - 2)
    return out


def units_of(text):
    data = np.frombuffer(text.encode(), np.uint8)
    found = X.units(data, np.array([0, len(data)]))
    words = [""] * len(found.sentence)
    for letter, unit in zip(found.letters, found.unit):
        words[unit] += chr(letter)
    return words, found.sentence.tolist()


def test_kernel_by_brute_force():
    draw = Random(5)
    landmarks = ["".join(draw.choices("abcde ", k=draw.randint(3, 9))) for _ in range(12)]
    words = ["".join(draw.choices("abcdefg ", k=draw.randint(1, 14))) for _ in range(60)]
    landmarks = [w for w in dict.fromkeys(landmarks)]
    got = np.concatenate([k for _, k in X.Kernel(landmarks)(*X._letters_of(words))])
    for i, word in enumerate(words):
        own = subsequences(word)
        for j, mark in enumerate(landmarks):
            other = subsequences(mark)
            length = math.sqrt(sum(w * w for w in other.values()))
            want = (sum(w * other.get(k, 0.0) for k, w in own.items()) / length) ** X.POWER
            assert got[i, j] == pytest.approx(want)


def test_gaps_and_inserted_letters_stay_alike():
    kernel = X.Kernel([" blorvak"])
    like = np.concatenate([k for _, k in kernel(*X._letters_of([" blorvak", " bloxrvak", " bloorvaak", " meadows"]))])[:, 0]
    assert like[0] > like[1] > like[3] and like[2] > 5 * like[3]


def test_units():
    assert units_of("Fine day. You b-l-o-r!\nb l o r x yes") == ([" fine", " day", " you", " blor", " blorx", " yes"], [0, 0, 1, 1, 2, 2])
    long = "z" * 60
    words, _ = units_of(long)
    assert max(map(len, words)) <= X.UNIT and sum(w.startswith(" ") for w in words) == 1
    assert units_of(" \n ") == ([], [])


def corpus(n, seed):
    draw = Random(seed)
    plain = ["".join(draw.choices("aeioumnrst", k=draw.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        sentences = [[draw.choice(plain) for _ in range(draw.randint(4, 9))] for _ in range(draw.randint(2, 6))]
        if toxic:
            for sentence in draw.sample(sentences, 2):
                word = list(draw.choice(INSULTS))
                if draw.random() < 0.3:
                    word.insert(draw.randint(1, len(word) - 1), draw.choice("-*.xe"))
                sentence.insert(draw.randint(0, len(sentence)), "".join(word))
        rows.append((i, " ".join(" ".join(s).capitalize() + "." for s in sentences)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def machine(spark):
    rows, labels = corpus(240, 1)
    return X.fit_toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))


def scores_of(machine, texts):
    return machine.scores(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), 0, X.Kernel(machine.landmarks))


def test_held_out_accuracy(machine):
    rows, labels = corpus(200, 2)
    found = scores_of(machine, [t for _, t in rows]) >= X.TOXIC
    truth = np.array([t == 1 for _, t in labels])
    assert (found & truth).sum() >= 0.9 * truth.sum()
    assert (found & ~truth).sum() <= 0.05 * (~truth).sum()


def test_whole_texts_count_and_batches_do_not_matter(machine):
    rows, _ = corpus(40, 3)
    texts = [None, "", *(t for _, t in rows), "rest tame. " * 30000 + "You blorvak and snirgle. A quuftop."]
    whole = scores_of(machine, texts)
    assert whole[0] == whole[1] and ((whole >= 0) & (whole <= 1)).all()
    assert whole.tolist() == [scores_of(machine, [t])[0] for t in texts]
    assert whole[-1] > scores_of(machine, ["rest tame. " * 30000])[0]


def test_units_seen_before_are_not_compared_again(machine, monkeypatch):
    rows, _ = corpus(60, 6)
    batches = [pa.RecordBatch.from_arrays([pa.array([t for _, t in rows[i : i + 10]], pa.string())], ["text"]) for i in range(0, 60, 10)]
    compared, plain = [], X.Kernel(machine.landmarks)

    def kernel(letters, size):
        compared.append(len(size))
        return plain(letters, size)

    whole = np.concatenate([machine.scores(b, 0, plain) for b in batches])
    seen = X.Seen()
    assert (np.concatenate([machine.scores(b, 0, kernel, seen) for b in batches]) == whole).all()
    first = sum(compared)
    assert first == len(seen.hashes) == len(np.unique(seen.hashes)) and (np.diff(seen.hashes.astype(float)) >= 0).all()
    assert (np.concatenate([machine.scores(b, 0, kernel, seen) for b in batches]) == whole).all() and sum(compared) == first
    monkeypatch.setattr(X, "SEEN", 50)
    assert (np.concatenate([machine.scores(b, 0, kernel, X.Seen()) for b in batches]) == whole).all()
    few = X.Seen()
    assert (np.concatenate([machine.scores(b, 0, kernel, few) for b in batches]) == whole).all()


def test_rows_of_all_kinds(spark):
    rows, labels = corpus(120, 4)
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows] + [(None, "you blorvak", None, None), (3, rows[3][1], "x", 0.5), (500, None, None, None), (501, "", None, None)], DOCS + ", toxic string, score double")
    marked = spark.createDataFrame([(i, t, "y") for i, t in labels] + [(1, None, "y"), (None, 1, "y"), (9999, 1, "y")], LABELS + ", text string")
    got = [tuple(r) for r in X.toxicity(docs, marked).collect()]
    assert len(got) == 124 and len([1 for i, _ in got if i == 3]) == 2 and len({s for i, s in got if i == 3}) == 1
    assert dict(got)[500] == dict(got)[501] and all(0 <= s <= 1 for _, s in got)
    assert sorted(got, key=str) == sorted((tuple(r) for r in X.toxicity(docs.repartition(5), marked).collect()), key=str)


def test_labels_of_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    assert [r.score for r in X.toxicity(docs, spark.createDataFrame([(1, 0)], LABELS)).collect()] == [0.0, 0.0]
    assert X.toxicity(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0
