import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, words string, kept boolean, size long, position int"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return "".join(w + (". " if i % 9 == 8 else " ") for i, w in enumerate(words)).strip()


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) with nulls, empty, short and long texts, repeated rows, copies and near copies."""
    rng = random.Random(11)
    out = [(i, prose(rng, rng.choice([3, 12, 40, 90, 160]))) for i in range(60)]
    long = prose(rng, 30_000, 5_000)
    passage = prose(rng, 70, 3_000)
    out += [(100, None), (101, ""), (102, "   \n\t "), (103, long), (None, prose(rng, 40)), (None, None), (5, out[5][1])]
    out += [(110 + i, out[20 + i % 3][1]) for i in range(9)]  # exact copies
    base = prose(rng, 150).split()
    for i in range(12):  # near copies, each with one to three words replaced
        words = list(base)
        for k in rng.sample(range(150), 1 + i % 3):
            words[k] = f"x{i}y{k}"
        out.append((130 + i, " ".join(words)))
    out += [(150 + i, f"{prose(rng, 30)}\n{passage}\n{prose(rng, 30)}") for i in range(4)]
    out += [(160, "abc " * 400), (161, "same line here\n" * 30), (162, "Ünïcode — wörds here ΑΒΓ İstanbul")]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with further columns whose names clash with those of results."""
    rows = [(i, t, "en" if (i or 0) % 2 else None, ["b", "a", None, "hot", "hot"][(i or 0) % 5], len(t or ""), 1, "w", None, 7, 3) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
