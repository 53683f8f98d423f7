import random
import re

from pyspark.sql import functions as F

from precepta.operators import places

MARKS = ["«", "»", "“", "”", '"', "(", ")", "[", "]", ".", ";", "\n", " ", "a", "ñ", "😀", "art. 7", "artículo 12 bis", "V0123-21", "5%", "https://example.org/x."]


def _by_letters(text):
    """Quotations by trying every pair of places, and their sentences by walking letter by letter."""
    pairs = []
    for opens, closes in ("«»", "“”", '""'):
        at = 0
        while (start := text.find(opens, at)) >= 0 and (end := text.find(closes, start + 1)) >= 0:
            pairs += [(start, end + 1)] if len(text[start + 1 : end].strip()) >= 3 else []
            at = end + 1
    kept = []
    for start, end in sorted(pairs):
        if all(start >= e for _, e in kept):
            kept.append((start, end))
    found = []
    for start, end in kept:
        depth, stop = 0, end
        while stop < len(text):
            c = text[stop]
            if c in "«“\"" and stop > end:
                break
            depth = max(depth + (c in "([{") - (c in ")]}"), 0)
            stop += 1
            if depth == 0 and c in ".;\n":
                break
        found.append((start, end, text[start + 1 : end - 1].strip(), text[max([i + 1 for i in range(start) if text[i] in "»”\""], default=0) : start], text[end:stop]))
    return found


def test_quotations_by_brute_force(spark):
    draw = random.Random(7)
    texts = ["".join(draw.choices(MARKS, k=draw.randrange(60))) for _ in range(400)] + ["", None, "«" * 50, '"' * 51, "«abc» " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit(1))
    rows = docs.select("doc_id", places.quotations("text").alias("q")).collect()
    for doc_id, found in rows:
        assert [(q["start"], q["end"], q["literal"], q["before"], q["after"]) for q in found] == _by_letters(texts[doc_id] or "")
    for row in places.masked(docs).collect():
        assert (row["masked"] is None) == (row["text"] is None)
        if row["text"] is not None:
            assert len(row["masked"]) == len(row["text"])
            assert all(m in (" ", t) for m, t in zip(row["masked"], row["text"]))
    for row in places.placed_citations(docs).collect():
        assert texts[row["doc_id"]][row["start"] + 1 : row["end"] - 1].strip() == row["literal"]
    for row in places.placed_claims(docs).collect():
        assert texts[row["doc_id"]][row["start"] :].startswith(row["claim"])


def test_references_in_turn(spark):
    texts = {
        "brackets": ("El artículo 1 dice «lo uno» (artículo 2) artículo 3.", ("article", "2")), "before": ("El artículo 1 y el art. 4 dicen «lo uno», artículo 3.", ("article", "4")),
        "behind": ("«lo uno», artículo 3 y artículo 5.", ("article", "3")), "next sentence": ("«lo uno». El artículo 3.", (None, None)),
        "ruling": ("«lo uno» (V0123-21, artículo 9)", ("ruling", "V0123-21")), "criterion": ("«lo uno» (artículo 9, 00/01234/2020/00/1)", ("criterion", "00/01234/2020/00/1")),
        "provision": ("La disposición adicional sexta fija «lo uno»", ("provision", "adicional sexta")), "other quotation": ("El artículo 1 fija «lo uno», y “lo dos”", ("article", "1")),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id string, text string")
    rows = {r["doc_id"]: (r["kind"], r["number"]) for r in places.placed_citations(docs).where("n = 0").collect()}
    assert rows == {k: expected for k, (_, expected) in texts.items()}


def test_mentions_in_blocks(spark):
    same = "El artículo 8 rige."
    texts = [
        ("a", None, f"Cambia la Ley 1/2001: «{same}» {same}"), ("a", None, f"Cambia la Ley 1/2001: «{same}» {same}"), ("b", "1/2001", f"Cambia la Ley 1/2001: “{same}”"),
        ("c", None, f"Cambia la Ley 1/2001.\nDice: «{same}»"), ("d", None, None), (None, None, same), ("e", None, ""),
    ]
    docs = spark.createDataFrame(texts, "origin string, own string, text string").withColumn("start", F.lit(1))
    found = sorted((str(r["origin"]), r["start"], r["number"], r["norm"] or "") for r in places.placed_mentions(docs).collect())
    assert found == [("None", 3, "8", ""), ("a", 26, "8", "1/2001"), ("a", 26, "8", "1/2001"), ("a", 47, "8", ""), ("a", 47, "8", ""), ("b", 26, "8", ""), ("c", 32, "8", "")]
    assert places.placed_mentions(docs.limit(0)).count() == places.placed_citations(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mentions_in_blocks_of_norms_with_long_numbers(spark):
    numbers = ["1/99", "9999/1999", "10000/1999", "1234567/2001"]
    docs = spark.createDataFrame([(n, own, f"Cambia la Ley {n}: «El artículo 8 rige.»") for n in numbers for own in (None, "10000/1999")], "origin string, own string, text string")
    found = {(r["origin"], r["norm"]) for r in places.placed_mentions(docs).collect()}
    assert found == {(n, n) for n in numbers} | {("10000/1999", None)}


def _mentions_by_letters(text, own):
    """The mentions of a text, each held against all quotations; a quotation's sentence is sought by walking back letter by letter."""
    found = []
    for mention in re.finditer(r"(?i)\bart(?:[íi]culo|\.)\s+(\d+)", text):
        norm = None
        for start, end, _, before, _ in _by_letters(text):
            if start < mention.start() < end:
                opening, at = before.removesuffix("\n"), len(before.removesuffix("\n"))
                while at > 0 and opening[at - 1] not in ";\n" and not (before[at - 1] == "." and before[at : at + 1] in (" ", "\n")):
                    at -= 1
                named = re.search(r"(?i)\b(?:ley|orden)\s+(\d+/\d{2,4})", opening[at:])
                norm = named[1] if named and named[1] != own else None
        found.append((mention.start(), mention[1], norm))
    return found


def test_mentions_by_brute_force_in_one_pass(spark):
    draw = random.Random(11)
    marks = ["«", "»", "“", "”", '"', ". ", ".", ";", "\n", " ", "ñ", "😀", "Art. 7", "xart. 8", "artículo  12", "art. ", "la Ley 1/2001", " orden 12345/99", "Ley 2/2002:"]
    texts = ["".join(draw.choices(marks, k=draw.randrange(40))) for _ in range(1500)] + ["", "«" * 100_000 + " art. 5", "Ley 1/2001: «art. 5» " * 2000, "Ley 1/2001: «" + "art. 5; " * 3000 + "»"]
    cases = [(i, own, text) for i, text in enumerate(texts) for own in (None, "1/2001")]
    docs = spark.createDataFrame([*cases, (-1, None, None)], "origin long, own string, text string")
    found = places.placed_mentions(docs)
    by_row = sorted((r["origin"], r["start"], r["number"], r["norm"] or "") for r in found.collect())
    few = [c for c in cases if len(c[2]) < 1000]
    assert [r for r in by_row if r[0] <= few[-1][0]] == sorted((i, start, number, norm or "") for i, own, text in few for start, number, norm in _mentions_by_letters(text, own))
    assert len([r for r in by_row if r[0] > few[-1][0]]) == 2 * (1 + 2000 + 3000) and sum(r[3] == "1/2001" for r in by_row if r[0] > few[-1][0]) == 5000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
