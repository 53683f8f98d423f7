import corpus_pipeline
from compare import SMALL
from pyspark.sql import functions as F

from precepta.llm import decontaminate, mixing, near_dedup, quality_classifier, substring_dedup


def test_stages_take_effect_in_order(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substrings", "decontaminate", "mix"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.union(docs.where("doc_id < 3")).union(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long"))).union(docs.where("doc_id = 5").select(F.lit(9999).cast("long"), F.lit(None).cast("string"), "lang", "source", "n_chars"))
    labels, bench = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("labels", "benchmark"))
    columns, texts = docs.columns, lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    wanted = {
        "quality": lambda d: quality_classifier.classify_quality(d, labels).where("kept"),
        "near_dedup": lambda d: near_dedup.near_duplicates(d).where("kept").select("doc_id").distinct(),
        "substrings": lambda d: substring_dedup.substring_dedup(d).where("text IS NULL OR text != '' OR n_removed = 0"),
        "decontaminate": lambda d: d.join(decontaminate.contamination(d, bench).where("contaminated").select("doc_id").distinct(), "doc_id", "left_anti"),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        after, want = spark.read.parquet(path), wanted[name](docs)
        if name == "near_dedup":
            ids = [r["doc_id"] for r in after.where("doc_id IS NOT NULL").select("doc_id").collect()]
            assert sorted(ids) == sorted(r["doc_id"] for r in want.where("doc_id IS NOT NULL").collect())
        else:
            assert texts(after) == texts(want.select("doc_id", "text"))
        docs = after
    mixed = corpus_pipeline.mix(spark, docs, SMALL)
    assert mixed.columns == [*columns, "copy", "n_words"]
    rates = mixing.mixing_rates(docs).agg(F.sum("taken")).first()[0]
    assert mixed.agg(F.sum("n_words")).first()[0] == rates


def test_near_dedup_by_brute_force(spark, texts):
    """Of each group that links by full sets build, one row stays, whatever the rows' ids; rows without words all stay."""
    given = [(i, t) for i, t in texts if len(t or "") < 20_000]
    given += [(5, given[20][1]), (None, given[21][1]), (None, given[21][1]), (None, given[-1][1]), (131, "a clean namesake"), (None, "two words"), (700, None), (700, "")]
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if (w := (t or "").lower().split()) else set() for _, t in given]
    group = list(range(len(given)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(given)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group[max(find(a), find(b))] = min(find(a), find(b))
    ids = {}
    for k, (i, _) in enumerate(given):
        if sets[k]:
            ids.setdefault(find(k), []).append((i is None, i or 0))
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(*x, 1) for x in given], "doc_id long, text string, _rows int"), "")
    assert out.columns == ["doc_id", "text", "_rows"]
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    worded = [k for k in kept if (k[1] or "").split()]
    assert sorted((i is None, i or 0) for i, _ in worded) == sorted(min(x) for x in ids.values())
    assert all(k in given for k in kept) and len(kept) - len(worded) == sum(not s for s in sets)


def test_substrings_of_rows_without_id(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    given = [(None, f"a b c {passage} d e f"), (3, f"g h i {passage} j k l"), (None, passage), (4, None), (5, "")]
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.substrings(spark, spark.createDataFrame(given, "doc_id long, text string"), "").collect()}
    texts = {i: [t for j, t in got if i == j] for i in (None, 3)}
    assert texts[3] == [given[1][1]] and all("p30" not in t for t in texts[None]) and {(4, None), (5, "")} <= got


def test_decontamination_takes_effect_on_each_row(spark, tmp_path):
    leak = "one two three four five six seven eight nine ten"
    rows = [(None, f"before {leak} behind"), (None, "clean"), (7, leak), (7, "a clean namesake"), (8, None), (None, None)]
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(None, "clean"), (7, "a clean namesake"), (8, None), (None, None)]))
