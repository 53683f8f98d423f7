"""MinHash near-duplicate detection with SuperMinHash signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precepta.llm import textbytes as tb
from precepta.llm.common import cut, forget, in_python
from precepta.llm.graph import components

#: Words of a shingle, and the least per cent of Jaccard similarity of a link.
SHINGLE_WORDS, PERCENT = 5, 75
#: Signature slots, in bands of so many rows. A pair of similarity 0.75 shares no band with a chance of 5e-6.
BANDS, ROWS = 32, 4
#: Shingles that are signed at a time; each has a row of slots in memory.
SIGNED = 1 << 16
#: A pivot's group is compared in parts of about so many members.
PART_MEMBERS = 64
SIGNED_ROW = "doc_id long, text1 long, text2 long, n_shingles long, print1 long, print2 long, bands array<long>"


def super_minhash(grams: np.ndarray, first: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash signatures, a row for each set of distinct hashes grams[first[i]:first[i + 1]].

    An element draws a random order of the slots and offers slot number p_j the value j + r_j. All elements make
    their j-th offer at once; a set leaves as soon as each of its slots holds an offer, as later ones are larger.
    Slots of empty sets hold the largest value.
    """
    n = len(first) - 1
    if len(grams) > SIGNED and n > 1:
        cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(grams), SIGNED), "right") - 1, n))
        cuts = cuts if len(cuts) > 2 else np.array([0, (n + 1) // 2, n])
        return np.concatenate([super_minhash(grams[first[a] : first[b]], first[a : b + 1] - first[a], slots) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    least = np.full(n * slots, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(first))
    grams, order = grams.copy(), None
    for j in range(slots):
        draw = tb.mix(grams + np.uint64(((2 * j + 1) * 0x9E3779B97F4A7C15) % (1 << 64)))
        k = j + ((draw >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if j:
            rows = np.arange(len(grams))
            slot = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
            order[:, j] = slot
        else:
            slot = k
        np.minimum.at(least, owner * slots + slot, np.uint64(j << 48) | (tb.mix(draw) >> np.uint64(16)))
        full = least.reshape(n, slots).max(axis=1) != np.iinfo(np.uint64).max if n else np.zeros(0, bool)
        stay = ~full[owner]
        if not stay.any():
            break
        if j:
            order = order[stay]
        else:
            order = np.broadcast_to(np.arange(slots, dtype=np.min_scalar_type(slots)), (int(stay.sum()), slots)).copy()
            order[np.arange(len(order)), k[stay]] = 0
            order[:, 0] = k[stay]
        grams, owner = grams[stay], owner[stay]
    return least.reshape(n, slots)


def _sets(texts: pa.Array, words: int):
    """(index of the first text, distinct shingle hashes, first) of each slice of texts."""
    for begin, data, offsets in tb.slices(texts):
        start, end, first = tb.split(data, offsets)
        grams, owners = tb.gram_hashes(tb.word_hashes(data, start, end), first, words)
        yield begin, *tb.distinct(grams, owners, len(offsets) - 1)


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))


def _signer(words: int, bands: int, rows: int):
    def sign(batches):
        for batch in batches:
            for begin, grams, first in _sets(batch.column(3), words):
                n, counts = len(first) - 1, np.diff(first)
                prints = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
                some = np.flatnonzero(counts)
                for salt, out in zip((11, 13), prints, strict=True):
                    if len(some):
                        out[some] = np.add.reduceat(tb.mix(grams + np.uint64(salt)), first[some])
                signs = super_minhash(grams, first, bands * rows).reshape(n, bands, rows)
                keys = np.zeros((n, bands), np.uint64)
                for r in range(rows):
                    keys = tb.mix(keys * np.uint64(31) + signs[:, :, r])
                keys = keys[some].reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(begin, n) for k in range(3)), pa.array(counts.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in prints), _lists(keys, np.concatenate([[0], np.cumsum((counts > 0) * bands)]))],
                    ["doc_id", "text1", "text2", "n_shingles", "print1", "print2", "bands"],
                )

    return sign


def _comparer(words: int):
    """Compares texts with the pivot before them, for rows (a, part, kind, node, rep, text) in this order; pivots have kind 0.

    Of each it gives the sizes of both sets, what they have in common, and the difference: the shingles that the text has
    beyond the pivot, and the complements of those it lacks.
    """

    def compare(batches):
        group = before = pivot = pivot_rep = None
        for batch in batches:
            keys = [batch.column(k).to_pylist() for k in range(5)]
            for begin, grams, first in _sets(batch.column(5), words):
                out = []
                for i in range(len(first) - 1):
                    a, part, kind, node, rep = (k[begin + i] for k in keys)
                    own = grams[first[i] : first[i + 1]]
                    if kind == 0:
                        group, pivot, pivot_rep = (a, part), own.copy(), rep
                    elif (a, part, node) != before:
                        if group != (a, part):
                            raise RuntimeError(f"no pivot before {node}")
                        place = np.minimum(np.searchsorted(pivot, own), len(pivot) - 1)
                        shared = pivot[place] == own
                        lacked = np.ones(len(pivot), bool)
                        lacked[place[shared]] = False
                        out.append((a, part, pivot_rep, node, rep, len(pivot), len(own), int(shared.sum()), np.concatenate([own[~shared], ~pivot[lacked]])))
                    before = a, part, node
                if out:
                    columns = list(zip(*out, strict=True))
                    first_ = np.concatenate([[0], np.cumsum([len(x) for x in columns[8]])])
                    yield pa.RecordBatch.from_arrays([*(pa.array(columns[k], pa.int64()) for k in range(8)), _lists(np.concatenate(columns[8]), first_)], ["a", "part", "rep_a", "b", "rep_b", "p", "x", "common", "differ"])

    return compare


COMPARED = "a long, part long, rep_a long, b long, rep_b long, p long, x long, common long, differ array<long>"


def _similar(p: str, x: str, common: str, percent: int) -> Column:
    return F.expr(f"100 * {common} >= {percent} * ({p} + {x} - {common})")


def _compared(texts: DataFrame, pairs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """COMPARED of pairs (a, b, part) of nodes (node, rep, text1, text2).

    The text of b is brought to its pair, and that of a to each part of its group, so a group of any size is dealt over
    tasks in parts of bounded size, and each task holds one pivot at a time.
    """
    members = pairs.select(F.col("b").alias("node"), "a", "part", F.lit(1).alias("kind"))
    pivots = pairs.select(F.col("a").alias("node"), "a", "part").distinct().withColumn("kind", F.lit(0))
    placed = members.union(pivots).join(nodes, "node")
    whole = placed.join(texts.withColumnRenamed("doc_id", "rep"), ["rep", "text1", "text2"]).select("a", "part", "kind", "node", "rep", "text")
    return in_python(whole.repartition("a", "part").sortWithinPartitions("a", "part", "kind", "node"), _comparer(words), COMPARED)


def _recentred(groups: DataFrame) -> DataFrame:
    """groups (a, part, b, rep, component, x, differ) with all differences taken from a better pivot, of size p.

    The pivot is the member whose set differs least from those of the whole group, ties to the smallest node: a difference
    that b shares with n of g members counts 2 n - g. With D and M the differences of a member and of the new pivot from
    the old one, the member differs from the new pivot by D without M and by the complements of M without D.
    """
    sizes = groups.groupBy("a").agg(F.count("*").alias("g"))
    each = groups.select("a", "b", F.explode("differ").alias("shingle"))
    shared = each.groupBy("a", "shingle").agg(F.count("*").alias("n")).where("n > 1")
    twice = each.join(shared, ["a", "shingle"]).groupBy("a", "b").agg(F.count("*").alias("same"), F.sum("n").alias("n"))
    whole = groups.select("a", "b", F.size("differ").alias("differs"))
    score = 2 * (F.col("differs") - F.coalesce("same", F.lit(0)) + F.coalesce("n", F.lit(0))) - F.col("g") * F.col("differs")
    best = whole.join(twice, ["a", "b"], "left").join(sizes, "a").groupBy("a").agg(F.max(F.struct(score.alias("score"), -F.col("b"))).alias("best"))
    best = best.select("a", (-F.col("best").getField("col2")).alias("b"))
    pivots = groups.join(best, ["a", "b"], "left_semi").select("a", F.col("x").alias("p"), F.col("rep").alias("pivot_rep"), F.col("component").alias("pivot_component"), F.col("differ").alias("own"))
    parts = groups.select("a", "part").distinct().join(pivots, "a")
    moved = F.concat(F.array_except("differ", "own"), F.transform(F.array_except("own", "differ"), lambda v: F.bitwise_not(v)))
    return groups.join(parts, ["a", "part"]).select("a", "b", "rep", "component", "x", "p", "pivot_rep", "pivot_component", moved.alias("differ"))


def _open_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, x, y) of members of different components that may still be similar, of groups (a, b, component, p, x, more, less, differ).

    An exact filter. Members x and y are taken by what they have beyond the pivot p (A) and what they lack of it (D):
    they have |p| - |Dx| - |Dy| + o shingles in common, where o counts what their differences have in common. If x isn't
    similar to p, x and y can be similar only if o > s |Ay| + (1 - s) |Dy|, with s = percent / (100 + percent), and only
    if o >= e / (1 - s), where e > 0 is what x lacks to be similar to p. So, in order of how many members share a
    difference, one of the first |Ay| + |Dy| - o + 1 of y is among as many of x. A member's own edits come first in this
    order, so members that differ from p in ways of their own meet nobody; and no two go on that have too few differences
    left behind the one they meet at.
    """
    more, less = F.col("more"), F.col("less")
    differ = groups.withColumn("lacks", percent * (F.col("x") + F.col("p")) - (100 + percent) * (F.col("p") - less))
    needs, whole = percent * more + 100 * less, more + less
    wide = whole - F.floor(needs / (100 + percent))
    narrow = F.when(F.col("lacks") > 0, whole - F.ceil(F.col("lacks") / 100) + 1).otherwise(0)
    each = differ.select("a", "b", "component", "lacks", needs.alias("needs"), whole.alias("whole"), wide.alias("wide"), narrow.alias("narrow"), F.explode("differ").alias("shingle"))
    common = each.groupBy("a", "shingle").agg(F.count("*").alias("n")).where("n > 1")
    mine = Window.partitionBy("a", "b")  # a document's own shingles
    ranked = each.join(common, ["a", "shingle"]).withColumn("place", F.row_number().over(mine.orderBy("n", "shingle"))).withColumn("shared", F.count("*").over(mine))
    ranked = ranked.withColumn("place", F.col("whole") - F.col("shared") + F.col("place")).where("place <= greatest(wide, narrow)")
    first = cut(ranked.select("a", "shingle", "b", "component", "lacks", "needs", (F.col("whole") - F.col("place") + 1).alias("left"), (F.col("place") <= F.col("wide")).alias("wide"), (F.col("place") <= F.col("narrow")).alias("narrow")))
    far, any_ = first.where("narrow").alias("f"), first.where("wide").alias("o")
    enough = (100 + percent) * F.least("f.left", "o.left") >= F.col("f.lacks") + F.col("o.needs")
    crossed = far.join(any_, (F.col("f.a") == F.col("o.a")) & (F.col("f.shingle") == F.col("o.shingle")) & (F.col("f.component") != F.col("o.component")) & enough)
    out = cut(crossed.select("f.a", F.least("f.b", "o.b").alias("x"), F.greatest("f.b", "o.b").alias("y")).distinct())
    forget(first)
    return out


def _open_links(compared: DataFrame, found: DataFrame, percent: int) -> DataFrame | None:
    """Edges (a, b) between components of found that links inside groups add, where compared leaves groups in several ones."""
    named = found.toDF("rep_b", "component")
    apart = compared.where(~_similar("p", "x", "common", percent)).select("a", "rep_a", "rep_b").join(named, "rep_b", "left").withColumn("component", F.coalesce("component", "rep_b"))
    pivots = found.toDF("rep_a", "pivot_component")
    apart = apart.join(pivots, "rep_a", "left").where(F.col("component") != F.coalesce("pivot_component", "rep_a"))
    open_ = cut(apart.select("a").distinct())
    if open_.isEmpty():
        forget(open_)
        return None
    members = compared.join(open_, "a", "left_semi")
    pivot = members.groupBy("a", F.col("a").alias("b"), F.col("rep_a").alias("rep_b"), F.col("p").alias("x")).agg(F.min("part").alias("part"))
    pivot = pivot.withColumn("differ", F.array().cast("array<long>"))
    both = members.select("a", "part", "b", "rep_b", "x", "differ").unionByName(pivot)
    groups = cut(both.join(named, "rep_b", "left").select("a", "part", "b", F.col("rep_b").alias("rep"), F.coalesce("component", "rep_b").alias("component"), "x", "differ"))
    # |more| - |less| = x - p
    less = F.expr("(size(differ) + p - x) div 2")
    centred = cut(_recentred(groups).withColumn("less", less).withColumn("more", F.size("differ") - less))
    forget(groups, open_)
    to_pivot = centred.where("pivot_component != component").where(_similar("p", "x", "(p - less)", percent)).select(F.col("pivot_component").alias("a"), F.col("component").alias("b"))
    pairs = _open_pairs(centred, percent)
    one = centred.select("a", F.col("b").alias("x"), F.col("component").alias("cx"), F.col("x").alias("nx"), "p", F.col("less").alias("lx"), F.col("differ").alias("dx"))
    two = centred.select("a", F.col("b").alias("y"), F.col("component").alias("cy"), F.col("x").alias("ny"), F.col("less").alias("ly"), F.col("differ").alias("dy"))
    held = pairs.join(one, ["a", "x"]).join(two, ["a", "y"]).withColumn("common", F.col("p") - F.col("lx") - F.col("ly") + F.size(F.array_intersect("dx", "dy")))
    links = cut(held.where(_similar("nx", "ny", "common", percent)).select(F.col("cx").alias("a"), F.col("cy").alias("b")).union(to_pivot).distinct())
    forget(centred, pairs)
    return links


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups of near-duplicate documents: doc_id, n_shingles, component_id, kept; a row for each row of docs.

    docs has doc_id (long) and text; further columns are ignored. Two documents are linked if their sets of word
    shingles (lower-cased A-Z) have a Jaccard similarity of at least percent / 100; component_id is the smallest doc_id
    reachable over links, and kept says that this is the document itself.

    - One scan makes each set's size, its 128-bit fingerprint and its SuperMinHash band keys.
    - Rows of equal sets form one class, by a hash aggregate; one of its texts goes on. Copies thus cost one row.
    - In a bucket of equal band keys each class is held against the bucket's pivot, the class of most rows: texts are
      brought together in bounded parts of the pivot's group, their full sets compared, and verified links grouped by
      union-find. What is kept of a comparison is the difference of the two sets.
    - A group whose members are then in one component is done. Any other gets the member as pivot that differs least from
      the rest, and goes through an exact prefix filter on the differences from it; pairs of different components that
      pass are compared as well, by their differences, which tell the sets' common size. So a bucket of n classes takes n
      comparisons, not n * n, and none is capped.

    Null or empty texts and texts without words have no shingles and are linked with nothing. A text of fewer words than
    a shingle has one, its whole sequence. A null doc_id is never linked: its component_id is null, kept is true. Rows
    that share a doc_id are one node, whatever their texts: it is linked with all that any of these is linked with. An
    empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text1"), F.xxhash64(F.lit("again"), text).alias("text2"), text.alias("text"))
    signed = cut(in_python(texts, _signer(shingle_words, bands, rows), SIGNED_ROW))
    named, key = signed.where("doc_id IS NOT NULL AND n_shingles > 0"), ["n_shingles", "print1", "print2"]
    first = F.min(F.struct(F.col("doc_id").alias("rep"), "text1", "text2")).alias("first")
    classes = named.groupBy(*key).agg(first, F.count("*").alias("rows"), F.first("bands").alias("bands"))  # equal sets have equal bands
    classes = cut(classes.select(F.monotonically_increasing_id().alias("node"), *key, "first.*", "rows", "bands"))
    signed_only, nodes = signed.select("doc_id", *key), classes.select("node", "rep", "text1", "text2")

    banded, spots = classes.select("node", "rows", F.posexplode("bands").alias("band", "bucket")), ["band", "bucket"]
    pivots = banded.groupBy(*spots).agg(F.max(F.struct("rows", -F.col("node"))).alias("pivot"), F.count("*").alias("members")).where("members > 1")
    pairs = banded.join(pivots.select(*spots, "members", (-F.col("pivot").getField("col2")).alias("a")), spots).where("node != a")
    pairs = pairs.groupBy("a", F.col("node").alias("b")).agg(F.max("members").alias("members"))
    pairs = cut(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / PART_MEMBERS)).alias("part")))
    compared = cut(_compared(texts, pairs, nodes, shingle_words))
    forget(pairs)

    # an id's rows are one node, so the classes of an id of several texts are tied to each other
    mixed = named.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("low"), F.max(F.struct(*key)).alias("high")).where("low != high").select("doc_id")
    ties = named.join(mixed, "doc_id", "left_semi").join(classes.select("rep", *key), key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = compared.where(_similar("p", "x", "common", percent)).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    found = components(links.union(ties))
    more = _open_links(compared, found, percent)
    if more is not None:
        joined = components(more)
        before = found.union(more.select(F.explode(F.array("a", "b")).alias("id"), F.col("id").alias("component")).distinct().join(found.select("id"), "id", "left_anti"))
        last = cut(before.join(joined.toDF("component", "last"), "component", "left").select("id", F.coalesce("last", "component").alias("component")))
        forget(found, more, joined)
        found = last
    forget(compared)

    placed = classes.select("rep", *key).join(found.toDF("rep", "component"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component"))
    out = signed_only.join(placed, key, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, doc_id, count(*) AS n FROM g GROUP BY ALL),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
l AS (SELECT DISTINCT nx.doc_id AS u, ny.doc_id AS v FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
t(id, other) AS (SELECT DISTINCT u, u FROM e UNION SELECT t.id, e.v FROM t JOIN e ON t.other = e.u),
m AS (SELECT id, min(other) AS component FROM t GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN m ON m.id = d.doc_id
"""
