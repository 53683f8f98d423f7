"""Toxicity of texts: a support vector machine over a subsequence string kernel, by Nyström landmarks, trained on sentences."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precepta.llm import textbytes as tb
from precepta.llm.common import checked_broadcast, cut, forget, in_python

#: The kernel compares subsequences of three letters that stand in so many letters at most; each letter left out weighs DECAY.
SPAN, DECAY = 7, 0.5
#: A unit's likeness to a landmark is raised to this power, so that many weak likenesses don't make a strong one.
POWER = 2
#: Longer units are cut into windows of UNIT letters, STEP apart, so a run of up to STEP letters lies whole in one.
STEP = 12
UNIT = 2 * STEP
#: Landmarks that tell classes apart, those drawn from all units, the pool of the first, and how like two of them may be.
LANDMARKS, BACKGROUND, POOL, ALIKE = 96, 32, 1500, 0.8
#: The machine is fitted on the sentences of about so many labelled documents of each class at most.
DOCS_OF_CLASS = 2500
#: Rounds in which toxic documents' sentences are told apart, partitions that are fitted on, and the share of documents (1 in FOLDS) that calibrate.
ROUNDS, FIT_PARTS, FOLDS = 3, 4, 5
#: Landmarks' letters beyond the commonest so many match nothing.
ALPHABET = 199
#: So many of a text's most toxic sentences count.
WORST = 3
#: What stands before the letters of a unit, so that beginnings of words are alike.
BEGIN = 32
#: Units that are compared with landmarks at a time.
CHUNK = 1 << 11
#: Values of units that a scoring task keeps; more are computed anew.
SEEN = 1 << 20
TOXIC = 0.3
_ENDS = [ord(c) for c in ".!?…。！？"]


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the code points below U+10000: the lower-case one, whether it is a letter or digit, whether white space. Those above are letters."""
    chars = [chr(c) for c in range(1 << 16)]
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else i for i, c in enumerate(chars)], np.uint32)
    return lower, np.array([c.isalnum() for c in chars] + [True]), np.array([c.isspace() for c in chars] + [False])


@dataclass
class Units:
    """The letters of units, the unit of each letter, and the sentence of each unit and the text of each sentence."""

    letters: np.ndarray
    unit: np.ndarray
    sentence: np.ndarray
    text: np.ndarray


def units(data: np.ndarray, offsets: np.ndarray) -> Units:
    """Units of texts: BEGIN, then the lower-cased letters and digits of what stands between white space.

    Single letters that follow each other are one unit, so that blanks as well as marks between letters are left out. A
    sentence ends with a line, or with a token that ends in a full stop or its like.
    """
    lower, alnum, blank = _letters()
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    edges = points[offsets]
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    low = np.minimum(chars, 1 << 16)
    inside = ~blank[low]
    edge = np.zeros(len(chars) + 1, bool)
    edge[edges] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    begin = np.flatnonzero(start)
    if not len(begin):
        return Units(np.zeros(0, np.uint32), *[np.zeros(0, np.int64)] * 3)
    token = np.cumsum(start) - 1
    end = np.append(begin[1:], len(chars))
    last = np.zeros(len(begin), np.int64)
    last[token[inside]] = np.flatnonzero(inside)
    text = np.searchsorted(edges, begin, "right") - 1
    line = np.cumsum(chars == 10)[begin]
    new = np.append(True, (np.diff(text) > 0) | (np.diff(line) > 0) | np.isin(chars[last[:-1]], _ENDS))
    sentence = np.cumsum(new) - 1
    kept = np.flatnonzero(inside & alnum[low])
    count = np.bincount(token[kept], minlength=len(end))
    filled = np.flatnonzero(count)
    single = count[filled] == 1
    joins = np.append(False, single[1:] & single[:-1] & (np.diff(sentence[filled]) == 0)) if len(filled) else single
    unit = np.zeros(len(begin), np.int64)
    unit[filled] = np.cumsum(~joins) - 1
    letters = np.where(chars[kept] < 1 << 16, lower[low[kept] % (1 << 16)], chars[kept])
    unit = unit[token[kept]]
    begins = np.flatnonzero(np.diff(unit, prepend=-1))
    out = Units(np.insert(letters, begins, BEGIN), np.insert(unit, begins, unit[begins]), sentence[filled[~joins]], text[new])
    return _windows(out)


def _windows(found: Units) -> Units:
    """found with units of over UNIT letters replaced by their windows, behind the others."""
    size = np.bincount(found.unit, minlength=len(found.sentence))
    if not len(size) or size.max() <= UNIT:
        return found
    long = size > UNIT
    first = np.cumsum(size) - size
    parts, owners, n = [found.letters[~long[found.unit]]], [np.repeat(np.arange((~long).sum()), size[~long])], int((~long).sum())
    sentence = [found.sentence[~long]]
    for u in np.flatnonzero(long):
        begins = np.arange(0, max(size[u] - STEP, 1), STEP)
        width = np.minimum(UNIT, size[u] - begins)
        at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(begins, width)
        parts.append(found.letters[first[u] + at])
        owners.append(n + np.repeat(np.arange(len(begins)), width))
        sentence.append(np.full(len(begins), found.sentence[u]))
        n += len(begins)
    return Units(np.concatenate(parts), np.concatenate(owners), np.concatenate(sentence), found.text)


def hashed_units(found: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct units, a unit of each, which of them each unit is); equal letters give equal hashes anywhere."""
    size = np.bincount(found.unit, minlength=len(found.sentence))
    first = np.cumsum(size) - size
    up, down = tb.powers(len(found.letters) + 1)
    run = np.append(np.uint64(0), np.cumsum(tb.mix(found.letters.astype(np.uint64) + np.uint64(1)) * up[:-1]))
    return np.unique(tb.mix((run[first + size] - run[first]) * down[first]), return_index=True, return_inverse=True)


def letters_at(found: Units, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters of the units at these places, their sizes)."""
    size = np.bincount(found.unit, minlength=len(found.sentence))
    width, first = size[at], (np.cumsum(size) - size)[at]
    return found.letters[np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first, width)], width


def distinct_units(found: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters of the distinct units, their sizes, which of them each unit is)."""
    _, at, which = hashed_units(found)
    return *letters_at(found, at), which


class Kernel:
    """The gap-weighted subsequence kernel of units with landmarks, which are of unit length in its space."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        chars, times = np.unique([ord(c) for w in landmarks for c in w], return_counts=True)
        self.known = np.sort(chars[np.argsort(-times, kind="stable")[:ALPHABET]]).astype(np.uint32)
        base = len(self.known) + 1
        found: dict[int, dict[int, float]] = {}
        for i, word in enumerate(landmarks):
            own: dict[int, float] = {}
            codes = self._codes(np.array([ord(c) for c in word], np.uint32)).tolist()
            for a in range(len(codes)):
                for b in range(a + 1, min(a + SPAN, len(codes))):
                    for c in range(b + 1, min(a + SPAN, len(codes))):
                        if codes[a] and codes[b] and codes[c]:
                            key = (codes[a] * base + codes[b]) * base + codes[c]
                            own[key] = own.get(key, 0.0) + DECAY ** (c - a - 2)
            length = sum(w * w for w in own.values()) ** 0.5
            for key, w in own.items():
                found.setdefault(key, {})[i] = w / length
        #: row of each triple of letters, 0 for those of no landmark; the landmarks and weights of a row
        self.row = np.zeros(base**3, np.int32)
        keys = sorted(found)
        self.row[keys] = np.arange(1, len(keys) + 1)
        self.first = np.cumsum([0, 0, *(len(found[k]) for k in keys)])
        self.landmark = np.array([i for k in keys for i in found[k]], np.int64)
        self.weight = np.array([w for k in keys for w in found[k].values()], float)
        self.base = base

    def _codes(self, letters: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, letters), max(len(self.known) - 1, 0))
        return np.where(self.known[at] == letters, at + 1, 0) if len(self.known) else np.zeros(len(letters), np.int64)

    def __call__(self, letters: np.ndarray, size: np.ndarray):
        """Matrices of units by landmarks, for CHUNK units at a time; letters of all, and the size of each."""
        m, edges = len(self.landmarks), np.append(0, np.cumsum(size))
        for begin in range(0, len(size), CHUNK):
            width = size[begin : begin + CHUNK]
            codes = self._codes(letters[edges[begin] : edges[min(begin + CHUNK, len(size))]])
            unit = np.repeat(np.arange(len(width)), width)
            hits, rows, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for c in range(2, SPAN):
                whole = np.flatnonzero(unit[c:] == unit[:-c]) if len(unit) > c else np.zeros(0, np.int64)
                ends = codes[whole] * self.base * self.base + codes[whole + c]
                fits = (codes[whole] > 0) & (codes[whole + c] > 0)
                whole, ends = whole[fits], ends[fits]
                for b in range(1, c):
                    middle = codes[whole + b]
                    row = np.where(middle > 0, self.row[ends + middle * self.base], 0)
                    hit = np.flatnonzero(row)
                    hits.append(unit[whole[hit]])
                    rows.append(row[hit])
                    weights.append(np.full(len(hit), DECAY ** (c - 2)))
            owner, row, weight = np.concatenate(hits), np.concatenate(rows), np.concatenate(weights)
            low, n = self.first[row], self.first[row + 1] - self.first[row]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)
            out = np.bincount(np.repeat(owner * m, n) + self.landmark[at], self.weight[at] * np.repeat(weight, n), len(width) * m)
            yield begin, out.reshape(len(width), m) ** POWER


def _letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([ord(c) for w in words for c in w], np.uint32), np.array([len(w) for w in words], np.int64)


def _gram(words: list[str], kernel: Kernel) -> np.ndarray:
    return np.concatenate([k for _, k in kernel(*_letters_of(words))])


def _slices(batch: pa.RecordBatch, column: int):
    for begin, data, offsets in tb.slices(batch.column(column)):
        yield begin, len(offsets) - 1, units(data, offsets)


def _unit_lister(batches):
    """(toxic, unit) of the distinct units of each text of (toxic, text)."""
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False)
        for begin, _, found in _slices(batch, 1):
            letters, size, which = distinct_units(found)
            edges = np.append(0, np.cumsum(size))
            pairs = np.unique(found.text[found.sentence] * max(len(size), 1) + which)
            names = ["".join(map(chr, letters[a:b])) for a, b in zip(edges, edges[1:])]
            text, which = pairs // max(len(size), 1), pairs % max(len(size), 1)
            yield pa.RecordBatch.from_arrays([pa.array(toxic[begin + text]), pa.array([names[i] for i in which.tolist()], pa.string())], ["toxic", "unit"])


def _featurer(landmarks: list[str], root: np.ndarray):
    def features(batches):
        """(doc, toxic, features) of the sentences of each text of (doc, toxic, text)."""
        kernel = Kernel(landmarks)
        for batch in batches:
            for begin, _, found in _slices(batch, 2):
                letters, size, which = distinct_units(found)
                like = np.concatenate([k for _, k in kernel(letters, size)]) if len(size) else np.zeros((0, len(landmarks)))
                owners = np.argsort(found.sentence, kind="stable")
                bounds = np.searchsorted(found.sentence[owners], np.arange(len(found.text) + 1))
                for low in range(0, len(found.text), 512):
                    high = min(low + 512, len(found.text))
                    own = owners[bounds[low] : bounds[high]]
                    sums = np.zeros((high - low, len(landmarks)))
                    np.add.at(sums, found.sentence[own] - low, like[which[own]])
                    of = pa.array(begin + found.text[low:high])
                    flat = pa.array((sums @ root).ravel().astype(np.float32))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1) * root.shape[1], pa.int32()), flat)], ["doc", "toxic", "features"])

    return features


class Seen:
    """Values of the units that a task has met, by hash; beyond SEEN of them it begins anew."""

    def __init__(self):
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def values_of(self, hashes: np.ndarray, compute) -> np.ndarray:
        """The values of ascending distinct hashes; compute gives those of the new ones, whose places it is given."""
        place = np.searchsorted(self.hashes, hashes)
        known = np.append(self.hashes, np.uint64(0))[place] == hashes
        known &= place < len(self.hashes)
        value = np.append(self.values, 0.0)[place]
        new = np.flatnonzero(~known)
        if len(new):
            value[new] = compute(new)
            if len(self.hashes) + len(new) > SEEN:
                self.hashes, self.values = hashes, value
            else:
                self.hashes, self.values = np.insert(self.hashes, place[new], hashes[new]), np.insert(self.values, place[new], value[new])
        return value


@dataclass
class Machine:
    """A fitted machine: landmarks, what each adds to a sentence, the sentence's bias, and the weights and offset of the calibration."""

    landmarks: list[str]
    alpha: np.ndarray
    bias: float
    weights: np.ndarray
    offset: float

    def scores(self, batch: pa.RecordBatch, column: int, kernel: Kernel, seen: Seen | None = None) -> np.ndarray:
        """The score of each text, from its most toxic sentences and their number; of none, what the bias alone gives.

        A unit that was seen before keeps its value, and is not compared with the landmarks again.
        """
        seen = Seen() if seen is None else seen
        values, many = np.full((batch.num_rows, WORST), self.bias), np.zeros(batch.num_rows)
        for begin, n, found in _slices(batch, column):
            if not len(found.sentence):
                continue
            hashes, at, which = hashed_units(found)
            value = seen.values_of(hashes, lambda new: np.concatenate([k @ self.alpha for _, k in kernel(*letters_at(found, at[new]))]))
            sums = np.bincount(found.sentence, value[which], len(found.text)) + self.bias
            order = np.lexsort((-sums, found.text))
            count = np.bincount(found.text, minlength=n)
            place = np.arange(len(order)) - (np.cumsum(count) - count)[found.text]
            many[begin : begin + n] = count
            for k in range(WORST):
                at = order[place == k]
                values[begin + found.text[at], k] = sums[at]
        for k in range(1, WORST):
            values[:, k] = np.where(many > k, values[:, k], np.minimum(values[:, k - 1], self.bias))
        line = np.column_stack([values, np.log1p(many)]) @ self.weights + self.offset
        return np.round(1 / (1 + np.exp(-np.clip(line, -30, 30))), 6)


def _scorer(machine: Machine):
    def score(batches):
        kernel, seen = Kernel(machine.landmarks), Seen()
        for batch in batches:
            last = batch.num_columns - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(machine.scores(batch, last, kernel, seen))], [*batch.schema.names[:last], "score"])

    return score


def choose_landmarks(texts: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """Units that tell toxic texts (toxic, text) from clean ones and aren't much alike, then units drawn by hash, toxic or not."""
    listed = in_python(texts.select("toxic", "text"), _unit_lister, "toxic double, unit string").where(F.length("unit") > 3)
    counted = cut(listed.groupBy("unit").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")))
    share = (F.col("pos") + 0.5) / n_toxic, (F.col("n") - F.col("pos") + 0.5) / n_clean
    telling = counted.where(share[0] > share[1]).orderBy(F.desc(F.round(F.col("pos") / n_toxic * F.log(share[0] / share[1]), 9)), "unit").limit(POOL)
    pool = [r[0] for r in telling.select("unit").collect()]
    drawn = [r[0] for r in counted.orderBy(F.xxhash64("unit"), "unit").limit(BACKGROUND).select("unit").collect()]
    forget(counted)
    chosen: list[int] = []
    if pool:
        like = _gram(pool, Kernel(pool)) ** (1 / POWER)
        like = like / np.diag(like)[:, None]  # now rows are of unit length too
        for i in range(len(pool)):
            if len(chosen) < LANDMARKS and all(like[i, j] < ALIKE for j in chosen):
                chosen.append(i)
    return list(dict.fromkeys([*(pool[i] for i in chosen), *drawn]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, docs_of_class: int = DOCS_OF_CLASS, rounds: int = ROUNDS) -> Machine | None:
    """A machine fitted on the sentences of labelled documents; None if the labels have one class only.

    docs has doc_id and text, labels doc_id and toxic. At first all sentences of toxic documents count as toxic; in each
    further round those that the last machine takes for toxic do, and the worst one of each document, and the others count
    as nothing. A fifth of the documents calibrates the values of its WORST sentences (those that a text lacks are like
    an empty one) and the logarithm of their number, with weights that undo the sampling.
    """
    marked = cut(labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("double")).alias("toxic")))
    marked = cut(docs.select("doc_id").distinct().join(marked, "doc_id"))
    n = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    if not n.get(0.0) or not n.get(1.0):
        return None
    size = F.when(F.col("toxic") == 1, n[1.0]).otherwise(n[0.0])
    picked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), size) < docs_of_class)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS))
    texts = cut(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(checked_broadcast(picked), "doc_id").withColumn("fold", fold))
    there = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    landmarks = choose_landmarks(texts, there[1.0], there[0.0])
    if not landmarks:
        return None
    gram = _gram(landmarks, Kernel(landmarks))
    gram = gram / np.diag(gram)[:, None]
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    named = texts.select(F.struct(F.monotonically_increasing_id().alias("row"), "fold").alias("doc"), "toxic", "text")
    # texts are dealt anew, as they are far smaller than the features of their sentences, which are written once and never shuffled
    rows = in_python(named.select(F.to_json("doc").alias("doc"), "toxic", "text").repartition(FIT_PARTS), _featurer(landmarks, root), "doc string, toxic double, features array<float>")
    featured = cut(rows.select("doc", F.get_json_object("doc", "$.fold").cast("int").alias("fold"), "toxic", "features"))
    rows = featured.withColumn("features", array_to_vector(F.col("features").cast("array<double>")))
    train = rows.where("fold > 0")
    if train.select("toxic").distinct().count() < 2 or rows.where("fold = 0").select("toxic").distinct().count() < 2:
        train = rows
    kept, model = train, None
    for _ in range(rounds):
        m = {r[0]: r[1] for r in kept.groupBy("toxic").count().collect()}
        weighed = kept.withColumn("weight", F.when(F.col("toxic") == 1, (m[0.0] + m[1.0]) / (2 * m[1.0])).otherwise((m[0.0] + m[1.0]) / (2 * m[0.0])))
        model = LinearSVC(featuresCol="features", labelCol="toxic", weightCol="weight", maxIter=40, regParam=1e-4).fit(weighed)
        valued = model.transform(train).withColumn("value", F.round(vector_to_array("rawPrediction")[1], 9))
        worst = valued.groupBy("doc").agg(F.max("value").alias("worst"))  # a row for each document of the sample
        kept = valued.join(checked_broadcast(worst), "doc").where("toxic = 0 OR value > 0 OR value = worst").select(*train.columns)
    scored = model.transform(rows).withColumn("value", vector_to_array("rawPrediction")[1])
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("value"))))
    placed = [F.max(F.when(F.col("place") == k + 1, F.col("value"))).alias(f"v{k}") for k in range(WORST)]
    by_doc = ranked.groupBy("doc").agg(F.max("fold").alias("fold"), F.max("toxic").alias("toxic"), F.count("*").alias("many"), *placed)
    for k in range(1, WORST):
        by_doc = by_doc.withColumn(f"v{k}", F.coalesce(f"v{k}", F.least(f"v{k - 1}", F.lit(float(model.intercept)))))
    held = by_doc.where("fold = 0")
    if held.select("toxic").distinct().count() < 2:
        held = by_doc
    weights = F.when(F.col("toxic") == 1, n[1.0] / there[1.0]).otherwise(n[0.0] / there[0.0])
    held = cut(held.select("toxic", array_to_vector(F.array(*[f"v{k}" for k in range(WORST)], F.log1p("many"))).alias("value"), weights.alias("weight")).coalesce(1))
    line = LogisticRegression(featuresCol="value", labelCol="toxic", weightCol="weight", regParam=3e-3).fit(held)
    alpha = root @ model.coefficients.toArray()
    forget(marked, texts, featured, held)
    return Machine(landmarks, alpha, float(model.intercept), line.coefficients.toArray(), float(line.intercept))


def toxicity(docs: DataFrame, labels: DataFrame, docs_of_class: int = DOCS_OF_CLASS) -> DataFrame:
    """(doc_id, score) of each row of docs: how likely its text is toxic, from 0 to 1.

    docs has doc_id (long) and text, labels doc_id and toxic (1 or 0). The kernel of two units (see units) counts their
    common subsequences of three letters, each weighed by the letters it leaves out on both sides, so an insult that is
    stretched, or has letters, marks or blanks put into it, stays like its plain form. A sentence's kernel adds up those of
    its units; landmarks (Nyström) turn it into features of a linear machine, and a text counts as its worst sentences.

    Fitting takes a bounded sample of labelled documents (see fit_toxicity), scoring one scan of whole texts without a
    shuffle. Null and empty texts are scored as texts without sentences; repeated rows and null ids count each, conflicting
    labels as toxic; labels of unknown documents and further columns are ignored. Labels of one class only teach nothing:
    scores are 0. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    machine = fit_toxicity(texts, labels, docs_of_class)
    if machine is None:
        return texts.select("doc_id", F.lit(0.0).alias("score"))
    return in_python(texts, _scorer(machine), "doc_id long, score double")
