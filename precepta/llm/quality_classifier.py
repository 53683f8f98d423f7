"""Quality classification by co-training a text view and a metadata view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precepta.llm.common import alphanumeric_words, cut

#: The views are fitted on about so many labelled documents at most, and exchange labels on as many unlabelled ones.
LABELLED_DOCS, POOL_DOCS = 20_000, 20_000
#: Rounds of exchange, how sure a view must be to give a label, and what such a label weighs.
ROUNDS, SURE, PSEUDO_WEIGHT = 2, 0.97, 0.3
#: Partitions of the bounded tables that are fitted on.
FIT_PARTS = 6
#: A text feature occurs in so many of the fitted documents at least; there are at most so many of them.
LEAST_DOCS, FEATURES = 8, 20_000
REJECT = 0.5
#: Regularisation of the text view, half of it L1.
TEXT_PENALTY = 3e-4
#: Bits of the hashed metadata features.
META_BITS = 10


def _share(count: Column, of: Column) -> Column:
    return count / F.greatest(of, F.lit(1))


def with_views(docs: DataFrame) -> DataFrame:
    """docs with what the views see: _qc_terms, the distinct words and marks of the text, and the metadata columns.

    Metadata: language, source, length, and the layout: shares of capitals, marks, digits and repeated words, words in a
    line, characters in a word. It says nothing of which words a text has.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marks = F.regexp_extract_all("_qc_whole", F.lit(r"[!-+/:-@\[-`{-~]+"), F.lit(0))
    docs = docs.withColumn("_qc_whole", text).withColumn("_qc_words", alphanumeric_words(text)).withColumn("_qc_signs", marks)
    docs = docs.withColumn("_qc_distinct", F.array_distinct("_qc_words"))
    chars = F.length("_qc_whole")
    n, lines = F.size("_qc_words"), F.regexp_count("_qc_whole", F.lit("\n")) + 1
    meta = {
        "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "length": F.log1p(chars),
        "capitals": _share(F.regexp_count("_qc_whole", F.lit("[A-Z]")), chars),
        "digits": _share(F.regexp_count("_qc_whole", F.lit("[0-9]")), chars),
        "marks": _share(F.size("_qc_signs"), n),
        "repeats": 1 - _share(F.size("_qc_distinct"), n),
        "line": F.log1p(n / lines),
        "word": _share(chars, n) / 10,
    }
    docs = docs.select("*", *[c.alias(f"_qc_{k}") for k, c in meta.items()], F.concat("_qc_distinct", F.array_distinct("_qc_signs")).alias("_qc_terms"))
    return docs.drop("_qc_whole", "_qc_words", "_qc_signs", "_qc_distinct")


META = ["lang", "source", "length", "capitals", "digits", "marks", "repeats", "line", "word"]


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _chance(model: LogisticRegressionModel, df: DataFrame, into: str) -> DataFrame:
    scored = model.transform(df)
    return scored.withColumn(into, vector_to_array("_qc_probability")[1]).drop("_qc_raw", "_qc_probability", "_qc_prediction")


def _fit(rows: DataFrame, features: str, regularisation: float, l1: float) -> LogisticRegressionModel:
    names = dict(labelCol="_qc_bad", weightCol="_qc_weight", rawPredictionCol="_qc_raw", probabilityCol="_qc_probability", predictionCol="_qc_prediction")
    return LogisticRegression(featuresCol=features, regParam=regularisation, elasticNetParam=l1, maxIter=40, **names).fit(rows)


@dataclass
class CoTrained:
    """A fitted classifier: vectorizer of the text view, both views, and what combines them."""

    vectorizer: CountVectorizerModel
    text: LogisticRegressionModel
    meta: LogisticRegressionModel
    both: LogisticRegressionModel

    def score(self, docs: DataFrame) -> DataFrame:
        """docs with p_bad_text, p_bad_meta and p_bad."""
        scored = _views(self.vectorizer, with_views(docs))
        scored = _chance(self.meta, _chance(self.text, scored, "p_bad_text"), "p_bad_meta")
        scored = _chance(self.both, _joint(scored), "p_bad")
        return scored.select(*docs.columns, "p_bad_text", "p_bad_meta", "p_bad")


def _views(vectorizer: CountVectorizerModel, df: DataFrame) -> DataFrame:
    hasher = FeatureHasher(inputCols=[f"_qc_{m}" for m in META], outputCol="_qc_meta", numFeatures=1 << META_BITS)
    return hasher.transform(vectorizer.transform(df))


def _joint(df: DataFrame) -> DataFrame:
    df = df.withColumn("_qc_t", _logit(F.col("p_bad_text"))).withColumn("_qc_m", _logit(F.col("p_bad_meta")))
    return VectorAssembler(inputCols=["_qc_t", "_qc_m"], outputCol="_qc_joint").transform(df)


def _sample(df: DataFrame, rows: int, n: int) -> DataFrame:
    """About `rows` of the n rows of df by a hash of doc_id, all if they are fewer."""
    return df.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(n)) < rows) if n > rows else df


def co_train(docs: DataFrame, labels: DataFrame, labelled_docs: int = LABELLED_DOCS, pool_docs: int = POOL_DOCS, rounds: int = ROUNDS) -> CoTrained | None:
    """Fits the views on labelled documents, lets them exchange confident labels, and calibrates their combination.

    A document is bad if its quality is 0 or it is toxic. A fifth of the labelled sample, by hash, is held out: neither
    view is fitted on it, and the combination, which calibrates the views, is fitted on it alone. In each round a view
    gives the other the pool documents of which it is sure. None if the labels have one class only.
    """
    marked = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False)).cast("double")).alias("_qc_bad"))
    marked = cut(marked)
    ids = cut(docs.select("doc_id").join(marked, "doc_id", "left").groupBy("doc_id").agg(F.max("_qc_bad").alias("_qc_bad")).where("doc_id IS NOT NULL"))
    n_marked, n_all = ids.agg(F.count("_qc_bad"), F.count("*")).first()
    picked = _sample(ids.where("_qc_bad IS NOT NULL"), labelled_docs, n_marked).union(_sample(ids.where("_qc_bad IS NULL"), pool_docs, n_all - n_marked))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5))
    seen = cut(with_views(docs.select("doc_id", "text", "lang", "source").join(picked, "doc_id")).withColumn("_qc_fold", fold))
    if seen.select("_qc_bad").where("_qc_bad IS NOT NULL").distinct().count() < 2:
        return None
    vectorizer = CountVectorizer(inputCol="_qc_terms", outputCol="_qc_text", minDF=float(LEAST_DOCS), vocabSize=FEATURES, binary=True)
    rare = seen.select(F.explode("_qc_terms").alias("t")).groupBy("t").count().where(F.col("count") >= LEAST_DOCS).isEmpty()
    vectorizer = (vectorizer.setMinDF(1.0) if rare else vectorizer).fit(seen)
    rows = cut(_views(vectorizer, seen).select("doc_id", "_qc_fold", "_qc_bad", "_qc_text", "_qc_meta", F.lit(1.0).alias("_qc_weight")).coalesce(FIT_PARTS))
    train, held, pool = rows.where("_qc_bad IS NOT NULL AND _qc_fold > 0"), rows.where("_qc_bad IS NOT NULL AND _qc_fold = 0"), rows.where("_qc_bad IS NULL")
    if min(x.select("_qc_bad").distinct().count() for x in (train, held)) < 2:
        train = held = rows.where("_qc_bad IS NOT NULL")  # too few labels to hold any out
    text, meta = _fit(train, "_qc_text", TEXT_PENALTY, 0.5), _fit(train, "_qc_meta", 1e-3, 0.0)
    for _ in range(rounds):
        guessed = cut(_chance(meta, _chance(text, pool, "_qc_pt"), "_qc_pm"))

        def sure(chance: str, guessed=guessed) -> DataFrame:
            given = guessed.where(f"{chance} >= {SURE} OR {chance} <= {1 - SURE}").withColumn("_qc_bad", (F.col(chance) > 0.5).cast("double"))
            return given.withColumn("_qc_weight", F.lit(PSEUDO_WEIGHT)).select(*train.columns)

        text, meta = _fit(train.union(sure("_qc_pm")), "_qc_text", TEXT_PENALTY, 0.5), _fit(train.union(sure("_qc_pt")), "_qc_meta", 1e-3, 0.0)
    both = _fit(_joint(_chance(meta, _chance(text, held, "p_bad_text"), "p_bad_meta")), "_qc_joint", 1e-3, 0.0)
    return CoTrained(vectorizer, text, meta, both)


def classify_quality(docs: DataFrame, labels: DataFrame, reject: float = REJECT, labelled_docs: int = LABELLED_DOCS, pool_docs: int = POOL_DOCS) -> DataFrame:
    """docs with p_bad_text, p_bad_meta, p_bad and kept (p_bad below reject); a row for each row of docs.

    docs has doc_id, text, lang and source, labels has doc_id, quality and toxic. All documents are scored on their
    whole texts, where they lie: fitting takes a bounded sample, scoring one scan without a shuffle.

    Null and empty texts are scored as texts without words. Null languages and sources count as one of their own.
    Conflicting labels count as bad; labels of unknown documents are ignored. Without labels of both kinds nothing can
    be learnt: chances are 0.5 and every row is kept. An empty table gives an empty result. Columns of docs named as
    the new ones are replaced.
    """
    docs = docs.drop("p_bad_text", "p_bad_meta", "p_bad", "kept")
    model = co_train(docs, labels, labelled_docs, pool_docs)
    if model is None:
        return docs.select("*", *[F.lit(0.5).alias(c) for c in ("p_bad_text", "p_bad_meta", "p_bad")], F.lit(True).alias("kept"))
    return model.score(docs).withColumn("kept", F.col("p_bad") < reject)
