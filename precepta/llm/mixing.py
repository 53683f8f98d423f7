"""Mixing sources to target weights. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precepta.llm.common import BROADCAST_ROWS, SPACED, cut

#: Weights of the sources in order of their names, repeating; a source is taken so many times at most.
WEIGHTS, MAX_REPEATS = (5, 2, 1), 3
#: Shares that a source's documents are dealt over where its rate can't be broadcast.
SHARES = 256
#: A document's hash is a number below 1 << BITS; a source's draws may begin at so many places of that circle.
BITS, STARTS = 52, 1024


def _running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """df with each of sums as the sum over all rows before its own in the order.

    The rows are dealt by ranges of the order, so that each partition needs no more than the sums of those before it.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    totals = parts.groupBy("part").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = totals.select("part", *[F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"{k}_start") for k in sums])
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"{k}_own") for k, c in sums.items()])
    return local.join(F.broadcast(starts), "part").select(*df.columns, *[(F.col(f"{k}_start") + F.col(f"{k}_own")).alias(k) for k in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size): target words by weight, up to max_repeats times the size.

    What is above a source's limit is shared again by weight among the others, until none is above. So the capped sources
    come first in the order of limit / weight, and sums along it give the level, words for each unit of weight, at which
    the first of the others stays below its limit.
    """
    ranked = _running(sizes, [F.col("source").isNull().cast("int"), F.col("source")], rank=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    known = ranked.select("source", "source_size", "rank", (max_repeats * F.col("source_size")).alias("most"), weight.alias("weight"))
    run = _running(known, [F.col("most") / F.col("weight"), F.col("rank")], capped=F.col("most"), capped_weight=F.col("weight"))
    run = cut(run)
    total, weights_ = known.agg(F.sum("source_size"), F.sum("weight")).first()
    words, free = (F.lit(total) - F.col("capped")).cast("double"), (F.lit(weights_) - F.col("capped_weight")).cast("double")
    level = run.where(words * F.col("weight") / free <= F.col("most")).agg(F.min(F.struct("capped", words.alias("words"), free.alias("free")))).first()[0]
    share = F.lit(level["words"]) * F.col("weight").cast("double") / F.lit(level["free"]) if level else F.lit(0.0)
    return run.select("source", "source_size", F.least(share, F.col("most").cast("double")).alias("target"))


def _number(doc_id: Column, seed: str) -> Column:
    """The hash of seed and doc_id, below 1 << BITS."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, BITS // 4), 16, 10).cast("long")


def _chance(rate: Column) -> Column:
    """The fraction of rate as a number of hashes."""
    return F.floor((rate - F.floor(rate)) * F.lit(float(1 << BITS))).cast("long")


def copies(rate: Column, doc_id: Column, seed: str, start: Column | int = 0) -> Column:
    """floor(rate) copies, and one more with the chance of the fraction: the hash of seed and doc_id, counted from start on, falls below it."""
    turned = F.pmod(_number(doc_id, seed) - F.lit(start) * F.lit((1 << BITS) // STARTS), F.lit(1 << BITS))
    return F.floor(rate).cast("long") + (turned < _chance(rate)).cast("long")


def source_starts(sized: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """(mix_of, mix_start): where each source's draws begin, so that its taken words come nearest to its target.

    Every start gives each document the same chance; the words taken, averaged over starts, are the target, and a step of
    the start changes few documents, so that some start is near it. One pass adds up the words of each source by
    STARTS-ths of the hash, and there those of the first part that a fraction's last, broken step takes. Then each of a
    source's filled places is tried as a start, ties going to the first; a source has 3 * STARTS rows there at most.
    """
    step = (1 << BITS) // STARTS
    at, chance = _number(F.col("doc_id"), seed), _chance(F.col("mix_rate"))
    drawn = _with_rates(sized, targets).select("mix_of", "mix_source_size", "mix_target", "mix_rate", "size", at.alias("at"), chance.alias("chance"))
    keys = ["mix_of", "mix_source_size", "mix_target", "mix_rate", "chance"]
    broken = F.when(F.col("at") % step < F.col("chance") % step, F.col("size")).otherwise(0)
    places = cut(drawn.groupBy(*keys, F.floor(F.col("at") / step).cast("long").alias("place")).agg(F.sum("size").alias("words"), F.sum(broken).alias("broken")))
    along = Window.partitionBy(*keys).orderBy("place")
    nothing = F.lit(0).cast("long")
    before = F.coalesce(F.sum("words").over(along.rangeBetween(Window.unboundedPreceding, -1)), nothing)
    asked = places.select(*keys, (F.col("place") + F.floor(F.col("chance") / step)).alias("place"), nothing.alias("words"), nothing.alias("broken"), F.col("place").alias("start"), before.alias("before"))
    none = [F.lit(None).cast("long").alias("start"), nothing.alias("before")]
    twice = places.select(*keys, F.explode(F.array("place", F.col("place") + STARTS)).alias("place"), "words", "broken", *none)
    until = F.coalesce(F.sum("words").over(along.rangeBetween(Window.unboundedPreceding, -1)), nothing)
    extra = until + F.sum("broken").over(along.rangeBetween(0, 0)) - F.col("before")
    wanted = F.col("mix_target") - F.floor("mix_rate") * F.col("mix_source_size")
    tried = twice.unionByName(asked).withColumn("extra", extra).where("start IS NOT NULL")
    best = tried.groupBy("mix_of").agg(F.min(F.struct(F.abs(F.col("extra") - wanted).alias("off"), "start")).alias("best"))
    return best.select("mix_of", F.col("best.start").alias("mix_start"))


def _with_rates(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """docs with the columns of targets of its source.

    By broadcast if the sources are few (they are counted); else by a shuffle that deals each source's documents over
    SHARES keys, so that a hot source doesn't meet in one task.
    """
    same = docs["source"].cast("string").eqNullSafe(targets["mix_of"])
    if targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(targets), same)
    dealt = targets.withColumn("mix_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return docs.withColumn("mix_own", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).cast("int")).join(dealt, same & (F.col("mix_own") == F.col("mix_share")))


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size) of docs, and (mix_of, mix_source_size, mix_target, mix_rate, mix_start) of its sources."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(SPACED)), F.lit(0)).cast("long")
    sized = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(F.lit(0.0))
    rates = cut(targets.select(F.col("source").alias("mix_of"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), rate.alias("mix_rate")))
    starts = source_starts(sized, rates, seed).withColumnRenamed("mix_of", "mix_same")
    return sized, cut(rates.join(starts, F.col("mix_of").eqNullSafe(F.col("mix_same")), "left").drop("mix_same"))


def mixing_rates(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """Per row of docs (doc_id, source, text): doc_id, size, source_size, target, taken.

    size: words between white space, 0 for null; source_size: their sum over the source; target: the source's share of
    all words by weight (see source_targets; a null source is one, last in order); taken: size times the copies of the
    document in the mix, floor(rate) of them and one more with the chance of the rate's fraction, drawn from where the
    source's taken words come nearest to its target (see source_starts). Reruns agree; rows of one
    doc_id and source are copied alike. Sources without words have target 0 and take none; an empty table gives an empty
    result. Further columns are ignored. Texts are read once, not shuffled.
    """
    sized, targets = mixing_plan(docs, weights, max_repeats, seed)
    taken = F.col("size") * copies(F.col("mix_rate"), F.col("doc_id"), seed, F.col("mix_start"))
    return _with_rates(sized, targets).select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken.alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """The mix itself: the columns of docs and copy (from 1 on), each row as often as mixing_rates takes it.

    Rows of sources without words are not emitted. docs is read twice, and not shuffled where the sources are few. A
    column copy of docs is replaced; other names may be any.
    """
    _, targets = mixing_plan(docs, weights, max_repeats, seed)
    out = _with_rates(docs.select("doc_id", "source", F.struct("*").alias("mix_doc")), targets)
    n = copies(F.col("mix_rate"), F.col("doc_id"), seed, F.col("mix_start"))
    kept = [F.col("mix_doc").getField(c).alias(c) for c in docs.columns if c != "copy"]
    return out.where(n > 0).select(*kept, F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("copy"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 3 * source_size AS most, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
-- the capped sources are a prefix in order of most / weight: the level is the first that the next source stays below
o AS (SELECT *, coalesce(sum(most) OVER p, 0) AS before, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS free, sum(source_size) OVER () AS total
      FROM w WINDOW p AS (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT CAST(total - before AS DOUBLE) AS words, CAST(free AS DOUBLE) AS weight FROM o WHERE CAST(total - before AS DOUBLE) * weight / free <= most ORDER BY before LIMIT 1),
t AS (SELECT source, source_size, least(l.words * CAST(o.weight AS DOUBLE) / l.weight, CAST(most AS DOUBLE)) AS target FROM o, l),
r AS (SELECT doc_id, size, source, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0 END AS rate,
      CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS number
      FROM d JOIN t USING (source) UNION ALL BY NAME
      SELECT doc_id, size, d.source, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0 END AS rate,
      CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS number
      FROM d JOIN t ON d.source IS NULL AND t.source IS NULL),
c AS (SELECT *, CAST(floor((rate - floor(rate)) * 4503599627370496.0) AS BIGINT) AS chance FROM r),
-- words of each source by 1,024ths of the hash, and those that the last, broken step takes there
h AS (SELECT source, any_value(target - floor(rate) * source_size) AS wanted, any_value(chance) AS chance, number // 4398046511104 AS place, sum(size) AS words, sum(CASE WHEN number % 4398046511104 < chance % 4398046511104 THEN size ELSE 0 END) AS broken FROM c GROUP BY source, place),
e AS (SELECT a.source, a.place AS start, any_value(a.wanted) AS wanted, sum(CASE WHEN (b.place - a.place + 1024) % 1024 < a.chance // 4398046511104 THEN b.words WHEN (b.place - a.place + 1024) % 1024 = a.chance // 4398046511104 THEN b.broken ELSE 0 END) AS extra
      FROM h a JOIN h b ON a.source IS NOT DISTINCT FROM b.source GROUP BY a.source, a.place),
b AS (SELECT source, start FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(CAST(extra AS DOUBLE) - wanted), start) = 1)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN (number - start * 4398046511104 + 4503599627370496) % 4503599627370496 < chance THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source
"""
