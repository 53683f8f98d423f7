"""The demand queue: requests are upserted, retried and refreshed by age; a keyed table that micro-batches keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Days until an empty answer is retried and a fetched one is refreshed, and until the alarms.
RETRY_DAYS, REFRESH_DAYS, SILENCE_DAYS, BACKLOG_DAYS = 90, 180, 5, 14
PENDING, EMPTY, FETCHED, FAILED = "PENDING", "EMPTY", "FETCHED", "FAILED"
QUEUE = "key string, state string, times long, first_seen date, last_seen date, searched date, attempts long"


def demand(requests: DataFrame) -> DataFrame:
    """(key, times, first_seen, last_seen) of requests (key, ts), combined before they are shuffled."""
    return requests.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("times"), F.min(F.to_date("ts")).alias("first_seen"), F.max(F.to_date("ts")).alias("last_seen"))


def upsert_requests(queue: DataFrame, requests: DataFrame) -> DataFrame:
    """queue with requests (key, ts): new keys are pending; known ones keep their state and count on."""
    new, old = demand(requests).alias("n"), queue.alias("o")
    joined = old.join(new, F.col("o.key") == F.col("n.key"), "full_outer")
    return joined.select(
        F.coalesce("o.key", "n.key").alias("key"),
        F.coalesce("o.state", F.lit(PENDING)).alias("state"),
        (F.coalesce("o.times", F.lit(0)) + F.coalesce("n.times", F.lit(0))).alias("times"),
        F.coalesce("o.first_seen", "n.first_seen").alias("first_seen"),
        F.greatest("o.last_seen", "n.last_seen").alias("last_seen"),
        F.col("o.searched").alias("searched"),
        F.coalesce("o.attempts", F.lit(0)).alias("attempts"),
    )


def mark(queue: DataFrame, outcomes: DataFrame, today: Column) -> DataFrame:
    """queue with the states of outcomes (key, outcome), one attempt more, searched today."""
    joined = queue.join(outcomes, "key", "left")
    done = F.col("outcome").isNotNull()
    return joined.select("key", F.coalesce("outcome", "state").alias("state"), "times", "first_seen", "last_seen", F.when(done, today).otherwise(F.col("searched")).alias("searched"), (F.col("attempts") + done.cast("long")).alias("attempts"))


def is_due(today: Column) -> Column:
    """Pending ones always; empty ones after RETRY_DAYS or without a date; fetched ones after REFRESH_DAYS."""
    age = F.datediff(today, "searched")
    return F.when(F.col("state") == PENDING, True).when(F.col("state") == EMPTY, age.isNull() | (age >= RETRY_DAYS)).when(F.col("state") == FETCHED, age >= REFRESH_DAYS).otherwise(False)


def priority() -> Column:
    return F.when(F.col("state") == PENDING, 0).when(F.col("state") == EMPTY, 1).when(F.col("state") == FETCHED, 2).otherwise(3)


def due(queue: DataFrame, covered: DataFrame, today: Column) -> DataFrame:
    """Due entries that aren't covered (key), with priority; to be taken in order of priority, most requests, key."""
    return queue.where(F.coalesce(is_due(today), F.lit(False))).join(covered.select("key").distinct(), "key", "left_anti").withColumn("priority", priority())


def due_requests(requests: DataFrame, queue: DataFrame, today: Column) -> DataFrame:
    """requests (key, ...) whose queue entries are due; their order columns stay."""
    return requests.join(queue.where(F.coalesce(is_due(today), F.lit(False))).select("key").distinct(), "key", "left_semi")


def refresh_requests(queue: DataFrame, today: Column, days: int = REFRESH_DAYS) -> DataFrame:
    """queue with fetched entries of that age set back to pending, so that they are fetched again."""
    old = (F.col("state") == FETCHED) & (F.datediff(today, "searched") >= days)
    return queue.withColumn("state", F.when(F.coalesce(old, F.lit(False)), PENDING).otherwise(F.col("state")))


def latest_fetched(queue: DataFrame) -> DataFrame:
    """(key, searched): what was fetched on the last day that anything was. The day comes from an aggregate of one row."""
    fetched = queue.where(F.col("state") == FETCHED)
    last = fetched.agg(F.max("searched")).first()[0]
    return fetched.where(F.col("searched") == F.lit(last)).select("key", "searched")


def alarms(queue: DataFrame, today: Column) -> DataFrame:
    """(waiting, silent_days, oldest_days, silence, backlog) in one row."""
    one = queue.agg(F.count_if(is_due(today)).alias("waiting"), F.datediff(today, F.max("searched")).alias("silent_days"), F.max(F.when(F.col("state") == PENDING, F.datediff(today, "first_seen"))).alias("oldest_days"))
    return one.withColumn("silence", F.coalesce((F.col("waiting") > 0) & (F.col("silent_days") >= SILENCE_DAYS), F.lit(False))).withColumn("backlog", F.coalesce(F.col("oldest_days") >= BACKLOG_DAYS, F.lit(False)))


def keep_queue(requests: DataFrame, path: str, checkpoint: str):
    """Starts a stream of requests (key, ts) into the queue table under path, a version for each micro-batch.

    Each batch reads the version before its own and writes its own anew, so a batch that is repeated after a failure gives
    the same table. read_queue() reads the latest whole version; those that no batch can be repeated from are deleted.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        upsert_requests(read_queue(spark, path, before=number), batch).write.mode("overwrite").parquet(f"{path}/version={number}")
        files, _ = _files(spark, path)
        for old in _versions(spark, path):
            if old < number - 1:
                files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}"), True)

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, path: str) -> list[int]:
    files, place = _files(spark, path)
    return [int(str(f.getPath().getName())[8:]) for f in files.listStatus(place) if str(f.getPath().getName()).startswith("version=")] if files.exists(place) else []


def read_queue(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The latest version of the queue (before a batch, if it is given); empty if there is none."""
    files, _ = _files(spark, path)
    found = [v for v in _versions(spark, path) if (before is None or v < before) and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}/_SUCCESS"))]
    return spark.read.schema(QUEUE).parquet(f"{path}/version={max(found)}") if found else spark.createDataFrame([], QUEUE)


def sessions(events: DataFrame, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, begin, end, n) of sessions of events (user_id, ts), for batches and, with a watermark, for streams."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")
