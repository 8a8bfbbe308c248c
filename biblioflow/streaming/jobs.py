"""Jobs that arrive as files, processed at least once with a bounded number of attempts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from biblioflow.sources.shared import checkpointed

MOST_ATTEMPTS = 3
BACK_OFF = 10  # seconds, times the attempt


def after_attempt(jobs: DataFrame, ok: str) -> DataFrame:
    """`jobs` (with attempts INT and the outcome column `ok`) with `state` done, retry or dead, and `delay` in seconds
    before a retry. A null outcome failed."""
    attempt = F.coalesce(F.col("attempts"), F.lit(0)) + 1
    state = F.when(F.coalesce(F.col(ok), F.lit(False)), "done").when(attempt < MOST_ATTEMPTS, "retry").otherwise("dead")
    return jobs.withColumns({"state": state, "delay": F.when(state == "retry", attempt * BACK_OFF), "attempts": attempt})


def consume(spark: SparkSession, source: str, schema: str, checkpoint: str, handle: Callable[[DataFrame], DataFrame], store: str, key: str) -> StreamingQuery:
    """Process the job files of a folder, one file a batch, and keep one row per key in `store` (parquet).

    A batch that is delivered again replaces its own folder, and rows of keys that are stored already are left out, so
    a replay changes nothing. `handle` maps a batch of jobs to rows with `key`; a key occurs once per batch.
    """
    jobs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)

    def batch(rows: DataFrame, number: int) -> None:
        done = handle(rows).dropDuplicates([key])
        earlier = _stored(rows.sparkSession, store, number, done.schema)
        done.join(earlier.select(key), key, "left_anti").write.mode("overwrite").parquet(f"{store}/batch={number}")

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def consume_with_retries(spark: SparkSession, source: str, schema: str, checkpoint: str, handle: Callable[[DataFrame], DataFrame], store: str, dead: str, key: str) -> StreamingQuery:
    """`consume` of jobs that may fail: `schema` has attempts INT, and `handle` adds ok BOOLEAN to the jobs of a batch.

    Done jobs go to `store`; failed ones are written back into `source` with their attempts and not_before TIMESTAMP
    (which `schema` has too), until the last attempt puts them into `dead`. A job that isn't due yet is written back
    as it is. Each run of the stream takes the files that are there when it starts, so a retry waits for a later run.
    """
    jobs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(source)

    def batch(rows: DataFrame, number: int) -> None:
        due = F.coalesce(F.col("not_before") <= F.current_timestamp(), F.lit(True))
        judged = checkpointed(after_attempt(handle(rows.where(due)), "ok"))  # `handle` acts once, whatever is written of it
        done = judged.where("state = 'done'").dropDuplicates([key])
        earlier = _stored(rows.sparkSession, store, number, done.schema)
        done.join(earlier.select(key), key, "left_anti").write.mode("overwrite").parquet(f"{store}/batch={number}")
        judged.where("state = 'dead'").write.mode("overwrite").parquet(f"{dead}/batch={number}")
        later = F.current_timestamp() + F.make_dt_interval(secs=F.col("delay"))
        again = judged.where("state = 'retry'").withColumn("not_before", later).select(rows.columns).unionByName(rows.where(~due))
        if not again.isEmpty():
            again.coalesce(1).write.mode("overwrite").json(f"{source}/again-{number}")

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored(spark: SparkSession, store: str, before: int, schema) -> DataFrame:
    """Rows of earlier batches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not before or not fs.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).parquet(store).where(F.col("batch") < before).drop("batch")


def recomputed(spark: SparkSession, log: str, schema: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], out: str) -> StreamingQuery:
    """Whenever the log has grown, the whole snapshot again, in place of the last one."""
    news = spark.readStream.schema(schema).parquet(log)

    def batch(rows: DataFrame, number: int) -> None:
        build(rows.sparkSession.read.schema(schema).parquet(log)).write.mode("overwrite").parquet(out)

    return news.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
