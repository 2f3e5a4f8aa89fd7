"""A write-ahead journal of classifier replies.

Calls cost money, so an answer must survive whatever happens after it. The
executors append every finished batch to ``<journal>/replies`` (parquet, one
file per task): its key (SHA-256 of the request, so of its content), its
pairs, its status and the reply. A task holds ``journal_every`` batches and its
file appears when the task is done, before the job is (Hadoop's version 2 of
the commit): a lost executor or driver repeats at most the batches of the tasks
that were running. An error that no retry mends does not fail the task: its
batch is journalled with the message, the task's other batches are left out,
and the caller raises only after the journal is written.

A run with the same journal starts by taking its pairs out: all pairs of
answered batches (an anti-join), whatever the new run's batches look like.
Batches without an answer are sent again. A batch that two attempts of a task
answered counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.files import listing, remove

JOURNAL_SCHEMA = "key string, batch_id long, items_json string, run string, status string, reply string"
ITEMS_SCHEMA = "array<struct<position:long,merchant:string,description:string>>"

ANSWERED, FAILED, PERMANENT, LEFT_OUT = "answered", "failed", "permanent", "left out"


def _replies(journal: str) -> str:
    return f"{journal.rstrip('/')}/replies"


def append(entries: DataFrame, journal: str) -> None:
    """Write entries; each task's file counts as soon as the task is done."""
    (entries.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
     .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(_replies(journal)))


def entries(spark: SparkSession, journal: str) -> DataFrame:
    """All entries: per key its answered row if there is one, else one of the others."""
    if not any(name.endswith(".parquet") for name, folder, _ in listing(spark, _replies(journal)) if not folder):
        return spark.createDataFrame([], JOURNAL_SCHEMA)
    rows = spark.read.schema(JOURNAL_SCHEMA).parquet(_replies(journal))
    best = F.max_by(F.struct("batch_id", "items_json", "run", "status", "reply"), F.when(F.col("status") == ANSWERED, 2).when(F.col("status") == PERMANENT, 1).otherwise(0))
    return rows.groupBy("key").agg(best.alias("e")).select("key", "e.*")


def answered_batches(spark: SparkSession, journal: str) -> tuple[DataFrame, DataFrame]:
    """(replies (batch_id, reply), batched (batch_id, position, merchant,
    parsed_description)) of the answered batches; batch_id is the key."""
    done = entries(spark, journal).where(F.col("status") == ANSWERED).select(F.col("key").alias("batch_id"), "items_json", "reply")
    items = done.select("batch_id", F.explode(F.from_json("items_json", ITEMS_SCHEMA)).alias("i"))
    return done.select("batch_id", "reply"), items.select("batch_id", "i.position", "i.merchant", F.col("i.description").alias("parsed_description"))


def clear(spark: SparkSession, journal: str) -> None:
    """Forget the journal, once its answers are kept elsewhere."""
    remove(spark, _replies(journal))
