"""Structured Streaming (R1–R5): continuous ingestion of exports from a drop
folder, stream–static categorisation, running totals, watermarked daily
totals and progress.

The batch operators are reused unchanged: a streaming DataFrame goes
through the same column expressions (normalise, prepare, rule category).
Sinks are files under the shared checkpoint folder plus a streaming
checkpoint there, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ledgerlens.operators.classify import with_rule_category
from ledgerlens.operators.prepare import month_key, prepare
from ledgerlens.operators.skew import BROADCAST_ROWS, small_enough
from ledgerlens.session import checkpoint_root
from ledgerlens.sources.cache import COMPACT_EVERY
from ledgerlens.sources.files import numbered_folders
from ledgerlens.sources.exports import CSV_GLOB, csv_options, normalize, row_id


def stream_exports(spark: SparkSession, folder: str, header: Sequence[str], dialect: str,
                   account_id: str = "", max_files_per_trigger: int | None = None,
                   multiline: bool = True) -> DataFrame:
    """A file stream of one exact header layout. A file stream needs a
    schema and maps it by position, so each header layout gets its own
    folder; ``enforceSchema=false`` makes a file with another header fail
    instead of being read misaligned. Cells are read as the batch reader
    reads them (quoted commas, doubled quotes, line breaks), and rows get the
    batch reader's ids. ``max_files_per_trigger`` bounds a
    micro-batch, so a backlog (also under ``availableNow``) is taken in
    several bounded batches instead of one."""
    schema = ", ".join(f"`{c}` string" for c in header)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    raw = (
        reader
        .options(**csv_options(multiline))
        .option("pathGlobFilter", CSV_GLOB)
        .csv(folder)
        .na.fill("")
        .withColumn("txn_id", row_id(F.col("_metadata.file_path"), header))
        .withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
        .withColumn("account_id", F.lit(account_id))
        .withColumn("dialect", F.lit("B" if dialect == "capital_one" else "A"))
    )
    return prepare(normalize(raw, dialect))


def categorize_stream(df: DataFrame, mapping: DataFrame | None = None,
                      broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """R2: stream–static category attach. With a cache ``mapping`` (one row
    per pair) it is a left join against the static dimension; otherwise the
    rule column. The mapping is counted once when the stream is defined: up
    to ``broadcast_rows`` pairs it is broadcast, so a micro-batch joins
    map-side; a larger one is a shuffle join, which shuffles the static side
    again in every micro-batch — keep such a cache's pairs to those a feed
    can meet, or categorise in batch."""
    if mapping is None:
        return with_rule_category(df)
    m = mapping.select(F.col("merchant").alias("_m"), F.col("parsed_description").alias("_d"),
                       F.col("category").alias("_cat"))
    if small_enough(m, broadcast_rows):
        m = F.broadcast(m)
    cond = df["merchant"].eqNullSafe(m["_m"]) & df["parsed_description"].eqNullSafe(m["_d"])
    return (df.join(m, cond, "left")
            .withColumn("category", F.coalesce(F.col("_cat"), F.lit("Uncategorized")))
            .drop("_m", "_d", "_cat"))


def running_totals(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Running category × month totals (emit with outputMode 'update')."""
    return df.groupBy(*keys, month_key("date").alias("month"), "category").agg(
        F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("count"))


def daily_totals_watermarked(df: DataFrame, ts: str = "ts", delay: str = "1 day",
                             keys: Sequence[str] = ()) -> DataFrame:
    """Append-only daily totals; rows later than ``delay`` behind the
    newest event are dropped, a day is emitted once the watermark passes."""
    return (
        df.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day").alias("w"), *keys)
        .agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("count"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                *keys, "amount", "count")
    )


def start_append(df: DataFrame, sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to a parquet folder (exactly-once via the file sink log)."""
    w = df.writeStream.format("parquet").option("path", sink) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _snapshots(sink: str) -> str:
    return f"{sink.rstrip('/')}-snapshots"


def start_upserts(df: DataFrame, sink: str, checkpoint: str, available_now: bool = True,
                  keys: Sequence[str] | None = None, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Update-mode results appended per micro-batch with their batch id; the
    current value of a key is its row from the highest batch
    (``latest_upserts``). Rewriting a batch after a failure writes the same
    rows with the same id, so the read side stays right. With ``keys``, every
    ``compact_every`` batches the current values are written as a snapshot
    next to the log, and later reads take it and the batches after it."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append") \
            .partitionBy("batch_id").parquet(sink)
        if keys is not None and (batch_id + 1) % compact_every == 0:
            _latest(batch.sparkSession, sink, keys, before=batch_id) \
                .write.mode("overwrite").parquet(f"{_snapshots(sink)}/through={batch_id}")

    w = df.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint) \
        .outputMode("update")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _latest(spark: SparkSession, sink: str, keys: Sequence[str], before: int | None = None) -> DataFrame:
    """Per key the row of its latest batch, batch id included: from the newest
    snapshot (older than batch ``before``, if given) and the batches after it."""
    log = spark.read.parquet(sink)
    taken = [n for n in numbered_folders(spark, _snapshots(sink), "through") if before is None or n < before]
    if taken:
        snapshot = spark.read.schema(log.schema).parquet(f"{_snapshots(sink)}/through={taken[-1]}")
        log = log.where(F.col("batch_id") > taken[-1]).unionByName(snapshot)
    vals = [c for c in log.columns if c not in set(keys) | {"batch_id"}]
    return log.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in vals], F.max("batch_id").alias("batch_id"))


def latest_upserts(spark: SparkSession, sink: str, keys: Sequence[str]) -> DataFrame:
    """Current state of an upsert log: per key, the row of the latest batch.

    A key has one row per batch (a retried batch rewrites the same values
    under the same id), so each value column can take its own ``max_by``
    over ``batch_id``: numeric value columns keep the buffers fixed-width,
    a hash aggregate instead of a sort of the log."""
    return _latest(spark, sink, keys).drop("batch_id")


class ProgressLog(StreamingQueryListener):
    """Every progress report of every query of the session, one JSON file
    per micro-batch in a shared folder. (A query's own ``recentProgress``
    keeps the newest reports only.) Register it before the query starts:
    ``spark.streams.addListener(log)``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        checkpoint_root(spark)
        self.spark, self.folder = spark, folder.rstrip("/")
        self.ended: dict[str, threading.Event] = {}

    def _end(self, run_id: object) -> threading.Event:
        return self.ended.setdefault(str(run_id), threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(event.runId)

    def onQueryProgress(self, event) -> None:
        jvm, report = self.spark._jvm, event.progress
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/run={report.runId}/batch={report.batchId}.json")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(" ".join(report.json.split("\n")).encode()))
        finally:
            out.close()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(event.runId).set()

    def reports(self, query: StreamingQuery, timeout: float = 60.0) -> DataFrame:
        """The query's reports as rows (batch id, input rows, processed rows
        per second, watermark). Reports arrive after their batch: of an ended
        query this waits for the last one, and fails if it does not come."""
        if not query.isActive and not self._end(query.runId).wait(timeout):
            raise TimeoutError(f"the end of streaming run {query.runId} was not reported")
        schema = ("batchId long, numInputRows long, processedRowsPerSecond double, eventTime struct<watermark:string>")
        rows = self.spark.read.schema(schema).json(f"{self.folder}/run={query.runId}")
        return rows.select(F.col("batchId").alias("batch_id"), F.coalesce("numInputRows", F.lit(0)).alias("input_rows"),
                           F.coalesce("processedRowsPerSecond", F.lit(0.0)).alias("rows_per_second"),
                           F.col("eventTime.watermark").alias("watermark"))
