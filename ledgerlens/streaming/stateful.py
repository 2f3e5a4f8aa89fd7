"""Streams with state of their own (R1–R4): one stream for a folder of mixed
exports, a live category cache, months that close, and a ledger of late rows.

State is kept by ``transformWithState`` in RocksDB (on executor disk, with
change logs in the checkpoint). What a micro-batch writes goes to a folder named
by its batch id and is overwritten if the batch is run again, so a restart
neither loses nor doubles rows.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerlens.operators.prepare import month_key, prepare
from ledgerlens.schema import UNCATEGORIZED
from ledgerlens.sources.exports import CSV_GLOB, by_header, header_table
from ledgerlens.sources.files import create_new, listing, read_text, remove
from ledgerlens.sources.records import records_of, ship_by_value

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(df: DataFrame, write_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str, available_now: bool) -> StreamingQuery:
    spark = df.sparkSession
    kept = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # a query keeps the provider that it started with
    try:
        writer = df.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).outputMode(mode)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
    finally:
        spark.conf.set(PROVIDER, kept) if kept is not None else spark.conf.unset(PROVIDER)


# ---------------------------------------------------------------------------
# One stream for all header layouts
# ---------------------------------------------------------------------------

def start_folder(spark: SparkSession, folder: str, sink: str, checkpoint: str, account_pattern: str | None = None,
                 max_files_per_trigger: int | None = None, multiline: bool = True, available_now: bool = True) -> StreamingQuery:
    """Ingest a drop folder whose files may have any known header. A
    micro-batch's files are folded to records and named by their own headers as
    in ``read_exports``; prepared rows go to ``<sink>/rows``. Files with an
    unknown header, or without columns that their dialect needs, go to
    ``<sink>/quarantine`` (path and header) and do not stop the stream."""
    reader = spark.readStream.format("text").option("lineSep", "\n").option("pathGlobFilter", CSV_GLOB)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    lines = reader.load(folder).select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        records, files = records_of(batch, multiline)
        headers = header_table(files)
        bad = headers.where("not known").join(files, "file_path").select("file_path", "header")
        bad.write.mode("overwrite").parquet(f"{sink}/quarantine/batch_id={batch_id}")
        if not headers.where("known").isEmpty():
            prepare(by_header(records, headers, account_pattern, "skip", folder)).write.mode("overwrite").parquet(f"{sink}/rows/batch_id={batch_id}")

    return _start(lines, write_batch, checkpoint, "append", available_now)


# ---------------------------------------------------------------------------
# R2: a live category cache
# ---------------------------------------------------------------------------

class _LiveLabels(StatefulProcessor):
    """Of one pair (and salt): its newest label, and the rows that came before it had one."""

    def __init__(self, pending_ttl_ms: int | None) -> None:
        self.pending_ttl_ms = pending_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.label = handle.getValueState("label", "category string, version long")
        self.pending = handle.getListState("pending", "txn_id long", self.pending_ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.label.get() if self.label.exists() else None
        frames = list(rows)
        labels = [r for pdf in frames for r in pdf.loc[pdf["txn_id"].isna(), ["category", "version"]].itertuples(index=False)]
        if labels:
            newest = max(labels, key=lambda r: r.version)
            if known is None or newest.version >= known[1]:
                known = (newest.category, int(newest.version))
                self.label.update(known)
        waited = []
        if known is not None and self.pending.exists():
            waited = [r[0] for r in self.pending.get()]
            self.pending.clear()
        came = [int(t) for pdf in frames for t in pdf["txn_id"].dropna()]
        if known is None and came:
            self.pending.appendList([(t,) for t in came])
        ids = waited + came
        if ids:
            yield pd.DataFrame({"txn_id": ids, "merchant": key[0], "parsed_description": key[1],
                                "category": known[0] if known is not None else UNCATEGORIZED, "correction": [True] * len(waited) + [False] * len(came)})

    def close(self) -> None:
        pass


def live_categories(rows: DataFrame, changes: DataFrame, salts: int = 8, pending_ttl_ms: int | None = None) -> DataFrame:
    """R2: (txn_id, merchant, parsed_description, category, correction) of a
    stream of rows under a stream of cache changes (merchant,
    parsed_description, category, version: the highest one counts). A pair
    without a label gives ``Uncategorized`` and its rows wait; when the label
    comes, each is sent again with it (``correction``). Rows that have a label
    keep it when it changes later, as rows that are categorised already do.

    The cache lies in the state store by pair and is not shuffled again; a
    micro-batch moves its own rows and changes only. A pair's rows are dealt over
    ``salts`` groups by their id, and its labels go to each, so one pair that
    holds a third of all rows is not one task. ``pending_ttl_ms`` bounds how
    long rows wait; without it they wait for good."""
    ship_by_value()
    mine = rows.select("merchant", "parsed_description", F.pmod(F.xxhash64("txn_id"), F.lit(salts)).cast("int").alias("salt"), "txn_id",
                       F.lit(None).cast("string").alias("category"), F.lit(None).cast("long").alias("version"))
    theirs = changes.select("merchant", "parsed_description", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
                            F.lit(None).cast("long").alias("txn_id"), "category", F.col("version").cast("long").alias("version"))
    return (mine.unionByName(theirs).groupBy("merchant", "parsed_description", "salt")
            .transformWithStateInPandas(_LiveLabels(pending_ttl_ms), "txn_id long, merchant string, parsed_description string, category string, correction boolean",
                                        "Update", "ProcessingTime" if pending_ttl_ms else "None"))


def start_live_categories(rows: DataFrame, changes: DataFrame, sink: str, checkpoint: str, available_now: bool = True,
                          salts: int = 8, pending_ttl_ms: int | None = None) -> StreamingQuery:
    """``live_categories`` into a log by batch; ``latest_categories`` reads it."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return _start(live_categories(rows, changes, salts, pending_ttl_ms), write_batch, checkpoint, "update", available_now)


def latest_categories(spark: SparkSession, sink: str) -> DataFrame:
    """Per row its latest category; ``corrected`` if it had to wait for it."""
    log = spark.read.parquet(sink)
    return log.groupBy("txn_id", "merchant", "parsed_description").agg(F.max_by("category", "batch_id").alias("category"), F.bool_or("correction").alias("corrected"))


# ---------------------------------------------------------------------------
# Running totals whose months close
# ---------------------------------------------------------------------------

OPEN, CLOSED, LATE = "open", "closed", "late"


def _month_end_ms(month: str) -> int:
    year, number = int(month[:4]), int(month[5:])
    after = dt.datetime(year + number // 12, number % 12 + 1, 1, tzinfo=dt.timezone.utc)
    return int(after.timestamp() * 1000)


class _MonthTotals(StatefulProcessor):
    """Of one key and month: sums by category until the watermark passes its end."""

    def __init__(self, keys: Sequence[str]) -> None:
        self.keys = list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "category string", "amount decimal(38,2), count long")

    def _rows(self, key, sums: dict, status: str) -> pd.DataFrame:
        names = list(sums)
        cells = {name: [key[k]] * len(names) for k, name in enumerate([*self.keys, "month"])}
        return pd.DataFrame({**cells, "category": names, "amount": [sums[c][0] for c in names], "count": [sums[c][1] for c in names], "status": status})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        come: dict = {}
        for pdf in rows:
            for category, amount in zip(pdf["category"], pdf["amount"]):
                total, n = come.get(category, (Decimal(0), 0))
                come[category] = (total + (amount if amount is not None else 0), n + 1)
        end = _month_end_ms(key[-1])
        if timerValues.getCurrentWatermarkInMs() >= end:  # the month is closed and its state gone
            yield self._rows(key, come, LATE)
            return
        self.handle.registerTimer(end)
        for category, (total, n) in come.items():
            name = (category,)
            before = self.sums.getValue(name) if self.sums.containsKey(name) else (Decimal(0), 0)
            come[category] = (before[0] + total, before[1] + n)
            self.sums.updateValue(name, come[category])
        yield self._rows(key, come, OPEN)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sums = {name[0]: tuple(value) for name, value in self.sums.iterator()}
        self.sums.clear()
        yield self._rows(key, sums, CLOSED)

    def close(self) -> None:
        pass


def closing_totals(df: DataFrame, ts: str = "ts", delay: str = "1 day", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, month, category, amount, count, status). Running totals of
    the categories that a micro-batch changed (``open``); when the watermark
    (newest event less ``delay``) passes a month's end, its final totals
    (``closed``) and nothing of it stays in the state; what comes for a closed
    month later is sent as an amount to add (``late``)."""
    ship_by_value()
    schema = df.schema
    rows = df.withWatermark(ts, delay).select(*keys, month_key(ts).alias("month"), "category", F.col("amount").cast("decimal(38,2)").alias("amount"))
    out = ", ".join([*[f"`{k}` {schema[k].dataType.simpleString()}" for k in keys], "month string, category string, amount decimal(38,2), count long, status string"])
    return rows.groupBy(*keys, "month").transformWithStateInPandas(_MonthTotals(keys), out, "Update", "EventTime")


def start_closing_totals(df: DataFrame, sink: str, checkpoint: str, ts: str = "ts", delay: str = "1 day",
                         keys: Sequence[str] = (), available_now: bool = True) -> StreamingQuery:
    """``closing_totals`` into a log by batch; ``month_totals`` reads it."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return _start(closing_totals(df, ts, delay, keys), write_batch, checkpoint, "update", available_now)


def month_totals(spark: SparkSession, sink: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, month, category, amount, count, late_count, closed): the newest
    running or final value, with what came late added."""
    log = spark.read.parquet(sink)
    late, at = F.col("status") == LATE, F.when(F.col("status") != LATE, F.col("batch_id") * 2 + (F.col("status") == CLOSED).cast("int"))
    on_time = [F.max_by(F.when(~late, F.col(c)), at) for c in ("amount", "count")]
    added = [F.coalesce(F.sum(F.when(late, F.col(c))), F.lit(0)) for c in ("amount", "count")]
    return log.groupBy(*keys, "month", "category").agg(
        (F.coalesce(on_time[0], F.lit(0)) + added[0]).alias("amount"), (F.coalesce(on_time[1], F.lit(0)) + added[1]).alias("count"),
        added[1].alias("late_count"), F.bool_or(F.col("status") != OPEN).alias("closed"))


# ---------------------------------------------------------------------------
# Daily totals with a ledger of late rows
# ---------------------------------------------------------------------------

def start_daily_ledger(df: DataFrame, sink: str, checkpoint: str, ts: str = "ts", delay_seconds: int = 86_400,
                       keys: Sequence[str] = (), available_now: bool = True) -> StreamingQuery:
    """R4 with nothing dropped: a micro-batch's rows are told apart by the
    watermark before it (newest event of the batches before, less the delay).
    Those whose day is over go to ``<sink>/late`` as they are, the others to
    ``<sink>/days`` as sums by day. Each batch notes its newest event under
    ``<sink>/newest``, so a batch that is run again sees the same watermark."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [int(name) for name, _, _ in listing(spark, f"{sink}/newest") if name.isdigit() and int(name) < batch_id]
        newest = max((json.loads(read_text(spark, f"{sink}/newest/{n:012d}")) for n in before), default=None)
        watermark = None if newest is None else newest - delay_seconds * 1_000_000
        day_end = F.unix_micros(F.date_trunc("day", ts) + F.expr("INTERVAL 1 DAY"))
        late = F.lit(False) if watermark is None else F.coalesce(day_end <= watermark, F.lit(False))
        rows = batch.withColumn("_late", late).persist()
        try:
            rows.where("_late").drop("_late").withColumn("watermark", F.timestamp_micros(F.lit(watermark).cast("long"))).write.mode("overwrite").parquet(f"{sink}/late/batch_id={batch_id}")
            (rows.where("not _late").groupBy(F.date_trunc("day", ts).alias("window_start"), *keys)
             .agg(F.sum("amount").cast("decimal(38,2)").alias("amount"), F.count(F.lit(1)).alias("count"))
             .write.mode("overwrite").parquet(f"{sink}/days/batch_id={batch_id}"))
            top = rows.agg(F.max(F.unix_micros(ts))).first()[0]
        finally:
            rows.unpersist()
        if top is not None:
            remove(spark, f"{sink}/newest/{batch_id:012d}")
            create_new(spark, f"{sink}/newest/{batch_id:012d}", json.dumps(top))

    return _start(df, write_batch, checkpoint, "append", available_now)


def daily_ledger(spark: SparkSession, sink: str, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """(window_start, keys, amount, count, late_amount, late_count): what came
    in time for each day, and what came after it was over. Their sum is the
    corrected day; the counts add up to all rows."""
    days = spark.read.parquet(f"{sink}/days").select("window_start", *keys, "amount", "count", F.lit(0).cast("decimal(38,2)").alias("late_amount"), F.lit(0).cast("long").alias("late_count"))
    late = spark.read.parquet(f"{sink}/late").select(F.date_trunc("day", ts).alias("window_start"), *keys, F.lit(0).cast("decimal(38,2)").alias("amount"), F.lit(0).cast("long").alias("count"),
                                                     F.coalesce(F.col("amount"), F.lit(0)).cast("decimal(38,2)").alias("late_amount"), F.lit(1).cast("long").alias("late_count"))
    sums = [F.sum(c).alias(c) for c in ("amount", "count", "late_amount", "late_count")]
    return days.unionByName(late).groupBy("window_start", *keys).agg(*sums)
