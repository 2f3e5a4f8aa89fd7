"""The stream gives the batch answer."""

from pyspark.sql import functions as F

from ledgerlens.operators import aggregates as agg
from ledgerlens.operators import classify as cls
from ledgerlens.session import scratch_path
from ledgerlens.sources import exports
from ledgerlens.sources.cache import numbered_folders
from ledgerlens.operators import prepare as prep
from ledgerlens.streaming import ingest

HEADER = ["Date", "Time", "Amount", "Merchant", "Description", "Status", "Type"]


def test_stream_exports_running_totals_equal_batch(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    (folder / "a.csv").write_text(",".join(HEADER) + "\n"
                                  "2024-01-05,,10.00,Uber,UBER *EATS,Posted,Purchase\n"
                                  "2024-01-06,,5.00,Shell,Shell Oil,Posted,Purchase\n"
                                  "2024-02-01,,7.00,Shell,Shell Oil,Pending,Purchase\n")
    (folder / "b.csv").write_text(",".join(HEADER) + "\n2024-02-03,,2.50,Uber,Uber Trip,Posted,Purchase\n")
    # One file per micro-batch: two batches, the upsert log keeps each key's newest totals.
    stream = ingest.categorize_stream(ingest.stream_exports(spark, str(folder), HEADER, "robinhood",
                                                            max_files_per_trigger=1))
    base = scratch_path(spark, "t-stream")
    log = ingest.ProgressLog(spark, f"{base}/progress")
    spark.streams.addListener(log)
    q = ingest.start_upserts(ingest.running_totals(stream), f"{base}/out", f"{base}/chk")
    q.awaitTermination()
    got = {(r.month, r.category): (float(r.amount), r["count"])
           for r in ingest.latest_upserts(spark, f"{base}/out", ["month", "category"]).collect()}
    assert got == {("2024-01", "Dining & Drinks"): (10.0, 1), ("2024-01", "Transport"): (5.0, 1),
                   ("2024-02", "Transport"): (2.5, 1)}
    prog = log.reports(q)
    spark.streams.removeListener(log)
    assert sum(r.input_rows for r in prog.collect()) == 4
    assert sum(1 for r in prog.collect() if r.input_rows > 0) == 2

    batch = cls.categorize(prep.prepare(exports.read_exports(spark, str(folder))))
    assert batch.count() == 3
    assert agg.metrics(batch).first().total == 17.5
    want = {(r.month, r.category): (float(r.amount), r["count"])
            for r in ingest.running_totals(batch).collect()}
    assert want == got


def test_latest_upserts_takes_newest_batch_per_key(spark):
    """A retried batch appears twice with the same id and values; every key
    gets its newest batch's values, read back by a hash aggregate."""
    from decimal import Decimal
    rows = [("2024-01", "Travel", Decimal("1.00"), 1, 0), ("2024-01", "Travel", Decimal("3.00"), 3, 2),
            ("2024-01", "Travel", Decimal("3.00"), 3, 2), ("2024-02", "Travel", Decimal("2.00"), 2, 1)]
    log = spark.createDataFrame(rows, "month string, category string, amount decimal(28,2), count long, batch_id int")
    base = scratch_path(spark, "t-upserts")
    log.write.partitionBy("batch_id").parquet(f"{base}/out")
    latest = ingest.latest_upserts(spark, f"{base}/out", ["month", "category"])
    got = {r.month: (float(r.amount), r["count"]) for r in latest.collect()}
    assert got == {"2024-01": (3.0, 3), "2024-02": (2.0, 2)}
    assert "SortAggregate" not in latest._jdf.queryExecution().executedPlan().toString()


def test_upsert_log_is_compacted(spark, tmp_path):
    src, sink = tmp_path / "in", str(tmp_path / "log")
    rows = [(k % 4, k, k % 9) for k in range(30)]
    for k in range(10):
        spark.createDataFrame(rows[3 * k:3 * k + 3], "k int, n int, amount int").coalesce(1).write.mode("append").parquet(str(src))
    df = spark.readStream.schema("k int, n int, amount int").option("maxFilesPerTrigger", 1).parquet(str(src))
    sums = df.groupBy("k").agg(F.sum("amount").alias("amount"), F.count("n").alias("count"))
    ingest.start_upserts(sums, sink, str(tmp_path / "chk"), keys=["k"], compact_every=4).awaitTermination()
    taken = numbered_folders(spark, f"{sink}-snapshots", "through")
    assert taken[:2] == [3, 7]
    want = {k: (sum(a for x, _, a in rows if x == k), sum(x == k for x, _, _ in rows)) for k in range(4)}
    got = ingest.latest_upserts(spark, sink, ["k"])
    assert sorted(got.columns) == ["amount", "count", "k"]
    assert {r.k: (r.amount, r["count"]) for r in got.collect()} == want
    whole = spark.read.parquet(sink).groupBy("k").agg(F.max_by("amount", "batch_id").alias("amount"))
    assert {r.k: r.amount for r in whole.collect()} == {k: v[0] for k, v in want.items()}


def test_stream_static_attach_broadcasts_a_small_cache(spark, tmp_path):
    folder = tmp_path / "drop2"
    folder.mkdir()
    (folder / "a.csv").write_text(",".join(HEADER) + "\n"
                                  "2024-01-05,,10.00,Uber,UBER *EATS,Posted,Purchase\n"
                                  "2024-01-06,,5.00,Shell,Shell Oil,Posted,Purchase\n")
    mapping = spark.createDataFrame([("Uber", "EATS", "Travel")],
                                    "merchant string, parsed_description string, category string")
    stream = ingest.categorize_stream(ingest.stream_exports(spark, str(folder), HEADER, "robinhood"), mapping)
    base = scratch_path(spark, "t-stream-static")
    seen = []

    def capture(batch, batch_id):
        seen.append(batch._jdf.queryExecution().executedPlan().toString())
        batch.write.mode("append").parquet(f"{base}/out")

    q = stream.writeStream.foreachBatch(capture).option("checkpointLocation", f"{base}/chk") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.merchant, r.category) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {("Uber", "Travel"), ("Shell", "Uncategorized")}
    assert seen and all("SortMergeJoin" not in p for p in seen)


def test_stream_reads_quoted_cells_as_the_batch_does(spark, tmp_path):
    """Commas, doubled quotes and line breaks inside cells, both dialects:
    the same rows, and the same ids."""
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    b.mkdir()
    (a / "a.csv").write_text(",".join(HEADER) + "\n"
                             '2024-01-05,,10.00,"Uber, Inc","say ""hi"", twice",Posted,Purchase\n'
                             '2024-01-06,,5.00,Shell,"first line\nsecond, ""line""",Posted,Purchase\n'
                             '2024-01-06,,5.00,Shell,"first line\nsecond, ""line""",Posted,Purchase\n'
                             '2024-02-01,,7.00,"""Q""",plain,Posted,Purchase\n')
    b_header = ["Transaction Date", "Posted Date", "Card No.", "Description", "Category", "Debit"]
    (b / "b.csv").write_text(",".join(b_header) + "\n"
                             '2024-03-05,2024-03-06,0000,"SHELL, ""THE"" OIL",Gas,12.50\n'
                             '2024-03-05,2024-03-06,0000,"line\nbreak",Gas,1.50\n')
    for folder, header, dialect in ((a, HEADER, exports.DIALECT_A), (b, b_header, exports.DIALECT_B)):
        base = scratch_path(spark, "t-quoted")
        q = ingest.start_append(ingest.stream_exports(spark, str(folder), header, dialect), f"{base}/out", f"{base}/chk")
        q.awaitTermination()
        got = spark.read.parquet(f"{base}/out")
        want = prep.prepare(exports.read_exports(spark, str(folder)))
        cols = ["txn_id", "date", "amount", "merchant", "description", "month", "parsed_description"]
        assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())
        assert got.count() == (4 if folder == a else 2)


def test_event_streams_read_a_folder_of_part_files(spark, tmp_path):
    from ledgerlens.plans.registry import QUERIES

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(300).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert QUERIES["stream_progress"](spark, str(tmp_path)).first().input_rows == 300


def test_progress_log_keeps_every_batch(spark, tmp_path):
    """More micro-batches than a query's own list of recent reports holds."""
    folder = tmp_path / "events"
    spark.range(9).selectExpr("id AS event_id", "timestamp '2024-01-01' + make_interval(0, 0, 0, id) AS ts", "1.0 AS amount") \
        .repartition(9).write.parquet(str(folder))
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    base = scratch_path(spark, "t-progress")
    log = ingest.ProgressLog(spark, f"{base}/progress")
    spark.streams.addListener(log)
    try:
        stream = (spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder)))
        q = ingest.start_append(stream, f"{base}/out", f"{base}/chk")
        q.awaitTermination()
        reports = log.reports(q)
        assert sum(r.input_rows for r in reports.collect()) == 9 and len(q.recentProgress) <= 3
    finally:
        spark.streams.removeListener(log)
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
