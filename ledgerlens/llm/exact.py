"""Exact deduplication with a persistent digest index.

Texts are equal if they are identical after lower-casing A-Z only; a text is
named by the SHA-256 of its lower-cased UTF-8 bytes.

The index is a bucketed table under ``root``: one row (digest, doc_id, n,
batch) per different text, bucketed by digest and sorted by it inside each
bucket, one file per bucket and batch. New data is deduplicated against it so:

1. Digests of the new rows (texts stay in their tasks), written once.
2. A grouped count folds equal texts: the row with the largest doc_id stands
   for its group. Groups of copies of any size end here, in partial counts.
3. A sort-merge anti-join with the index, dealt as the index is (the index is
   not shuffled), leaves the texts it does not hold; they are appended.
4. The batch is made valid by creating the next numbered file of the commit
   log, which names it. Rows of a batch that no commit names are not read, so
   a job that died half-way leaves nothing behind and can simply run again; a
   second writer that took the number first makes the commit fail.
5. Every row gets its decision from its text's row of the index. Digests that
   more than one in ``HOT_SHARE`` rows have (``HOT_SHARE`` at most, whatever
   the size) are looked up in a broadcast, the rest by a sort-merge join, so a
   text that a third of all rows hold is not one task.

A text that an earlier batch holds is dropped, whatever its doc_id: what has
been given out stays. Null text is empty. Rows without an id come after all
ids; a group without any id keeps one row and has a null keep_id. Of rows that
repeat the largest id, one stays. Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import ship_by_value, text_buffer, written
from ledgerlens.sources.cache import numbered_folders

HOT_SHARE = 10_000
INDEX = "digest binary, doc_id long, n long, batch string"


class DigestConflict(RuntimeError):
    """Another writer committed to the index meanwhile; run the batch again."""


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, row): one row per row of ``docs``."""
    ship_by_value()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffer(batch.column(1))
            ends = at.tolist()
            found = [hashlib.sha256(raw[a:b].tobytes().lower()).digest() for a, b in zip(ends, ends[1:])]  # bytes.lower knows A-Z only
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["doc_id", "digest", "row"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
            .mapInArrow(run, "doc_id long, digest binary, row long"))


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def commits(spark: SparkSession, root: str) -> int:
    """Number of batches in the commit log."""
    log = _path(spark, f"{root}/commits")
    fs = log.getFileSystem(spark._jsc.hadoopConfiguration())
    return len(fs.listStatus(log)) if fs.exists(log) else 0


def _commit(spark: SparkSession, root: str, number: int, batch: str) -> None:
    path = _path(spark, f"{root}/commits/{number:09d}")
    try:
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, False)
    except Exception as taken:
        raise DigestConflict(f"commit {number} of the digest index {root} is taken") from taken
    try:
        out.write(bytearray(batch.encode()))
    finally:
        out.close()


def open_index(spark: SparkSession, root: str, buckets: int | None = None) -> tuple[str, int]:
    """(table, buckets) of the index under ``root``, which is made if it is
    not there; an index keeps the number of buckets that it was made with
    (default: the session's shuffle partitions)."""
    root = root.rstrip("/")
    made = numbered_folders(spark, root, "buckets", complete=False)
    number = made[0] if made else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = "digests_" + hashlib.sha256(root.encode()).hexdigest()[:16]
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({INDEX}) USING parquet OPTIONS (path '{root}/buckets={number}') "
              f"CLUSTERED BY (digest) SORTED BY (digest) INTO {number} BUCKETS")
    spark.catalog.refreshTable(table)
    return table, number


def read_index(spark: SparkSession, root: str, buckets: int | None = None) -> DataFrame:
    """(digest, doc_id, n, batch) of all committed batches."""
    root = root.rstrip("/")
    table, _ = open_index(spark, root, buckets)
    if not commits(spark, root):
        return spark.table(table).where("false")
    names = spark.read.text(f"{root}/commits").select(F.col("value").alias("batch"))
    return spark.table(table).join(F.broadcast(names), "batch", "left_semi").select("digest", "doc_id", "n", "batch")  # a row per batch


def deduplicate(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Add the texts of ``docs`` to the index under ``root``. Returns
    (doc_id, keep_id, group_size, kept, known, digest), one row per row of
    ``docs``: keep_id is the doc_id of the row that stays, group_size the rows
    of its text (those of the batch that brought it, and of this one), kept
    whether this row stays, known whether an earlier batch holds its text."""
    spark, root = docs.sparkSession, root.rstrip("/")
    table, number = open_index(spark, root, buckets)
    done = commits(spark, root)
    rows = written(digests(docs, id_col, text_col), "digests")
    # written: the rows that stand for their groups must not change between the uses below
    groups = written(rows.groupBy("digest").agg(F.max("doc_id").alias("keep"), F.coalesce(F.max_by("row", "doc_id"), F.min("row")).alias("keep_row"),
                                                F.count(F.lit(1)).alias("n")).repartition(number, "digest"), "groups")
    held = read_index(spark, root)
    batch = uuid.uuid4().hex
    new = (groups.repartition(number, "digest").hint("merge").join(held, "digest", "left_anti")
           .select("digest", F.col("keep").alias("doc_id"), "n", F.lit(batch).alias("batch")))
    new.write.insertInto(table)
    _commit(spark, root, done, batch)
    own = read_index(spark, root).select("digest", F.col("doc_id").alias("keep_id"), F.col("n").alias("before"), (F.col("batch") != batch).alias("known"))
    named = written(groups.repartition(number, "digest").hint("merge").join(own, "digest").select(
        "digest", "keep_id", "known", F.when(F.col("known"), -1).otherwise(F.col("keep_row")).alias("keep_row"),
        F.when(F.col("known"), F.col("n") + F.col("before")).otherwise(F.col("n")).alias("group_size"), "n"), "named")
    total = rows.count()
    hot = F.col("n") * HOT_SHARE > F.lit(total)  # fewer than HOT_SHARE digests
    many, few = named.where(hot), named.where(~hot)
    split = rows.join(F.broadcast(many.select("digest", F.lit(True).alias("hot"), "keep_id", "known", "keep_row", "group_size")), "digest", "left")
    common = split.where("hot").drop("hot")
    rare = split.where("hot is null").select("digest", "doc_id", "row").hint("merge").join(few.drop("n"), "digest")
    out = ["doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "known", "digest"]
    return common.select(*out).unionByName(rare.select(*out))
