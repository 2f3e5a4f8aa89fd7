"""CSV records from text lines, one file by many tasks.

A quoted cell may hold line breaks, so a line alone does not tell whether it
begins a record; whole-file reading makes one task of a file. Here files are
read as lines, split wherever Spark splits them:

1. One scan gives a row per split: whether its number of quote characters is
   odd (a doubled quote counts two and changes nothing), and the header line of
   the split that a file begins with.
2. A running sum of these parities over the splits of a file, in order, tells
   which splits begin inside quotes. The table has a row per split.
3. The second scan, with that table joined in, folds lines to records inside
   each split: a line ends a record if the quotes up to its end are even.
4. A record that goes over the end of a split leaves a piece in each; pieces
   are put together by file and place. Only splits that begin inside quotes and
   those before them are looked at again, and nothing is if there are none.

As in CSV with quoted cells, a quote character in a cell that is not quoted
is not provided for (exports double and quote it).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.session import checkpoint_root

SPLIT = ["file_path", "block"]
WHOLE, HEAD, TAIL = "whole", "head", "tail"
#: A line of these alone is blank; the first is the mark that a UTF-8 file may begin with.
BLANK = "\ufeff \t\r\n"


def ship_by_value() -> None:
    """Executors need not have this package: its functions travel in the closure."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])


def text_lines(spark: SparkSession, path: str | Sequence[str], glob: str) -> DataFrame:
    """(value, file_path, block): the lines in the order of each split."""
    paths = [path] if isinstance(path, str) else list(path)
    lines = spark.read.option("pathGlobFilter", glob).option("lineSep", "\n").text(paths)
    return lines.select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"))


def _cuts(batch: pa.RecordBatch) -> list[int]:
    """Where the split changes inside a batch: a task may read several."""
    file, block = batch.column(1), batch.column(2).to_numpy()
    if not batch.num_rows:
        return [0]
    changed = (block[1:] != block[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]


def split_table(lines: DataFrame) -> DataFrame:
    """(file_path, block, odd, header): a row per split; header is the first
    line that is not blank, of splits that begin a file."""
    ship_by_value()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, odd, header = None, 0, None
        names = [*SPLIT, "odd", "header"]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([odd % 2 == 1]), pa.array([header], pa.string())], names)

        for batch in batches:
            cuts = _cuts(batch)
            for lo, hi in zip(cuts, cuts[1:]):
                now = batch.column(1)[lo].as_py(), batch.column(2)[lo].as_py()
                if now != key:
                    if key is not None:
                        yield row()
                    key, odd, header = now, 0, None
                part = batch.column(0).slice(lo, hi - lo)
                odd += pc.sum(pc.count_substring(part, '"')).as_py() or 0
                if key[1] == 0 and header is None:
                    header = next((x for x in part.to_pylist() if x.strip(BLANK)), None)
        if key is not None:
            yield row()

    return lines.mapInArrow(run, "file_path string, block long, odd boolean, header string")


def begins_inside(splits: DataFrame) -> DataFrame:
    """``splits`` with ``open`` (the split begins inside quotes) and ``cut``
    (it ends there). A row per split, in windows of a file's splits."""
    order = Window.partitionBy("file_path").orderBy("block")
    odd = F.col("odd").cast("long")
    before = F.coalesce(F.sum(odd).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    return splits.withColumn("open", before).withColumn("cut", F.col("open") != F.col("odd"))


def fold(lines: DataFrame, kinds: Sequence[str], multiline: bool = True) -> DataFrame:
    """``lines`` (value, file_path, block, open) as (record, file_path, block,
    kind) of the asked kinds: whole records, the HEAD of one that goes on in
    the next split, and the TAIL of one that began before. A file's first
    record that is not blank is its header, and left out. Without
    ``multiline`` each line is a record."""
    ship_by_value()
    wanted = set(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, inside, tail, header = None, [], False, False, False  # held: lines of the record that is not over

        def rows(records: pa.Array, kind: str) -> Iterator[pa.RecordBatch]:
            n = len(records)
            if n and kind in wanted:
                same = [pa.repeat(pa.scalar(x, t), n) for x, t in ((key[0], pa.string()), (key[1], pa.int64()), (kind, pa.string()))]
                yield pa.RecordBatch.from_arrays([records, *same], ["record", *SPLIT, "kind"])

        def rest() -> Iterator[pa.RecordBatch]:
            if held:
                yield from rows(pa.array(["\n".join(held)], pa.string()), TAIL if tail else HEAD)

        for batch in batches:
            cuts = _cuts(batch)
            for lo, hi in zip(cuts, cuts[1:]):
                now = batch.column(1)[lo].as_py(), batch.column(2)[lo].as_py()
                if now != key:
                    yield from rest()
                    key, held, inside = now, [], batch.column(3)[lo].as_py()
                    tail, header = inside, now[1] == 0
                part = batch.column(0).slice(lo, hi - lo)
                quotes = pc.count_substring(part, '"').to_numpy(zero_copy_only=False) if multiline else np.zeros(hi - lo, np.int64)
                after = (np.cumsum(quotes) + inside) % 2 == 1
                ends = np.flatnonzero(~after) + 1
                first = int(ends[-1]) if len(ends) else 0
                if first:
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), part.slice(0, first).cast(pa.string()))
                    records = pc.binary_join(lists, "\n")
                    if held:
                        records = pa.concat_arrays([pa.array(["\n".join([*held, records[0].as_py()])], pa.string()), records.slice(1)])
                        held = []
                    while header and len(records):
                        header = not records[0].as_py().strip(BLANK)
                        records = records.slice(1)
                    if tail and len(records):
                        yield from rows(records.slice(0, 1), TAIL)
                        records, tail = records.slice(1), False
                    yield from rows(records, WHOLE)
                held += part.slice(first).to_pylist()
                inside = bool(after[-1])
        if key is not None:
            yield from rest()

    return lines.select("value", *SPLIT, "open").mapInArrow(run, "record string, file_path string, block long, kind string")


def _joined(pieces: DataFrame) -> DataFrame:
    """Records from their pieces: a head, splits that lie inside the record as a whole, a tail."""
    order = Window.partitionBy("file_path").orderBy("block", F.col("kind") == HEAD)
    numbered = pieces.withColumn("number", F.sum((F.col("kind") == HEAD).cast("long")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("block", "record")))
    return (numbered.groupBy("file_path", "number").agg(F.min("block").alias("block"), parts.alias("parts"))
            .select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"), *SPLIT))


def read_records(spark: SparkSession, path: str | Sequence[str], glob: str, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records (record, file_path), files (file_path, header)). Header lines
    are not among the records; neither are blank ones. Without ``multiline``
    every line is a record. Repeated header lines inside a file are data."""
    return records_of(text_lines(spark, path, glob), multiline)


def records_of(lines: DataFrame, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """``read_records`` of lines (value, file_path, block) of whole files."""
    checkpoint_root(lines.sparkSession)
    splits = begins_inside(split_table(lines)).checkpoint(eager=True)
    files = splits.where("block = 0 and header is not null").select("file_path", "header")
    # of the splits that begin or end inside quotes: what the scan itself keeps of each split is larger
    special = splits.where("open or cut").select(*SPLIT, "open")
    if not multiline or special.isEmpty():
        found = fold(lines.withColumn("open", F.lit(False)), [WHOLE], multiline).select("record", *SPLIT)
    else:
        marked = lines.join(F.broadcast(special), SPLIT, "left").withColumn("open", F.coalesce("open", F.lit(False)))
        pieces = fold(lines.join(F.broadcast(special), SPLIT), [HEAD, TAIL])
        found = fold(marked, [WHOLE]).select("record", *SPLIT).unionByName(_joined(pieces))
    record = F.regexp_replace("record", r"\r$", "")
    return found.select(record.alias("record"), "file_path").where(F.trim("record") != ""), files
