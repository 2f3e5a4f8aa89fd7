"""Helpers shared by the operators: Arrow text buffers, worker-side caches,
lineage cuts in the shared folder, and connected components."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import checkpoint_root, scratch_path

#: Bytes of text that a task works on at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def ship_by_value() -> None:
    """Executors need not have this package: its functions travel in the closure."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker. Functions that
    travel by value get new globals in each task, so what is worth keeping
    (loaded tokenizers, state tables) is kept here."""
    name = "ledgerlens_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as a task that returns its freed memory to the system when it
    ends: a worker is kept for later tasks, and what allocators hold back
    would count beside the work of the stages that follow."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
            if trim:
                trim(0)

    return task


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string or binary column; null is empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, at


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a checkpoint in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet into the shared folder and read back: as a checkpoint,
    but columnar and compressed, for wide or often read tables."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (src, dst: long) as
    (node, root), root being the smallest node; nodes that are their own root
    are left out.

    Alternating large-star and small-star rounds: each node hangs its larger
    neighbours (then its smaller ones) on the smallest it knows, which ends in
    stars after a number of rounds logarithmic in the number of nodes. A hub
    costs one aggregate with map-side combine; the joins back on the node may
    be split by the adaptive skew join. Every round is checkpointed."""

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        own = pairs.join(low, "u")
        if larger:
            return own.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return own.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).where("u <> v")

    now = edges.where("src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now, seen = cut(now), None
    for _ in range(max_rounds):
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or state[0] == 0:
            break
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, larger=True).distinct()
        now = cut(star(large.where("u > v"), larger=False).distinct())
    else:
        raise RuntimeError("components did not converge; raise max_rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
