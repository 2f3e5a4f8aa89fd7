"""The category cache as a transactional log of parquet folders.

Layout under ``<root>``:

* ``log/<n>.claim``   version n is taken. The file is created only if it is
  not there, so of two writers that want n one gets n + 1, and both upserts
  stay.
* ``v=<n>/``          the pairs of upsert n; ``full=<n>/`` a full copy of
  versions up to n, with the version that each label comes from.
* ``log/<n>.commit``  the manifest of version n, created last and once: its
  files with sizes, rows and checksums. A folder without a manifest is not
  read; its number stays unused. ``log/<n>.full-claim`` and
  ``log/<n>.full-commit`` are the same for the full copy, which also lists the
  versions that it covers.

A load takes the newest full copy whose files are all there and every
committed version that it does not cover (one that was committed late too);
of a pair's labels the one of the highest version wins. A layer whose files
are missing or of another size is passed over with a warning, a full copy by
the layers that it covers. A store that cannot be listed is an error, not
damage. A full copy is written only if no layer had to be passed over and
every row read agrees with its manifest's checksums, so compaction never
forgets what is unreadable for a moment; ``vacuum`` deletes only what a full
copy that passes the same test covers.

Folders of earlier releases (``v=<n>`` and ``full=<n>`` with a ``_SUCCESS``
marker, no log) are read as versions without checksums.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.schema import CACHE_SCHEMA
from ledgerlens.sources.files import create_new, exists, listing, numbered_folders, read_text, remove

PAIR_KEYS = ["merchant", "parsed_description"]

# Upserts between two full copies: a load reads at most so many folders and one full copy.
COMPACT_EVERY = 16


class DamagedCacheError(RuntimeError):
    """A layer does not hold what its manifest says."""


@dataclass(frozen=True)
class Layer:
    """One committed folder: ``files`` maps names to (size, rows, checksum);
    None if the folder has no manifest."""
    version: int
    kind: str
    files: dict[str, tuple[int, int, str]] | None
    covers: frozenset[int]

    @property
    def folder(self) -> str:
        return f"{'full' if self.kind == 'full' else 'v'}={self.version}"


@dataclass(frozen=True)
class CacheState:
    """The layers that a load reads, and what it had to pass over."""
    layers: list[Layer]
    passed_over: list[Layer]


def empty_cache(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CACHE_SCHEMA)


def _committed(spark: SparkSession, root: str) -> list[Layer]:
    out = []
    names = [name for name, folder, _ in listing(spark, f"{root}/log") if not folder]
    for name in sorted(names):
        number, _, kind = name.partition(".")
        if kind in ("commit", "full-commit"):
            said = json.loads(read_text(spark, f"{root}/log/{name}"))
            out.append(Layer(int(number), "full" if kind == "full-commit" else "upsert", {f: tuple(x) for f, x in said["files"].items()}, frozenset(said["covers"])))
    for kind, label, claim in (("upsert", "v", "claim"), ("full", "full", "full-claim")):
        for n in numbered_folders(spark, root, label):
            if f"{n:09d}.{claim}" not in names:
                out.append(Layer(n, kind, None, frozenset(range(1, n + 1)) if kind == "full" else frozenset()))
    return sorted(out, key=lambda x: (x.version, x.kind))


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed upserts under ``root``, oldest first."""
    return [x.version for x in _committed(spark, root.rstrip("/")) if x.kind == "upsert"]


def _intact(spark: SparkSession, root: str, layer: Layer) -> bool:
    """Whether all files are there with their sizes; a folder without a
    manifest is tried by counting it, which reads every file's footer."""
    if layer.files is None:
        try:
            spark.read.schema(CACHE_SCHEMA).parquet(f"{root}/{layer.folder}").count()
            return True
        except Exception:  # noqa: BLE001 - whatever a reader raises on a damaged file
            return False
    there = {name: size for name, _, size in listing(spark, f"{root}/{layer.folder}")}
    return all(there.get(name) == size for name, (size, _, _) in layer.files.items())


def cache_state(spark: SparkSession, root: str) -> CacheState:
    """What a load of the cache reads, and what it passes over."""
    root = root.rstrip("/")
    known = _committed(spark, root)
    passed_over, layers, covered = [], [], frozenset()
    for full in sorted((x for x in known if x.kind == "full"), key=lambda x: -x.version):
        if _intact(spark, root, full):
            layers, covered = [full], full.covers
            break
        passed_over.append(full)
    for layer in known:
        if layer.kind == "upsert" and layer.version not in covered:
            (layers if _intact(spark, root, layer) else passed_over).append(layer)
    for layer in passed_over:
        warnings.warn(f"category cache folder {root}/{layer.folder} cannot be read and is passed over", stacklevel=3)
    return CacheState(layers, passed_over)


def _rows(spark: SparkSession, root: str, layer: Layer) -> DataFrame:
    """(merchant, parsed_description, category, version, file)"""
    own = layer.kind == "full" and layer.files is not None
    schema = T.StructType([*CACHE_SCHEMA.fields, *[T.StructField("version", T.LongType())] * own])
    files = [f"{root}/{layer.folder}/{name}" for name in layer.files] if layer.files is not None else [f"{root}/{layer.folder}"]
    if not files:
        return empty_cache(spark).withColumns({"version": F.lit(0).cast("long"), "file": F.lit("")})
    rows = spark.read.schema(schema).parquet(*files)
    version = F.col("version") if own else F.lit(layer.version).cast("long")
    return rows.select(*PAIR_KEYS, "category", version.alias("version"), F.col("_metadata.file_name").alias("file"))


def _newest(layers: list[DataFrame]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, layers)
    return rows.groupBy(*PAIR_KEYS).agg(F.max_by("category", "version").alias("category"), F.max("version").alias("version"))


def load_cache(spark: SparkSession, root: str) -> DataFrame:
    """All pairs, the newest label of each; empty if there is no cache.
    ``cache_state`` tells what was passed over."""
    root = root.rstrip("/")
    layers = [_rows(spark, root, x) for x in cache_state(spark, root).layers]
    if not layers:
        return empty_cache(spark)
    if len(layers) == 1:
        return layers[0].select(*PAIR_KEYS, "category")
    return _newest(layers).select(*PAIR_KEYS, "category")


def _sums(rows: DataFrame) -> dict[str, tuple[int, str]]:
    """Rows and checksum of each file: the sum of its rows' hashes, whatever their order."""
    row_hash = F.xxhash64(*PAIR_KEYS, "category").cast("decimal(38,0)")
    sums = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(row_hash).cast("string").alias("sum")).collect()  # a row per file
    return {r["file"]: (r["n"], r["sum"]) for r in sums}


def verify(spark: SparkSession, root: str, layer: Layer) -> None:
    """Read a layer and hold it against its manifest."""
    root = root.rstrip("/")
    if layer.files is None:
        return
    found = _sums(_rows(spark, root, layer))
    if {name: x for name, x in found.items()} != {name: (n, s) for name, (_, n, s) in layer.files.items() if n}:
        raise DamagedCacheError(f"{root}/{layer.folder} does not hold what its manifest says")


def _claim(spark: SparkSession, root: str) -> int:
    taken = [int(n.partition(".")[0]) for n, _, _ in listing(spark, f"{root}/log") if n.endswith(".claim")]
    taken += numbered_folders(spark, root, "v", complete=False)
    n = max(taken, default=0) + 1
    while not create_new(spark, f"{root}/log/{n:09d}.claim", ""):
        n += 1
    return n


def _commit(spark: SparkSession, root: str, layer: Layer) -> None:
    sizes = {name: size for name, folder, size in listing(spark, f"{root}/{layer.folder}") if name.endswith(".parquet") and not folder}
    sums = _sums(_rows(spark, root, Layer(layer.version, layer.kind, {name: (0, 0, "") for name in sizes}, layer.covers)))
    files = {name: (size, *sums.get(name, (0, "0"))) for name, size in sizes.items()}
    said = {"files": files, "covers": sorted(layer.covers)}
    kind = "full-commit" if layer.kind == "full" else "commit"
    if not create_new(spark, f"{root}/log/{layer.version:09d}.{kind}", json.dumps(said)):
        raise RuntimeError(f"version {layer.version} of {root} is committed already")


def upsert_cache(spark: SparkSession, root: str, new_pairs: DataFrame, compact_every: int = COMPACT_EVERY) -> int:
    """Commit the new pairs as a version of their own; the newest label wins
    on load. Returns its number (the newest one, with no write, when there are
    no new pairs). Any number of writers may do this at once. After
    ``compact_every`` versions that no full copy covers, one is written."""
    root = root.rstrip("/")
    done = versions(spark, root)
    if done and new_pairs.isEmpty():
        return done[-1]
    version = _claim(spark, root)
    fresh = new_pairs.select(*PAIR_KEYS, "category").dropDuplicates(PAIR_KEYS)
    fresh.write.mode("errorifexists").parquet(f"{root}/v={version}")
    _commit(spark, root, Layer(version, "upsert", None, frozenset()))
    state = cache_state(spark, root)
    if sum(x.kind == "upsert" for x in [*state.layers, *state.passed_over]) >= compact_every:
        compact_cache(spark, root, state)
    return version


def compact_cache(spark: SparkSession, root: str, state: CacheState | None = None) -> int | None:
    """Write a full copy of what a load reads and return the version it
    reaches; None, with nothing written, if a layer is passed over or holds
    something else than its manifest says (with a warning), or if another
    writer has taken this copy on."""
    root = root.rstrip("/")
    state = state or cache_state(spark, root)
    if state.passed_over or not state.layers:
        if state.passed_over:
            warnings.warn(f"category cache {root} is not compacted: {len(state.passed_over)} folders cannot be read", stacklevel=2)
        return None
    try:
        for layer in state.layers:
            verify(spark, root, layer)
    except Exception as broken:  # noqa: BLE001 - whatever a reader raises on a damaged file
        warnings.warn(f"category cache {root} is not compacted: {str(broken)[:200]}", stacklevel=2)
        return None
    covers = frozenset().union(*[x.covers | ({x.version} if x.kind == "upsert" else set()) for x in state.layers])
    version = max(covers)
    if not create_new(spark, f"{root}/log/{version:09d}.full-claim", ""):
        return None  # another writer makes it, or died on it: the next version's copy will cover the same
    _newest([_rows(spark, root, x).drop("file") for x in state.layers]).write.mode("errorifexists").parquet(f"{root}/full={version}")
    _commit(spark, root, Layer(version, "full", None, covers))
    return version


def vacuum_cache(spark: SparkSession, root: str, keep_full: int = 1) -> list[str]:
    """Delete the folders that the newest ``keep_full`` full copies make
    superfluous; the newest one is read and held against its manifest first.
    Returns the names of the folders deleted. Readers that planned a load
    before may fail and must load again, so run it when they are done."""
    root = root.rstrip("/")
    known = _committed(spark, root)
    fulls = sorted((x for x in known if x.kind == "full" and x.files is not None), key=lambda x: -x.version)[:keep_full]
    if not fulls or not all(_intact(spark, root, x) for x in fulls):
        return []
    for full in fulls:
        verify(spark, root, full)
    covered = frozenset.intersection(*[x.covers for x in fulls])
    gone = [x for x in known if (x.version in covered if x.kind == "upsert" else x.version < fulls[-1].version)]
    for layer in gone:
        if exists(spark, f"{root}/{layer.folder}"):
            remove(spark, f"{root}/{layer.folder}")
    return [x.folder for x in gone]
