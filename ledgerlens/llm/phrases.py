"""Document fingerprints by locally consistent parsing.

A text's bytes are the symbols of level 0. On each level, runs of an equal
symbol are one element (symbol, length of the run); so neighbours differ, and
deterministic coin tossing shortens the symbols: an element's new label is
twice the lowest bit place in which it differs from its left neighbour, plus
its bit there. After a few rounds labels are 0 to 5 and neighbours still
differ, so local maxima are at most ten elements apart. Phrases begin at
local maxima; a phrase's name is a 64-bit hash of its elements, and the names
are the next level's symbols, until one name is left. Whether a phrase begins
at a place depends on a few elements around it only, so equal substrings are
cut and named alike but for their ends, at whatever offset they stand.

The fingerprint holds the last name (16 hex digits: the whole text) and a
sketch of the set of all names from level ``FROM_LEVEL`` up: ``SLOTS`` slots,
each with 16 bits of the least hash of the names that fall into it, "ffff"
if none does. The likeness of two fingerprints is 1 if the whole texts agree;
else the estimated share J of common names among all names of both, as the
Dice coefficient 2 J / (1 + J): the share of one text's names that the other
has too. It is 0 if neither has a name in a slot of the other.

Null text is empty: its fingerprint has no name, and it is like empty texts
only. A document's successor is the next in the order of (doc_id, hash of the
text), null ids first; repeated rows are each other's successors, a single
document is its own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import ship_by_value, text_buffer

SLOTS = 64
FROM_LEVEL = 2
#: Bytes of documents that are parsed together.
TOGETHER = 1 << 20
EMPTY = np.uint64((1 << 64) - 1)
#: Lowest set bit of each byte.
LOWEST = np.array([8] + [(b & -b).bit_length() - 1 for b in range(1, 256)], np.uint8)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing; the first element of a text tosses bit 0."""
    left = np.empty_like(label)
    left[1:] = label[:-1]
    left[first] = label[first] ^ label.dtype.type(1)
    differ = label ^ left
    if label.dtype == np.uint8:
        place = LOWEST[differ]
    else:
        place = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.uint8)
    return ((label >> place.astype(label.dtype)) & label.dtype.type(1)).astype(np.uint8) | (place << np.uint8(1))


def phrase_level(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Next level's names, and where texts begin in them. ``first``: where
    texts begin in ``names``."""
    new = np.empty(len(names), bool)
    new[0] = True
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new[first] = True
    run = np.flatnonzero(new)
    size = np.diff(np.r_[run, len(names)])
    symbol = names[run]
    first = np.searchsorted(run, first)
    label = symbol
    for _ in range(3 if symbol.dtype == np.uint8 else 4):
        label = _toss(label, first)
    start = np.empty(len(label), bool)
    start[0] = True
    start[1:] = label[1:] > label[:-1]
    start[:-1] &= label[:-1] >= label[1:]
    last = np.r_[first[1:], len(label)] - 1
    start[last] = False  # the end of a text begins no phrase of its own
    start[first] = True
    begin = np.flatnonzero(start)
    place = np.arange(len(label)) - np.repeat(begin, np.diff(np.r_[begin, len(label)]))
    part = _mix(symbol.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                + place.astype(np.uint64) * np.uint64(0x165667B19E3779F9) + np.uint64(1))
    return _mix(np.add.reduceat(part, begin)), np.searchsorted(begin, first)


def fingerprints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(last name, sketch of SLOTS uint16) of each text."""
    n = len(texts)
    root, least = np.zeros(n, np.uint64), np.full(n * SLOTS, EMPTY)
    rows = np.flatnonzero([len(t) > 0 for t in texts])
    names = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(texts[i]) for i in rows], np.int64)
    first = np.r_[0, np.cumsum(sizes)[:-1]] if len(rows) else np.empty(0, np.int64)
    level = 0
    while len(rows):
        names, first = phrase_level(names, first)
        level += 1
        count = np.diff(np.r_[first, len(names)])
        done = count == 1
        if level >= FROM_LEVEL or done.any():
            sketched = np.repeat(done | (level >= FROM_LEVEL), count)
            h = _mix(names[sketched] + np.uint64(0x2545F4914F6CDD1D))
            np.minimum.at(least, np.repeat(rows, count)[sketched] * SLOTS + (h % np.uint64(SLOTS)).astype(np.int64), h)
        root[rows[done]] = names[first[done]]
        names = names[np.repeat(~done, count)]
        rows, count = rows[~done], count[~done]
        first = np.r_[0, np.cumsum(count)[:-1]] if len(rows) else np.empty(0, np.int64)
    sketch = np.where(least == EMPTY, np.uint64(0xFFFF), (least >> np.uint64(32)) % np.uint64(0xFFFF)).astype(np.uint16)
    return root, sketch.reshape(n, SLOTS)


def written_out(root: np.ndarray, sketch: np.ndarray) -> list[str]:
    return [r.astype(">u8").tobytes().hex() + s.astype(">u2").tobytes().hex() for r, s in zip(root, sketch)]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    same = (a[1] == b[1]) & (a[1] != 0xFFFF)
    any_ = (a[1] != 0xFFFF) | (b[1] != 0xFFFF)
    j = same.sum(1) / np.maximum(any_.sum(1), 1)
    return np.where(a[0] == b[0], 1.0, 2 * j / (1 + j))


def with_successors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, extra, doc_id, th, text): documents range-partitioned by (doc_id,
    th); each part also holds, marked extra, the first document after it.

    The cuts are quantiles of a bounded sample of keys (those of least hash),
    the first documents one per part, so what is broadcast grows with the
    number of partitions only; texts move once."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = rows.select("doc_id", "th").orderBy(F.xxhash64("th", "doc_id"), "doc_id").limit(20 * parts).collect()
    sample = sorted(sample, key=lambda r: (r.doc_id is not None, r.doc_id, r.th))
    cuts = [sample[k * len(sample) // parts] for k in range(1, parts)] if sample else []
    value = lambda x: F.lit(x).cast("long")
    at = F.array(*[F.struct(value(r.doc_id).alias("doc_id"), value(r.th).alias("th")) for r in dict.fromkeys(cuts)])
    part = F.size(F.filter(at, lambda x: x <= F.struct("doc_id", "th"))) if cuts else F.lit(0)
    rows = rows.withColumn("part", part)
    heads = rows.groupBy("part").agg(F.min(F.struct("doc_id", "th")).alias("head")).orderBy("part").collect()  # one row per part
    if not heads:
        return rows.select("part", F.lit(False).alias("extra"), "doc_id", "th", "text")
    names = spark.createDataFrame([(heads[k - 1].part, h.head.doc_id, h.head.th) for k, h in enumerate(heads)], "p int, d long, t long")
    extra = rows.join(F.broadcast(names), rows.doc_id.eqNullSafe(names.d) & (rows.th == names.t)).select(
        F.col("p").alias("part"), F.lit(True).alias("extra"), "doc_id", "th", "text").dropDuplicates(["part"])
    own = rows.select("part", F.lit(False).alias("extra"), "doc_id", "th", "text")
    return own.unionByName(extra).repartition(parts, "part").sortWithinPartitions("part", "extra", "doc_id", "th")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next): the edited text has its last n_chars // 2
    characters replaced by the first as many of the next document."""
    ship_by_value()

    def solve(ids: list, parts: list[int], extra: list[bool], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """All rows but the last, whose successor the others are."""
        own = [i for i in range(len(ids) - 1) if not extra[i]]
        if not own:
            return
        chars = [t.decode("utf-8", "replace") for t in texts]
        half = {i: len(chars[i]) // 2 for i in own}
        edited = [(chars[i][:len(chars[i]) - half[i]] + chars[i + 1][:half[i]]).encode() for i in own]
        root, sketch = fingerprints(texts + edited)
        a, b, c = ((root[k], sketch[k]) for k in (np.array(own), np.array(own) + 1, np.arange(len(texts), len(root))))
        yield pa.RecordBatch.from_arrays([
            pa.array([ids[i] for i in own], pa.int64()), pa.array([len(chars[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in edited]), pa.array(written_out(*a)), pa.array(written_out(*c)),
            pa.array(likeness(a, c)), pa.array(likeness(a, b))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for b in batches:
            raw, at = text_buffer(b.column(3))
            for i, (doc, part, extra) in enumerate(zip(b.column(2).to_pylist(), b.column(0).to_pylist(), b.column(1).to_pylist())):
                for column, x in zip(held, (doc, part, extra, raw[at[i]:at[i + 1]].tobytes())):
                    column.append(x)
                size += int(at[i + 1] - at[i])
                if size > TOGETHER:
                    yield from solve(*held)
                    held = tuple(column[-1:] for column in held)
                    size = len(held[3][0])
        yield from solve(*held)

    return (with_successors(docs, id_col, text_col).select("part", "extra", "doc_id", "text")
            .mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"))
