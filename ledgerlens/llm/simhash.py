"""SimHash near-duplicate groups over a Gray-order hierarchical index.

Fingerprints: lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+``, k-word
shingles with repeats, XXH64 (seed 42); a bit is set if set in over half the
shingle hashes. Documents link when their fingerprints differ in at most
``max_bits`` bits.

Search: equal fingerprints are folded first. Two fingerprints within d bits
agree on a of d + a bit blocks, so each distinct fingerprint goes to one
bucket (mask, value) per choice of a blocks; a is the least that leaves
``BUCKET_ROWS`` to a bucket if values are even (1 up to 2**28 fingerprints).
A bucket that holds more is cut at quantiles of its Gray rank into chunks,
the uppermost nodes: chunk pairs whose shared bits differ in more than d
places are dropped, each other pair is a bucket of its own, so a task's
bucket is bounded. In a bucket the fingerprints are sorted by
Gray rank; nodes of ``FAN`` neighbours keep the bits all members share (mask
and pattern), upper nodes the bits all children share. Node pairs whose
shared bits already differ in more than d places are dropped with all the
pairs below them, and so are node pairs that lie in one component already. A
bucket returns a spanning forest of its links, never the pairs.

Null or blank text: no shingles, fingerprint 0, linked like any other. Fewer
words than the shingle length: one shingle of all words. A null doc_id is
kept and gets its group's smallest non-null id (null if there is none). An
empty table gives an empty result; repeated rows are grouped like copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import components, cut, ship_by_value, text_buffer, tidied, written

SHINGLE = 4
MAX_BITS = 4
FAN = 16
#: Fingerprints of a bucket that a task sorts; larger buckets are cut into chunks of so many.
BUCKET_ROWS = 1 << 16
#: Node pairs that are looked at together.
FRONT = 1 << 15
#: Bits of each byte value, the lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(shingle, len(words))
    first, last = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    n, total, digest = len(first), np.zeros(64, np.int64), xxhash.xxh64_digest
    for lo in range(0, n, 1 << 16):
        hashes = b"".join([digest(line[a:b], 42) for a, b in zip(first[lo:lo + (1 << 16)], last[lo:lo + (1 << 16)])])
        lanes = np.frombuffer(hashes, np.uint8).reshape(-1, 8)  # most significant byte first
        total += np.concatenate([np.bincount(lanes[:, 7 - k], minlength=256) @ BITS for k in range(8)])
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * total > n].sum(dtype=np.uint64))


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, th): one row per row of ``docs``, fp as a signed long, th
    the XXH64 of the text."""
    ship_by_value()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = text_buffer(b.column(1))
            fp = np.fromiter((simhash(raw[at[i]:at[i + 1]].tobytes(), shingle) for i in range(b.num_rows)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2)], ["doc_id", "fp", "th"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _text_hash(text_col).alias("th"))
            .mapInArrow(tidied(run), "doc_id long, fp long, th long"))


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the reflected Gray order."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _levels(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, mask of shared bits) per node, from the leaves up."""
    ones, zeros, out = fp, ~fp, []
    while True:
        cuts = np.arange(0, len(ones), FAN)
        ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
        out.append((ones, ones | zeros))
        if len(ones) == 1:
            return out


def _children(pairs: np.ndarray, size: int) -> np.ndarray:
    """All child pairs (left <= right) of node pairs, within ``size`` children."""
    fan = np.arange(FAN)
    left = (pairs[:, :1, None] * FAN + fan[:, None]).repeat(FAN, 2).reshape(-1)
    right = (pairs[:, 1:, None] * FAN + fan[None, :]).repeat(FAN, 1).reshape(-1)
    ok = (left <= right) & (right < size)
    return np.stack([left[ok], right[ok]], 1)


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the labels of i and j: hook on the smaller one, then flatten."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            flat = label[label]
            if np.array_equal(flat, label):
                break
            label[:] = flat


def bucket_links(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links of one bucket's distinct fingerprints."""
    fp = fp[np.argsort(gray_rank(fp), kind="stable")]
    n = len(fp)
    if n <= FAN * 4:
        i, j = np.triu_indices(n, 1)
        near = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
        label = np.arange(n)
        _join(label, i[near], j[near])
    else:
        levels, label = _levels(fp), np.arange(n)
        cuts = np.arange(0, n, FAN)
        work, step = [(len(levels) - 1, np.zeros((1, 2), np.int64))], FRONT // FAN
        while work:
            level, pairs = work.pop()
            if level == 0 and len(pairs) > step:  # in pieces, so that each profits from the links of those before
                work += [(0, pairs[lo:lo + step]) for lo in range(0, len(pairs), step)][::-1]
                continue
            if level < 0:
                i, j = pairs[:, 0], pairs[:, 1]
                near = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= max_bits)
                _join(label, i[near], j[near])
                continue
            pattern, mask = levels[level]
            a, b = pairs[:, 0], pairs[:, 1]
            pairs = pairs[np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= max_bits]
            if level == 0 and len(pairs):
                low, high = np.minimum.reduceat(label, cuts), np.maximum.reduceat(label, cuts)
                a, b = pairs[:, 0], pairs[:, 1]
                pairs = pairs[(np.minimum(low[a], low[b]) != np.maximum(high[a], high[b]))]
            if not len(pairs):
                continue
            below = n if level == 0 else len(levels[level - 1][0])
            work += [(level - 1, _children(pairs[lo:lo + step], below)) for lo in range(0, len(pairs), step)][::-1]
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def block_masks(max_bits: int, agree: int) -> list[int]:
    """Masks (as signed longs) of all choices of ``agree`` out of
    ``max_bits + agree`` bit blocks: two fingerprints within ``max_bits``
    bits are equal under one of them."""
    parts = max_bits + agree
    edge = [round(64 * k / parts) for k in range(parts + 1)]
    masks = [sum(c) for c in combinations([(1 << b) - (1 << a) for a, b in zip(edge, edge[1:])], agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def agreeing_blocks(rows: int, max_bits: int, bucket_rows: int) -> int:
    """The least number of agreeing blocks that deals ``rows`` even
    fingerprints into buckets of at most ``bucket_rows``."""
    agree = 1
    while rows >> (64 * agree // (max_bits + agree)) > bucket_rows:
        agree += 1
    return agree


def _gray(fp: Column) -> Column:
    """``gray_rank`` as a column (signed)."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def buckets(distinct: DataFrame, max_bits: int, bucket_rows: int) -> DataFrame:
    """(mask, value, part, fp): the buckets' rows; a bucket of more than
    ``bucket_rows`` has one part per pair of chunks that may hold links."""
    masks = block_masks(max_bits, agreeing_blocks(distinct.count(), max_bits, bucket_rows))
    keys = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("value")) for m in masks])
    dealt = distinct.select("fp", F.explode(keys).alias("k")).select("k.mask", "k.value", "fp")
    large = written(dealt.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows), "large-buckets")
    small = dealt.join(large, ["mask", "value"], "left_anti").select("mask", "value", F.lit(0).cast("long").alias("part"), "fp")
    if large.isEmpty():
        return small
    # sorted by signed Gray rank: the halves trade places, neighbours stay neighbours
    ranked = dealt.join(large, ["mask", "value"]).withColumn("rank", _gray(F.col("fp")))
    most = large.agg(F.max("n")).first()[0]
    chunks = -(-most // bucket_rows)
    sketch = F.percentile_approx("rank", [k / chunks for k in range(1, chunks)], max(10_000, 100 * chunks))
    edges = ranked.groupBy("mask", "value").agg(sketch.alias("edges"))
    chunk = F.size(F.filter("edges", lambda e: e < F.col("rank"))).cast("long")
    placed = written(ranked.join(edges, ["mask", "value"]).select("mask", "value", chunk.alias("chunk"), "fp"), "chunks")
    nodes = placed.groupBy("mask", "value", "chunk").agg(
        F.bit_and("fp").alias("ones"), F.bitwise_not(F.bit_and("fp").bitwiseXOR(F.bit_or("fp"))).alias("shared"))
    left, right = (nodes.select("mask", "value", *[F.col(c).alias(c + side) for c in ("chunk", "ones", "shared")]) for side in "12")
    apart = F.bit_count(F.col("ones1").bitwiseXOR(F.col("ones2")).bitwiseAND(F.col("shared1")).bitwiseAND(F.col("shared2")))
    pairs = left.join(right, ["mask", "value"]).where((F.col("chunk1") <= F.col("chunk2")) & (apart <= max_bits))
    parts = pairs.select("mask", "value", F.shiftleft("chunk1", 32).bitwiseOR(F.col("chunk2")).alias("part"),
                         F.explode(F.array_distinct(F.array("chunk1", "chunk2"))).alias("chunk"))
    return small.unionByName(placed.join(parts, ["mask", "value", "chunk"]).select("mask", "value", "part", "fp"))


def links(distinct: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(src, dst) links that connect all distinct fingerprints ``fp`` within
    ``max_bits`` bits of each other (a spanning forest per bucket)."""
    ship_by_value()
    key = ["mask", "value", "part"]
    dealt = buckets(distinct, max_bits, bucket_rows).repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((4, 0), np.int64)  # mask, value, part and fp of the bucket that is not over

        def cuts(rows: np.ndarray) -> np.ndarray:
            return np.flatnonzero(np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(0)])

        def solve(rows: np.ndarray) -> pa.RecordBatch:
            at, src, dst = cuts(rows) if rows.shape[1] else np.empty(0, np.int64), [], []
            fp = rows[3].view(np.uint64)
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(fp)]):
                if b - a > 1:
                    s, d = bucket_links(fp[a:b], max_bits)
                    src.append(s)
                    dst.append(d)
            flat = lambda x: pa.array((np.concatenate(x) if x else np.empty(0, np.uint64)).view(np.int64))
            return pa.RecordBatch.from_arrays([flat(src), flat(dst)], ["src", "dst"])

        for b in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])], 1)
            if not rows.shape[1]:
                continue
            last = int(cuts(rows)[-1])
            held = rows[:, last:]
            yield solve(np.ascontiguousarray(rows[:, :last]))
        if held.shape[1]:
            yield solve(np.ascontiguousarray(held))

    return dealt.mapInArrow(tidied(run), "src long, dst long")


def _groups(marked: DataFrame, max_bits: int, bucket_rows: int) -> DataFrame:
    """``marked`` (doc_id, fp, ...) with root, the group's smallest fingerprint
    (signed), and component_id."""
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(distinct, max_bits, bucket_rows))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return marked.join(placed.join(lowest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that
    can be reached over links, the document itself included."""
    marked = cut(fingerprints(docs, id_col, text_col, shingle).drop("th"))
    return _groups(marked, max_bits, bucket_rows).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, one per near-duplicate group: the one with the
    group's smallest id, rows without an id last; of several texts with that
    id, the one of least fingerprint, then of least XXH64. Groups are told
    apart by their fingerprints, so groups that share an id, or have none,
    keep a row each; of rows that repeat the chosen one, one stays."""
    marked = cut(fingerprints(docs, id_col, text_col, shingle))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp", "th")
    best = (_groups(marked.groupBy("doc_id", "fp", "th").agg(F.count(F.lit(1)).alias("n")), max_bits, BUCKET_ROWS)
            .groupBy("root").agg(F.min(F.struct(*[order.getField(c).alias(c) for c in ("nameless", "doc_id", "fp", "th")], "n")).alias("k")))
    best = cut(best.select(F.col("k.doc_id").alias("__doc"), F.col("k.th").alias("__th"), F.col("k.n").alias("__n")))
    same = docs[id_col].cast("long").eqNullSafe(F.col("__doc")) & (_text_hash(text_col) == F.col("__th"))
    single = docs.join(best.where("__n = 1"), same, "left_semi")
    repeated = docs.join(best.where("__n > 1"), same, "left_semi").withColumn("__th", _text_hash(text_col))
    return single.unionByName(repeated.dropDuplicates([id_col, "__th"]).drop("__th"))
