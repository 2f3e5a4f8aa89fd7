"""Spelling variants: words of one inserted, deleted or replaced letter apart,
by dense prefix-suffix tiling.

Words are lower-cased (A-Z) runs of Latin letters, one letter deleted from
some (see ``read_words``), of at least ``MIN_LETTERS`` code points and
``MIN_COUNT`` occurrences. Two different words a, b, the longer of n code
points, are one edit apart exactly if their common prefix and common suffix
(each at most the shorter word) are together n - 1 or more.

Tiles. Then one of the two is at least k = ceil((n - 1) / 2), so both words
lie in the tile (n, first k code points) or in (n, last k code points). A word
of length m goes to the tiles of n = m and n = m + 1. In a tile the rest of
the words again has one edit, so a tile of more than ``TILE_ROWS`` words is
cut in the same way: its words share c more code points in front or behind,
c = ceil((r - 1) / 2) for r code points left. Cutting ends at r = 1, where a
tile holds at most one word per letter and one without, so no tile stays
large. A pair that lies in both tiles is counted in the front one: tiles of
the other kind carry the length of the front one and leave out pairs whose
common prefix reaches it.

A task cuts its tiles on to ``BLOCK_ROWS`` words, lays the words of many tiles
out as matrices of code points, padded behind for prefixes and in front for
suffixes, and compares blocks of row pairs. What leaves a task is one row per
word (near words, best near word), never a pair.

A word's form is its near word of largest n (ties: least in code-point order)
if that n is at least ``RATIO`` times its own; forms have ever larger n, so
following them ends, and roots come by pointer doubling. Null text has no
words; documents without an id hash as if the id were empty; repeated rows
count again; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut, ship_by_value, text_buffer, written

MIN_LETTERS = 7
MIN_COUNT = 2
RATIO = 10
DROP_EVERY = 31
#: Words of a tile that one task may get.
TILE_ROWS = 4096
#: Words of a tile whose pairs are compared as they are.
BLOCK_ROWS = 48
#: Bytes of row pairs that are compared at once.
BLOCK_BYTES = 8 << 20
#: Bytes of words, padded to the longest, that are laid out at once.
HELD_BYTES = 16 << 20
#: Different words that a task holds before it passes their counts on.
HELD_WORDS = 500_000

#: Latin-1 bytes: letters (A-Z lower-cased), all else white space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))

TILE = ["size", "front", "back", "below", "key"]


def letters_of(text: bytes) -> list[bytes]:
    """The lower-cased runs ``[A-Za-z\\u00C0-\\u00FF]+`` of UTF-8 text, a byte per code point."""
    return text.decode("utf-8", "replace").encode("latin-1", "replace").translate(LETTERS).split()


def _count(texts: Iterator[tuple[bytes, bytes]], drop_every: int, min_letters: int, into: Counter) -> None:
    crc = zlib.crc32
    for name, text in texts:
        start = crc(name + b":")
        for run, k in Counter([w for w in letters_of(text) if len(w) >= min_letters]).items():
            h = crc(run if run.isascii() else run.decode("latin-1").encode(), start)
            if h % drop_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < min_letters:
                    continue
            into[run] += k


def read_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int = DROP_EVERY,
               min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words as Latin-1 bytes, a byte per code point. Of a run whose
    CRC-32 of ``<doc_id>:<run>`` is a multiple of ``drop_every``, the code
    point at CRC-32 % length is left out."""
    ship_by_value()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            words = pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays(list(words), ["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            raw, at = text_buffer(batch.column(1))
            for i, name in enumerate(batch.column(0).to_pylist()):
                _count(iter([(b"" if name is None else b"%d" % name, raw[at[i]:at[i + 1]].tobytes())]), drop_every, min_letters, held)
                if len(held) > HELD_WORDS:
                    yield counted()
        yield counted()

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _halves(rows: DataFrame) -> DataFrame:
    """``rows`` (word, n, size, front, back, below) in the two tiles that each
    tile is cut into. Words of a tile share ``front`` code points in front and
    ``back`` behind; pairs count whose common prefix is shorter than ``below``."""
    more = F.ceil((F.col("size") - F.col("front") - F.col("back") - 1) / 2).cast("int")
    kinds = F.array(F.struct((F.col("front") + more).alias("front"), F.col("back").alias("back"), F.col("below").alias("below")),
                    F.struct(F.col("front").alias("front"), (F.col("back") + more).alias("back"), F.least("below", F.col("front") + more).alias("below")))
    dealt = rows.withColumn("kind", F.explode(kinds)).select("word", "n", "size", "kind.*")
    key = F.xxhash64(F.substring("word", F.lit(1), F.col("front")), F.expr("substring(word, length(word) - back + 1, back)"))
    return dealt.withColumn("key", key)


def tiles(words: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(word, n, size, front, back, below, key): each word in its tiles, none of
    which holds more than ``tile_rows`` words or else can be cut no more."""
    length = F.length("word")
    both = F.array(length, length + 1)
    rows = _halves(words.select("word", "n", F.explode(both).alias("size"), F.lit(0).alias("front"), F.lit(0).alias("back"), F.lit(1 << 30).alias("below")))
    done = None
    while True:
        rows = written(rows, "tiles")
        large = written(rows.groupBy(*TILE).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > tile_rows)
                        .where("size - front - back > 1").drop("rows"), "large-tiles")
        last = large.isEmpty()
        small = rows if last else rows.join(large, TILE, "left_anti")
        done = small if done is None else done.unionByName(small)
        if last:
            return done
        rows = _halves(rows.join(large, TILE, "left_semi").drop("key"))


def _cut(group: list[tuple[bytes, int]], size: int, front: int, back: int, below: int) -> Iterator[tuple]:
    """The tiles of at most ``BLOCK_ROWS`` words that a tile is cut into."""
    todo = [(group, front, back, below)]
    while todo:
        group, front, back, below = todo.pop()
        left = size - front - back
        if len(group) <= BLOCK_ROWS or left <= 1:
            yield group, front, back, below
            continue
        more = -(-(left - 1) // 2)
        ahead, behind = defaultdict(list), defaultdict(list)
        for row in group:
            ahead[row[0][front:front + more]].append(row)
            behind[row[0][len(row[0]) - back - more:len(row[0]) - back]].append(row)
        todo += [(g, front + more, back, below) for g in ahead.values() if len(g) > 1]
        todo += [(g, front, back + more, min(below, front + more)) for g in behind.values() if len(g) > 1]


def _matrices(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, code points padded behind, code points padded in front and reversed)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    width = int(size.max())
    ahead = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width)
    behind = np.frombuffer(b"".join([w[::-1].ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width)
    return size, ahead, behind


def _reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading columns in which the rows of two blocks agree."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def near_pairs(words: list[bytes], cuts: np.ndarray, size: np.ndarray, front: np.ndarray, back: np.ndarray, below: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs one edit apart, in blocks. Tile t holds the rows from
    ``cuts[t]`` to ``cuts[t + 1]``; words of its full ``size[t]`` come first."""
    length, ahead, behind = _matrices(words)
    tile = np.repeat(np.arange(len(size)), np.diff(cuts))
    partners = np.where(length == size[tile], cuts[1:][tile] - np.arange(len(words)) - 1, 0)
    before = np.r_[0, np.cumsum(partners)]
    step = max(1, BLOCK_BYTES // ahead.shape[1])
    lo = 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + step, "right")) - 1)
        i = np.repeat(np.arange(lo, hi), partners[lo:hi])
        j = np.arange(len(i)) - np.repeat(before[lo:hi] - before[lo], partners[lo:hi]) + i + 1
        short, t = np.minimum(length[i], length[j]), tile[i]
        prefix = np.minimum(_reach(ahead[i], ahead[j]), short)
        some = np.flatnonzero((prefix >= front[t]) & (prefix < below[t]))
        i, j, short, t, prefix = i[some], j[some], short[some], t[some], prefix[some]
        suffix = np.minimum(_reach(behind[i], behind[j]), short)
        some = (suffix >= back[t]) & (prefix + suffix >= size[t] - 1)
        yield i[some], j[some]
        lo = hi


def near_words(dealt: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n): parts, to be added up by word."""
    ship_by_value()

    def blocks(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """rows: (word, n, size, front, back, below, key) by tile."""
        words, counts, cuts, meta = [], [], [0], []
        start, width = 0, 0
        for end in range(1, len(rows) + 1):
            if end < len(rows) and rows[end][2:] == rows[start][2:]:
                continue
            size, front, back, below, _ = rows[start][2:]
            if end - start > 1:
                for group, f, b, u in _cut([r[:2] for r in rows[start:end]], size, front, back, below):
                    width = max(width, size)
                    if words and (len(words) + len(group)) * width > HELD_BYTES:
                        yield from solve(words, counts, cuts, meta)
                        words, counts, cuts, meta, width = [], [], [0], [], size
                    group = sorted(group, key=lambda r: -len(r[0]))
                    words += [r[0] for r in group]
                    counts += [r[1] for r in group]
                    cuts.append(len(words))
                    meta.append((size, f, b, u))
            start = end
        if words:
            yield from solve(words, counts, cuts, meta)

    def solve(words: list[bytes], counts: list[int], cuts: list[int], meta: list[tuple]) -> Iterator[pa.RecordBatch]:
        n = np.array(counts, np.int64)
        size, front, back, below = np.array(meta, np.int64).T
        order = {w: k for k, w in enumerate(sorted(set(words)))}
        place = np.fromiter(map(order.__getitem__, words), np.int64, len(words))
        names, by_place = list(order), np.zeros(len(order), np.int64)
        by_place[place] = n
        near, a, b = np.zeros(len(order), np.int64), [], []
        for i, j in near_pairs(words, np.array(cuts), size, front, back, below):
            a += [place[i], place[j]]
            b += [place[j], place[i]]
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        if not len(a):
            return
        near += np.bincount(a, minlength=len(near))
        by = np.lexsort((b, -by_place[b], a))  # largest n first, then least word
        a, b = a[by], b[by]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        a, b = a[first], b[first]
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in a.tolist()], pa.binary()), pa.array(near[a]), pa.array([names[k] for k in b.tolist()], pa.binary()), pa.array(by_place[b])],
                                         ["word", "n_near", "best", "best_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*[c.to_pylist() for c in batch.columns])
            if len(held) < 50_000:
                continue
            last = len(held) - 1
            while last and held[last - 1][2:] == held[-1][2:]:
                last -= 1
            yield from blocks(held[:last])
            held = held[last:]
        yield from blocks(held)

    placed = dealt.select("word", "n", *TILE).repartition(*TILE).sortWithinPartitions(*TILE)
    return placed.mapInArrow(run, "word binary, n_near long, best binary, best_n long")


def roots(forms: DataFrame, max_rounds: int = 8) -> DataFrame:
    """(word, root) of ``forms`` (word, form), by pointer doubling: a form has
    ``RATIO`` times the occurrences, so 2**63 allows chains of 19 at most."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = cut(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = then.select("word", "root")
        if then.where("moved").isEmpty():
            return now
    raise RuntimeError("a chain of forms is longer than counts allow")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS,
                   min_count: int = MIN_COUNT, ratio: int = RATIO, drop_every: int = DROP_EVERY, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word."""
    words = written(read_words(docs, id_col, text_col, drop_every, min_letters, min_count), "words")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    near = near_words(tiles(words, tile_rows)).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    named = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        *[F.when(-F.col("best.n") >= ratio * F.col("n"), c).alias(name) for name, c in (("form", F.col("best.word")), ("form_n", -F.col("best.n")))]), "near-words")
    chain = roots(named.where("form is not null").select("word", "form"))
    text = lambda c: F.decode(c, "ISO-8859-1")
    return (named.join(chain, "word", "left")
            .select(text(F.col("word")).alias("word"), text(F.col("form")).alias("form"), text(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n"))
