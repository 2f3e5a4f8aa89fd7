"""Bulk-synchronous best-fit packing of tokenized documents.

Tokens: the named tokenizer's ids without added special tokens, then one end
id. White space never joins tokens in the supported tokenizers, so a text is
cut at ASCII white space and each distinct chunk is tokenized once per task
(``ChunkIds``); tests hold the result against the library on whole texts.

Packing. Longer documents are cut into full pieces and a rest; full pieces
fill a sequence each. Rests and gaps are integers below the capacity, so the
range-sorted documents and gaps are held as runs of equal size (at most
``capacity`` of them, whatever the corpus): a grouped count, which a hot
length does not make larger. A sweep goes down the sizes: the run of
documents of one length looks up the run of gaps that is its successor (the
least gap that is long enough), the two are matched by rank (document r of
the run goes to gap r div k, place r mod k, k documents fitting one gap),
what is left over goes on to the next larger gap or opens new sequences, and
the gaps that took documents come back with their new size. One round places
one run at one successor; the rounds end when no document is left, which
gives what best-fit decreasing gives on single documents. The rounds touch
runs only. Full pieces are a sequence each where they stand: no rank, no
shuffle. Ranks of the others are counted in buckets of each length, whose
number grows with the most frequent length's count (``BUCKET_PIECES`` a
bucket), so a length that a third of all documents share is not one task,
and each piece looks its place up by binary search in the table of matches.

Null text is empty: a piece of the end id alone. Repeated rows are separate
documents; null ids are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import row_slices, ship_by_value, text_buffer, tidied, worker_cache, written

CAPACITY = 4096
END_ID = 1
#: Chunks that a task remembers; then it starts anew.
REMEMBERED = 400_000
#: Pieces of one length that are ranked together, on average.
BUCKET_PIECES = 100_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkIds:
    """Ids (little-endian unsigned 32 bit) of chunks without white space.

    Words of letters alone are encoded many to a string: such a word is one
    word to the tokenizer too, whose last id is one that ends words, so the
    ids are cut there again. (Where the number of ends differs, a letter was
    normalized into something else, and each word is encoded by itself.) Marks
    behind a letter or digit of ASCII are words of their own, so they are
    looked up apart."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.known = Tokenizer.from_file(path), {}
        ids = self.library.get_vocab()
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        self.ends[[i for token, i in ids.items() if token.endswith("</w>")]] = True

    def single(self, chunks: list[bytes]) -> None:
        for lo in range(0, len(chunks), 10_000):
            part = chunks[lo:lo + 10_000]
            for chunk, got in zip(part, self.library.encode_batch_fast([x.decode("utf-8", "replace") for x in part], add_special_tokens=False)):
                self.known[chunk] = np.array(got.ids, "<u4").tobytes()

    def joined(self, words: list[bytes]) -> None:
        for lo in range(0, len(words), 20_000):
            parts = [words[k:k + 200] for k in range(lo, min(lo + 20_000, len(words)), 200)]
            for part, got in zip(parts, self.library.encode_batch_fast([b" ".join(p).decode() for p in parts], add_special_tokens=False)):
                ids = np.array(got.ids, "<u4")
                cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                if len(cuts) != len(part):
                    self.single(part)
                    continue
                raw = ids.tobytes()
                self.known.update(zip(part, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))

    def encode(self, chunks: set[bytes]) -> None:
        marked, words, rest = {}, [], []
        for chunk in chunks:
            word = chunk.rstrip(b".,;:!?")
            if len(word) < len(chunk) and word[-1:].isalnum() and b"<|" not in chunk:
                marked[chunk] = word
        chunks = chunks.difference(marked).union(marked.values(), [c[len(w):] for c, w in marked.items()]).difference(self.known)
        for chunk in chunks:
            (words if chunk.isalpha() or not chunk.isascii() and chunk.decode("utf-8", "replace").isalpha() else rest).append(chunk)
        self.joined(words)
        self.single(rest)
        known = self.known
        for chunk, word in marked.items():
            known[chunk] = known[word] + known[chunk[len(word):]]

    def texts(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        # an upper-case special string must not become one by lower-casing, and
        # beside other characters a capital may compose otherwise than its lower case
        split = [x.split() if b"<|" in x else (x.lower().split() if x.isascii() else [c.lower() if c.isascii() else c for c in x.split()]) for x in texts]
        new = set().union(*split).difference(self.known)
        self.encode(new)
        get = self.known.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32): row tells repeated ids apart."""
    ship_by_value()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        chunks = cache.setdefault(("chunk ids", tokenizer), None) or ChunkIds(tokenizer)
        cache[("chunk ids", tokenizer)] = chunks
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            raw, at = text_buffer(batch.column(1))
            for lo, hi in row_slices(at):
                rows, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(chunks.texts([raw[at[i]:at[i + 1]].tobytes() for i in range(lo, hi)]), lo):
                    ids = memoryview(ids + end)
                    for p, a in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[a:a + 4 * capacity]
                        rows.append(i)
                        piece.append(p)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                own = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(2).take(own), *[pa.array(x, pa.int64()) for x in (piece, start, length, crc)]], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])
        chunks.known.clear()  # a worker that goes on with other work keeps the tokenizer only

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
            .mapInArrow(tidied(run), "doc_id long, row long, piece long, start long, length long, ids_crc32 long"))


def match_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Matches (length, first rank, first sequence, documents per sequence,
    offset) of runs of equal documents with runs of equal gaps."""
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: runs of sequences (first, number)
    sizes: list[int] = []  # ascending
    sequences = 0

    def give_back(size: int, first: int, number: int) -> None:
        if size and number:
            if size not in gaps:
                gaps[size] = []
                bisect.insort(sizes, size)
            gaps[size].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(sizes, length)
            if k == len(sizes):  # no gap is long enough: open new sequences
                size, first = capacity, sequences
                number = -(-left // (capacity // length))
                sequences += number
            else:
                size = sizes[k]
                first, number = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size], sizes[k]
            each = size // length
            full, rest = min(number, left // each), 0
            taken = full * each
            if full < number and left > taken:
                rest = left - taken
            out.append((length, rank, first, each, capacity - size))
            give_back(size - each * length, first, full)
            if rest:
                give_back(size - rest * length, first + full, 1)
            give_back(size, first + full + (rest > 0), number - full - (rest > 0))
            rank, left = rank + taken + rest, left - taken - rest
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """``parts`` with sequence_id (below zero for full pieces) and offset."""
    ship_by_value()
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = parts.where(F.col("length") == capacity).select(*out[:5], (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = parts.where(F.col("length") < capacity)
    # at most capacity rows, whatever the number of documents
    total = {r.length: r.n for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = -(-max(total.values(), default=1) // bucket_pieces)
    keyed = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(buckets)))
    counts = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    table = np.array(match_runs(total, capacity), np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 48) + table[:, 1]
    by = np.argsort(keys, kind="stable")
    keys, table = keys[by], table[by]
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))  # at most capacity * buckets rows
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "row", "piece")
    ranked = (keyed.withColumn("r", F.row_number().over(inside) - 1)
              .join(offsets, ["length", "bucket"]).withColumn("rank", F.col("r") + F.col("ahead"))
              .select("doc_id", "row", "piece", "start", "length", "ids_crc32", "rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (4, 6))
            own = table[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            r = rank - own[:, 1]
            yield pa.RecordBatch.from_arrays([b.column(0), *[b.column(k) for k in (2, 3, 4, 5)], pa.array(own[:, 2] + r // own[:, 3]), pa.array(own[:, 4] + r % own[:, 3] * length)],
                                             out)

    placed = ranked.mapInArrow(tidied(place), "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces."""
    parts = written(pieces(docs, tokenizer or default_tokenizer(), id_col, text_col, capacity, end_id), "pieces")
    return pack(parts, capacity, bucket_pieces)
