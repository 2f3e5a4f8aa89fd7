"""Ranked lexical search in norm buckets (after LEMP).

A document is a sparse vector of impacts, one per term of the queries: the
saturated, length-scaled term frequency ``(10**9 * tf) div (1000 * tf + 20 * m)``
in integers. A query is the vector of its terms' weights, a score the inner
product. Terms are maximal runs of letters and digits of ASCII and of all
other code points, only A-Z lower-cased, over whole texts.

1. One pass over the texts keeps, per document, its number of terms and the
   frequencies of those terms that a query of the block has. Corpus counts
   (documents, all terms, documents per term) are sums over all rows of it.
2. Impact vectors are range-sorted by length (Euclidean norm), the longest
   first, so each task holds vectors of like length; it cuts them into buckets
   of ``BUCKET`` documents with inverted lists.
3. About ``FIRST`` of the longest documents are searched first. Each query's k-th best
   score there is a lower bound of its k-th best score overall, so it starts
   every task's threshold, which then rises with the task's own results.
4. For a query and a bucket: Cauchy-Schwarz drops the bucket if the query's
   length times the greatest length in it is below the threshold, and inside
   it the documents behind the last that is long enough. The query's greatest
   coordinates are then added up in rounds of ``FOCUS``. After each round the
   rest of the score is bounded by coordinate classes (terms of like weight):
   in a class it is at most the lengths of both rests multiplied, and at most
   the sum of the query's rest times the document's greatest coordinate there.
   Documents whose bound falls below the threshold go; those left after the
   rounds are scored exactly in 64-bit integers. Bounds are floats, raised by a
   margin beyond their rounding, so no document is dropped wrongly.
5. Each task sends at most k documents per query; the last ranking is over those.

Queries are taken in blocks of ``BLOCK_TERMS`` terms (one pass over the texts
each), so what a task is given does not grow with the number of queries; all
weights, counts and thresholds of a block are bounded by its terms. Results do
not depend on FIRST, BUCKET or FOCUS.

Null texts have no terms; items without terms return nothing; repeated items
are queries of their own; repeated documents are separate documents (ties by
id, null ids last, then in the order of the table). Empty tables give an empty
result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import ship_by_value, text_buffer, written

TOP = 50
FIRST = 8192
BUCKET = 4096
FOCUS = (8, 8, 8)
CLASSES = 16
#: Terms, repeats in different queries included, of a block of queries.
BLOCK_TERMS = 200_000
#: Bounds are raised by this share: far more than doubles lose in a sum of a million parts.
MARGIN = 1e-9
NO_ID = (1 << 63) - 1

#: Bytes of UTF-8: A-Z lower-cased, digits, letters and all beyond ASCII as they are, the rest white space.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def query_blocks(items: DataFrame, id_col: str, text_col: str, block_terms: int = BLOCK_TERMS) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The queries (id, distinct terms), read partition by partition, in blocks."""
    block: list[tuple[int | None, list[bytes]]] = []
    held = 0
    for row in items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).orderBy(id_col, text_col).toLocalIterator():
        terms = sorted(set(terms_of((row[1] or "").encode())))
        if not terms:
            continue
        if block and held + len(terms) > block_terms:
            yield block
            block, held = [], 0
        block.append((row[0], terms))
        held += len(terms)
    if block:
        yield block


def frequencies(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, n, term, tf): a document's number of terms and the
    frequencies of its terms of the vocabulary (by number)."""
    ship_by_value()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(vocabulary)}
        known = number.keys()
        for batch in batches:
            raw, at = text_buffer(batch.column(1))
            n, sizes, term, tf = [], [0], [], []
            for i in range(batch.num_rows):
                words = terms_of(raw[at[i]:at[i + 1]].tobytes())
                n.append(len(words))
                found = Counter(words)
                for t in known & found.keys():
                    term.append(number[t])
                    tf.append(found[t])
                sizes.append(len(term))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, kind)) for x, kind in ((term, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), *lists], ["doc_id", "row", "n", "term", "tf"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
            .mapInArrow(run, "doc_id long, row long, n long, term array<int>, tf array<long>"))


def document_counts(vectors: DataFrame, size: int) -> DataFrame:
    """(term, df): documents per term of the vocabulary, one row per task and term before the sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["term", "df"])

    return vectors.select("term").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def impacts(vectors: DataFrame, documents: int, all_terms: int) -> DataFrame:
    """(doc_id, row, norm, term, impact) of the documents that hold a term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lists = batch.column(2).to_numpy(), batch.column(4)
            sizes = np.diff(lists.offsets.to_numpy())
            tf = lists.flatten().to_numpy()
            m = np.repeat(100 - 50 + (50 * n * documents) // all_terms, sizes)
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m)
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            norm = np.sqrt(np.bincount(owner, impact.astype(np.float64) ** 2, batch.num_rows))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(norm), batch.column(3), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(impact))], ["doc_id", "row", "norm", "term", "impact"])
            yield out.filter(pa.array(sizes > 0))

    return vectors.select("doc_id", "row", "n", "term", "tf").mapInArrow(run, "doc_id long, row long, norm double, term array<int>, impact array<long>")


class Bucket:
    """Documents of like norm, the longest first, with an inverted list per
    term and, by coordinate class, their squared lengths and greatest impacts."""

    def __init__(self, doc: np.ndarray, row: np.ndarray, norm: np.ndarray, sizes: np.ndarray, term: np.ndarray, impact: np.ndarray, kind: np.ndarray) -> None:
        self.doc, self.row, self.norm = doc, row, norm
        owner = np.repeat(np.arange(len(doc)), sizes)
        by = np.argsort(term, kind="stable")  # documents ascend in each list
        self.owner, self.impact = owner[by], impact[by]
        self.starts = np.searchsorted(term[by], np.arange(len(kind) + 1))
        cell = owner * CLASSES + kind[term]
        self.squares = np.bincount(cell, impact.astype(np.float64) ** 2, len(doc) * CLASSES).reshape(-1, CLASSES)
        self.most = np.zeros(len(doc) * CLASSES)
        np.maximum.at(self.most, cell, impact)
        self.most = self.most.reshape(-1, CLASSES)

    def lists(self, terms: np.ndarray, of_term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, impact, what belongs to the term) over the lists of the terms."""
        a, size = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - a, size)
        return self.owner[at], self.impact[at], np.repeat(of_term, size)


class Query:
    """Terms by falling weight, in rounds, and the best documents so far."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, top: int, focus: tuple[int, ...], threshold: int, kind: np.ndarray) -> None:
        by = np.argsort(-weights, kind="stable")
        self.terms, self.weights, self.top = terms[by], weights[by], top
        self.kind = kind[self.terms]
        self.length = float(np.sqrt((self.weights.astype(np.float64) ** 2).sum()))
        self.rounds = []  # (terms of the round, by class the length and the sum of the rest behind it)
        for lo, hi in zip(np.cumsum((0, *focus)), np.cumsum(focus)):
            rest = self.weights[hi:].astype(np.float64)
            self.rounds.append((slice(int(lo), int(hi)), np.sqrt(np.bincount(self.kind[hi:], rest ** 2, CLASSES)), np.bincount(self.kind[hi:], rest, CLASSES)))
            if hi >= len(terms):
                break
        self.threshold = max(threshold, 1)
        self.best = np.empty((3, 0), np.int64)  # score, document, row

    def search(self, bucket: Bucket) -> tuple[int, int]:
        """Take the bucket's documents into account; (documents bounded, documents scored)."""
        floor = self.threshold / (1 + MARGIN)
        ahead = int(np.searchsorted(-(bucket.norm * self.length), -floor, "right"))
        if not ahead:
            return 0, 0
        n, alive = len(bucket.doc), np.arange(ahead)
        head, used = np.zeros(n), np.zeros(n * CLASSES)
        for part, length, total in self.rounds:
            weights = self.weights[part]
            owner, impact, number = bucket.lists(self.terms[part], np.arange(len(weights)))
            value = impact.astype(np.float64)
            head += np.bincount(owner, value * weights[number], n)
            used += np.bincount(owner * CLASSES + self.kind[part][number], value ** 2, n * CLASSES)
            left = np.sqrt(np.maximum(bucket.squares[alive] * (1 + MARGIN) - used.reshape(-1, CLASSES)[alive], 0))
            bound = head[alive] + np.minimum(left * length, bucket.most[alive] * total).sum(1)
            alive = alive[bound * (1 + MARGIN) >= self.threshold]
            if not len(alive):
                return ahead, 0
        owner, impact, weight = bucket.lists(self.terms, self.weights)
        chosen = np.zeros(n, bool)
        chosen[alive] = True
        keep = chosen[owner]
        score = np.zeros(n, np.int64)
        np.add.at(score, owner[keep], impact[keep] * weight[keep])
        good = np.flatnonzero(score >= self.threshold)
        if len(good):
            found = np.concatenate([self.best, np.stack([score[good], bucket.doc[good], bucket.row[good]])], 1)
            self.best = found[:, np.lexsort((found[2], found[1], -found[0]))[:self.top]]
            if self.best.shape[1] == self.top:
                self.threshold = max(self.threshold, int(self.best[0, -1]))
        return ahead, len(alive)


def classes(weights: np.ndarray) -> np.ndarray:
    """The coordinate class of each term: equal shares of the vocabulary by weight."""
    return np.searchsorted(np.quantile(weights, np.linspace(0, 1, CLASSES + 1)[1:-1]), weights) if len(weights) else weights


def search(vectors: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], thresholds: list[int], kind: np.ndarray, top: int = TOP,
           bucket_rows: int = BUCKET, focus: tuple[int, ...] = FOCUS) -> DataFrame:
    """(query, score, doc, row, bounded, scored): at most ``top`` documents per
    query and task. A last row per query with a null score counts the documents
    whose bound was looked at and those scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [Query(t, w, top, focus, least, kind) for (t, w), least in zip(queries, thresholds)]
        work = np.zeros((2, len(asked)), np.int64)

        def take(rows: pa.Table) -> None:
            rows = rows.combine_chunks()
            for b in rows.to_batches(max_chunksize=bucket_rows):
                lists = b.column(3), b.column(4)
                doc = b.column(0).fill_null(NO_ID).to_numpy()
                bucket = Bucket(doc, b.column(1).to_numpy(), b.column(2).to_numpy(), np.diff(lists[0].offsets.to_numpy()), lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy(), kind)
                for k, q in enumerate(asked):
                    work[:, k] += q.search(bucket)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= bucket_rows:
                take(pa.Table.from_batches(held))
                held = []
        if held:
            take(pa.Table.from_batches(held))
        number = np.repeat(np.arange(len(asked)), [q.best.shape[1] for q in asked])
        score, doc, row = np.concatenate([q.best for q in asked], 1) if asked else np.empty((3, 0), np.int64)
        some = [pa.array(np.r_[number, np.arange(len(asked))], pa.int32())]
        for x in (score, doc, row):
            some.append(pa.array(np.r_[x, np.zeros(len(asked), np.int64)], mask=np.r_[np.zeros(len(x), bool), np.ones(len(asked), bool)]))
        some += [pa.array(np.r_[np.zeros(len(score), np.int64), w]) for w in work]
        yield pa.RecordBatch.from_arrays(some, ["query", "score", "doc", "row", "bounded", "scored"])

    return vectors.select("doc_id", "row", "norm", "term", "impact").mapInArrow(run, "query int, score long, doc long, row long, bounded long, scored long")


def _search_block(docs: DataFrame, block: list[tuple[int | None, list[bytes]]], id_col: str, text_col: str, top: int,
                  first: int, bucket_rows: int, focus: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """(hits (query, score, doc, row), work (query, bounded, scored)) of a block of queries."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, terms in block for t in terms})
    vectors = written(frequencies(docs, vocabulary, id_col, text_col), "frequencies")
    documents, all_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).alias("w")
    weights = np.zeros(len(vocabulary), np.int64)
    for term, w in document_counts(vectors, len(vocabulary)).select("term", weight).collect():  # a row per term of the block
        weights[term] = w
    number = {t: k for k, t in enumerate(vocabulary)}
    queries = []
    for _, terms in block:
        t = np.array([number[x] for x in terms], np.int64)
        queries.append((t[weights[t] > 0], weights[t[weights[t] > 0]]))
    long_first = [F.desc("norm"), F.xxhash64("doc_id", "row")]  # copies have one length: dealt by their hash
    sized = written(impacts(vectors, documents, max(all_terms, 1)), "impacts")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc", "row")
    thresholds = [1] * len(block)
    share = min(1.0, first / max(documents, 1))
    edge = sized.agg(F.percentile_approx("norm", 1 - share)).first()[0]
    if edge is not None:
        seen = search(sized.where(F.col("norm") >= edge).coalesce(parts), queries, thresholds, classes(weights), top, bucket_rows, focus).where("score is not null")
        for row in seen.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == top).collect():  # at most a row per query of the block
            thresholds[row["query"]] = row["score"]
    found = written(search(sized.repartitionByRange(parts, *long_first).sortWithinPartitions(*long_first), queries, thresholds, classes(weights), top, bucket_rows, focus), "hits")
    hits = found.where("score is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return hits.select("query", "rank", "score", "doc"), found.groupBy("query").agg(F.sum("bounded").alias("bounded"), F.sum("scored").alias("scored"))


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", top: int = TOP, first: int = FIRST, bucket_rows: int = BUCKET, focus: tuple[int, ...] = FOCUS,
                   block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents of highest score above 0."""
    ship_by_value()
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in query_blocks(items, item_col, item_text_col, block_terms):
        hits, _ = _search_block(docs, block, id_col, text_col, top, first, bucket_rows, focus)
        names = spark.createDataFrame([(k, name) for k, (name, _) in enumerate(block)], "query int, item_id long")
        out = out.unionByName(hits.join(F.broadcast(names), "query").select("item_id", "rank", F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "score"))
    return out


def search_work(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                item_text_col: str = "text", top: int = TOP, first: int = FIRST, bucket_rows: int = BUCKET, focus: tuple[int, ...] = FOCUS) -> DataFrame:
    """(item_id, bounded, scored): per item of the first block, documents whose bound was looked at and documents scored."""
    ship_by_value()
    block = next(query_blocks(items, item_col, item_text_col))
    _, work = _search_block(docs, block, id_col, text_col, top, first, bucket_rows, focus)
    names = docs.sparkSession.createDataFrame([(k, name) for k, (name, _) in enumerate(block)], "query int, item_id long")
    return work.join(F.broadcast(names), "query").select("item_id", "bounded", "scored")
