"""Exact top-k by inner product with M-trees and best-first search.

Vectors become integers, floor(scale * x). With one more component that gives
all the same length M (0 for queries), the inner product s of a query q and
a vector v follows from their distance d: d * d = q * q + M * M - 2 * s, so the
largest products are the nearest neighbours, and the triangle inequality
holds.

Vectors are dealt to pivots (a bounded sample, ``PIVOTS`` of least hash) by
least distance; a pivot with more than ``SHARD_ROWS`` vectors is dealt over
several shards. Each shard is an M-tree: pages of up to ``PAGE`` entries, each
node with a routing vector, covering radius and distance to its parent's
routing vector, each entry with its distance to its page's. A query goes
through a shard best first: a queue holds nodes by the least distance that
radius and routing distance allow; children whose stored parent distance
already shows that they are too far are dropped without computing theirs, and
so are entries; it ends when no node can hold one of the k best.

First each query visits its own pivot's shards, which gives it a bound; then
the other shards, unless their pivot's radius rules them out. Queries are
dealt to blocks of about ``BLOCK``, and a task holds one shard and one block,
so neither side of it grows with the data. The shards' answers (k rows a query
at most) are merged by rank. Exact tests use integers; bounds keep a slack for
rounding.

Null vectors and such with null or non-finite components take no part;
shorter vectors count as filled with zeros. Rows with the query's own id are
no candidates; repeated query rows are answered once. Ties go to the smaller
id. Values must keep inner products below 2**53. An empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import ship_by_value, written

SCALE = 64
TOP = 20
EVERY = 20
PIVOTS = 32
SHARD_ROWS = 1 << 15
PAGE = 128
FAN = 16
BLOCK = 1 << 15
SLACK = 1e-6


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """List column as a matrix, short lists filled with zeros."""
    at = column.offsets.to_numpy()
    out = np.zeros((len(column), width))
    size = np.diff(at)
    values = column.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]]
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(values)) - np.repeat(at[:-1] - at[0], size)] = values
    return out


def _lifted(v: np.ndarray, longest: float) -> np.ndarray:
    return np.sqrt(np.maximum(longest - (v * v).sum(1), 0))


class Tree:
    """M-tree of one shard. Level 0 are the pages, the last level the root."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, longest: float) -> None:
        self.longest = longest
        x = np.hstack([v, _lifted(v, longest)[:, None]])
        order = self._packed(x)
        self.ids, self.x = ids[order], x[order]
        self.v = self.x[:, :-1]
        self.levels: list[dict[str, np.ndarray]] = []
        members, radius, size = self.x, np.zeros(len(self.x)), PAGE
        while True:
            cuts = np.arange(0, len(members), size)
            ends = np.r_[cuts[1:], len(members)]
            centre = np.add.reduceat(members, cuts) / (ends - cuts)[:, None]
            own = np.repeat(np.arange(len(cuts)), ends - cuts)
            up = np.sqrt(((members - centre[own]) ** 2).sum(1))  # stored distances to the parent's routing vector
            self.levels.append({"lo": cuts, "hi": ends, "at": centre, "radius": np.maximum.reduceat(up + radius, cuts), "up": up})
            if len(cuts) == 1:
                break
            members, radius, size = centre, self.levels[-1]["radius"], FAN

    @staticmethod
    def _packed(x: np.ndarray) -> np.ndarray:
        """Bulk loading: halves by the distance to two far members, down to pages."""
        out, work = [], [np.arange(len(x))]
        while work:
            own = work.pop()
            if len(own) <= PAGE:
                out.append(own)
                continue
            far = lambda p: ((x[own] - p) ** 2).sum(1)
            a = x[own[int(np.argmax(far(x[own[0]])))]]
            da = far(a)
            b = x[own[int(np.argmax(da))]]
            half = -(-len(own) // (2 * PAGE)) * PAGE
            by = np.argsort(da - far(b), kind="stable")
            work += [own[by[half:]], own[by[:half]]]
        return np.concatenate(out)

    def search(self, query: int, q: np.ndarray, k: int, bound: float) -> list[tuple[float, int]]:
        """The k best (score, -id) of scores from ``bound`` up, smallest first."""
        length = float(q @ q)
        point = np.r_[q, 0.0]
        reach = lambda s: np.sqrt(max(length + self.longest - 2 * s, 0.0)) * (1 + SLACK) + SLACK if s > -np.inf else np.inf
        best: list[tuple[float, int]] = []
        limit = reach(bound)
        root = self.levels[-1]
        first = float(np.sqrt(((root["at"][0] - point) ** 2).sum()))
        queue = [(max(first - float(root["radius"][0]), 0.0), len(self.levels) - 1, 0, first)]
        while queue and queue[0][0] <= limit:
            _, level, node, away = heapq.heappop(queue)
            here = self.levels[level]
            lo, hi = int(here["lo"][node]), int(here["hi"][node])
            gap = np.abs(here["up"][lo:hi] - away)  # what the stored distances tell of the children
            if level:
                below = self.levels[level - 1]
                kept = lo + np.flatnonzero(gap - below["radius"][lo:hi] <= limit)
                if len(kept):
                    d = np.sqrt(((below["at"][kept] - point) ** 2).sum(1))
                    least = np.maximum(d - below["radius"][kept], 0.0)
                    for n, l, a in zip(kept.tolist(), least.tolist(), d.tolist()):
                        if l <= limit:
                            heapq.heappush(queue, (l, level - 1, n, a))
                continue
            kept = lo + np.flatnonzero(gap <= limit)
            if not len(kept):
                continue
            score = self.v[kept] @ q
            good = score >= bound
            if len(best) == k:
                good &= score >= best[0][0]
            for s, i in zip(score[good].tolist(), self.ids[kept[good]].tolist()):
                if i == query:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                bound = max(bound, best[0][0])
                limit = reach(bound)
        return best


def _floored(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): integer vectors without null or non-finite components."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.col(vector_col).isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return df.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def top_products(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, every: int = EVERY,
                 scale: int = SCALE, pivots: int = PIVOTS, shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by
    ``every`` the k best other rows by integer inner product."""
    ship_by_value()
    vectors = _floored(df, id_col, vector_col, scale)
    length = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)
    width, longest = vectors.agg(F.max(F.size("v")), F.max(length)).first()
    width, longest = width or 0, float(longest or 0)
    if longest >= 2 ** 52:
        raise ValueError("the vectors are too long for exact products; use a smaller scale")
    # bounded sample: at most ``pivots`` vectors
    at = vectors.distinct().orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(pivots).toPandas()["v"].tolist()
    centres = np.zeros((max(len(at), 1), width + 1))
    for row, v in enumerate(at):
        centres[row, :len(v)] = v
    centres[:, -1] = _lifted(centres[:, :-1], longest)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1), width)
            x = np.hstack([v, _lifted(v, longest)[:, None]])
            d = (x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T
            best = d.argmin(1)
            away = np.sqrt(((x - centres[best]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best.astype(np.int32)), pa.array(away)], ["vec_id", "v", "pivot", "away"])

    dealt = written(vectors.mapInArrow(near, "vec_id long, v array<long>, pivot int, away double"), "vectors")
    # one row per pivot
    sizes = dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).orderBy("pivot").collect()
    split = {r.pivot: -(-r.n // shard_rows) for r in sizes}
    shards = [(r.pivot, s) for r in sizes for s in range(split[r.pivot])]
    number = {x: n for n, x in enumerate(shards)}
    radius = np.array([{r.pivot: r.radius for r in sizes}[p] for p, _ in shards])
    middle = centres[[p for p, _ in shards]] if shards else centres[:0]
    first = F.create_map(*[F.lit(x) for p in split for x in (p, number[p, 0])]) if split else F.create_map(F.lit(0), F.lit(0))
    parts = F.create_map(*[F.lit(x) for p in split for x in (p, split[p])]) if split else first
    rows = dealt.withColumn("shard", (first[F.col("pivot")] + F.pmod(F.xxhash64("vec_id", "v"), parts[F.col("pivot")])).cast("int")).select("shard", "vec_id", "v")
    asked = dealt.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by(F.struct("pivot", "v"), F.struct("pivot", "v")).alias("q"))
    asked = written(asked.select(F.col("vec_id").alias("query_id"), "q.pivot", "q.v"), "queries")
    blocks = max(1, -(-asked.count() // block))

    def solve(members: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(members) and len(asks):
            whole = lambda c: _matrix(pa.array(c, pa.list_(pa.int64())), width)
            tree = Tree(members["vec_id"].to_numpy(), whole(members["v"]), longest)
            for query, q, bound in zip(asks["query_id"].tolist(), whole(asks["v"]), asks["bound"].tolist()):
                found += [(query, -i, int(s)) for s, i in tree.search(query, q, k, bound)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    schema = "query_id long, vec_id long, score long"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def visit(to: DataFrame) -> DataFrame:
        """Answers of the shards that ``to`` (shard, query_id, v, bound) names."""
        each = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else rows.withColumn("block", F.lit(0))
        asks = to.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        return each.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInPandas(solve, schema)

    home = asked.select(F.explode(F.sequence(first[F.col("pivot")], first[F.col("pivot")] + parts[F.col("pivot")] - 1)).alias("shard"), "query_id", "v", F.lit(float("-inf")).alias("bound"))
    near_home = written(visit(home).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "home")
    bounds = near_home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("bound"))
    told = asked.join(bounds, "query_id", "left").select("query_id", "pivot", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.array([p for p, _ in shards])
        for b in batches:
            v, bound = _matrix(b.column(2), width), b.column(3).to_numpy()
            x = np.hstack([v, np.zeros((len(v), 1))])
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (middle * middle).sum(1) - 2 * x @ middle.T, 0))
            with np.errstate(invalid="ignore"):
                limit = np.sqrt(np.maximum((v * v).sum(1) + longest - 2 * bound, 0)) * (1 + SLACK) + SLACK
            own = b.column(1).to_numpy()
            go = (d - radius[None, :] <= limit[:, None] + 1e-3) & (pivot[None, :] != own[:, None])
            q, s = np.nonzero(go)
            ids = pa.array(q)
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), b.column(0).take(ids), b.column(2).take(ids), b.column(3).take(ids)], ["shard", "query_id", "v", "bound"])

    if not shards:
        return near_home.select("query_id", "rank", "vec_id", "score")
    away = visit(told.mapInArrow(route, "shard int, query_id long, v array<long>, bound double"))
    merged = near_home.drop("rank").unionByName(away).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")
