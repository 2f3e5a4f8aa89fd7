"""Exact removal of long repeated byte strings with suffix arrays.

A position is repeated if the ``length`` bytes from it also start at another
position of any document. Every byte covered by such a string is removed;
all are judged on the input.

1. Anchors. Each window of ``length`` bytes names the ``GRAM``-byte string
   with the least hash in it (the leftmost, on ties). Equal windows name
   equal strings, so repeats meet under their anchor. Neighbouring windows
   with one anchor string form a run of at most ``length`` windows: one row
   for about 150 positions, in a text of one character too. Runs whose
   anchor occurs once, in one place of the run, are done.
2. Equal runs (named by the anchor's 64 bits and 64 bits of their own bytes)
   are folded by a grouped count: a run that occurs twice is repeated
   throughout. Groups of copies end here.
3. Anchors with several different runs go on with one row per different run.
   Runs are dealt to shards by anchor; an anchor with more than ``SHARD_RUNS``
   different runs is dealt over several shards by the run's own hash. Each
   shard sorts its suffixes (Larsson-Sadakane refinement) and finds common
   prefixes of neighbours (Kasai).
4. Shards of one anchor are merged: each sends its windows, dealt by hash and
   sorted, and a binary search finds those that other shards hold too.

With ``across`` a position counts only if its bytes also start in another
document: the grouped counts and the merged windows then carry the least and
greatest place of each string, a place being a document, and a string whose
two ends are one document stays. With ``min_words`` a repeated stretch is taken out only if so many whole
words (``[^\x20\x09-\x0D]+``) lie in it. ``without_repeats``, the filter of the
pipeline, uses both: ``PASSAGE_WORDS`` words, found by ``PASSAGE_BYTES`` bytes,
which passages of so many words have unless their words are shorter than four
letters on average; op8 uses neither.

Null text is empty; texts shorter than ``length`` lose nothing. Rows are told
apart by (doc_id, hash of the text), so null or repeated ids are fine: rows
that repeat a row are copies of it (with ``across``, the same document). An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import ship_by_value, text_buffer, tidied, written

LENGTH = 400
GRAM = 100
#: A passage for the pipeline: whole words, and the bytes and gram by which it is found.
PASSAGE_WORDS = 50
PASSAGE_BYTES = 240
PASSAGE_GRAM = 60
#: Positions of a text that are looked at together.
PIECE = 1 << 19
SHARD_RUNS = 4096
#: Bytes of whole anchor groups that are sorted together.
SHARD_BYTES = 1 << 20
#: Least and greatest place of what is known to lie at several.
SEVERAL = (-1 << 63, (1 << 63) - 1)
#: Odd factor of the polynomial hash modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse powers, modulo 2**64."""
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(data: np.ndarray, gram: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position that has so many."""
    up, down = powers
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return _mix((sums[gram:] - sums[:-gram]) * down[:len(data) - gram + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours: running minima inside blocks, from both ends."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def runs_of(data: np.ndarray, length: int, gram: int, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(anchor hash, first start, last start, the anchor stands at several
    places) of the runs of one text."""
    found: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(data) - length + 1, PIECE):
        part = data[lo:lo + PIECE + length - 1]
        h = gram_hashes(part, gram, powers)
        low = np.uint64((1 << 20) - 1)
        least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        at = (least & low).astype(np.int64)
        anchor = h[at]
        cuts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        parts = -(-np.diff(np.r_[cuts, len(anchor)]) // length)  # periodic text holds on to one anchor
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        cuts = np.repeat(cuts, parts) + inner * length
        last = np.r_[cuts[1:], len(anchor)] - 1
        found.append((anchor[cuts], cuts + lo, last + lo, at[cuts] != at[last]))
    if not found:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*found))


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: groups sorted by h bytes are refined to 2h bytes by
    the group numbers h places on, until all are single. Sorted groups rest."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k:n + k]
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order[1:]] != key[order[:-1]]]
    slots, group = np.arange(n), np.zeros(n + 1, np.int64)
    group[n] = -1
    first = np.maximum.accumulate(np.where(new, slots, 0))
    group[order] = first
    h = 8
    while h < n:
        alone = new & np.r_[new[1:], True]
        slots, first = slots[~alone], first[~alone]
        if not len(slots):
            break
        at = order[slots]
        nxt = group[np.minimum(at + h, n)]
        by = np.argsort(first * (n + 2) + nxt + 1, kind="stable")
        at, nxt = at[by], nxt[by]
        order[slots] = at
        new = np.r_[True, (first[1:] != first[:-1]) | (nxt[1:] != nxt[:-1])]
        first = np.maximum.accumulate(np.where(new, slots, 0))
        group[at] = first
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, lanes: np.ndarray, limit: int) -> np.ndarray:
    """Kasai's common prefix of each suffix of ``order`` with the one before
    it, up to ``limit``. Text order is kept inside each lane (a run of
    neighbouring starts), and all lanes go on one place at a time: the prefix
    at the next place is at most one shorter, if the suffix before has a next
    place too; else it is counted anew."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    usable = np.zeros(n + 1, bool)
    usable[order] = True
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k:n + k]
    common = np.zeros(n, np.int64)
    by = np.argsort(-lanes, kind="stable")
    place, size = starts[by], lanes[by]
    have = np.zeros(len(by), np.int64)
    step = 0
    while len(place):
        i, j = place + step, before[place + step]
        go = np.flatnonzero(j >= 0)
        have[j < 0] = 0
        while len(go):
            a, b = i[go] + have[go], j[go] + have[go]
            differ = key[np.minimum(a, n - 1)] ^ key[np.minimum(b, n - 1)]
            same = (differ == 0).astype(np.int64)
            for k in range(1, 8):
                same += differ < np.uint64(1 << (8 * k))
            have[go] = np.minimum(have[go] + same, limit)
            go = go[(same == 8) & (have[go] < limit)]
        common[i] = have
        kept = (j >= 0) & usable[np.minimum(j + 1, n)]
        have = np.where(kept, np.maximum(have - 1, 0), 0)
        step += 1
        left = int(np.searchsorted(-size, -step))  # lanes of more than step places
        place, size, have = place[:left], size[:left], have[:left]
    return common


def shard_repeats(data: np.ndarray, base: np.ndarray, count: np.ndarray, length: int,
                  least: np.ndarray, most: np.ndarray, across: bool = False) -> tuple[np.ndarray, ...]:
    """For runs laid one after another in ``data`` (run r has ``count[r]``
    starts from ``base[r]`` and lies at places from ``least[r]`` to
    ``most[r]``), per byte: (mark: the string starts several times in the
    shard, or ``across``, lies at several places; the start's class: the same
    number for equal strings, -1 elsewhere; the least and the greatest place
    of its class, ``SEVERAL`` for marked ones)."""
    n = len(data)
    run = np.full(n, -1, np.int64)
    for r, (a, c) in enumerate(zip(base.tolist(), count.tolist())):
        run[a:a + c] = r
    order = suffix_array(data)
    order = order[run[order] >= 0]
    common = common_prefixes(data, order, base, count, length)[order]
    same = np.zeros(len(order), bool)
    same[1:] = common[1:] >= length
    kind, mark = np.full(n, -1, np.int64), np.zeros(n, bool)
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first, number = np.flatnonzero(~same), np.cumsum(~same) - 1
    kind[order] = number
    least, most = np.minimum.reduceat(least[run[order]], first), np.maximum.reduceat(most[run[order]], first)
    several = least < most
    if not across:
        several |= np.diff(np.r_[first, len(order)]) > 1
    least[several], most[several] = SEVERAL
    low[order], high[order], mark[order] = least[number], most[number], several[number]
    return mark, kind, low, high


def _spans(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each stretch of set marks."""
    edge = np.diff(np.r_[False, mark, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


RUN = "a int, b int"
KEY = "doc_id long, th long"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    other = F.struct(F.lit(0).cast("byte").alias("__"), *[c for c in docs.columns if c not in (id_col, text_col)])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"), other.alias("other"))


def find_runs(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, r, doc_id, th, a, b, folds): the runs, with a hash of their
    bytes; a run that folds may repeat strings in itself."""
    ship_by_value()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(PIECE + length)
        for batch in batches:
            raw, at = text_buffer(batch.column(2))
            out: list[tuple[np.ndarray, ...]] = []
            held = 0
            for i in range(batch.num_rows):
                if at[i + 1] - at[i] >= length:
                    data = raw[at[i]:at[i + 1]]
                    anchor, a, b, folds = runs_of(data, length, gram, powers)
                    text = memoryview(data)
                    digest = np.frombuffer(b"".join([xxhash.xxh3_64_digest(text[x:y]) for x, y in zip(a.tolist(), (b + length).tolist())]), np.int64)
                    out.append((anchor.view(np.int64), digest, a.astype(np.int32), b.astype(np.int32), folds, np.full(len(a), i, np.int64)))
                    held += len(a)
                if out and (held > 50_000 or i == batch.num_rows - 1):
                    anchor, r, a, b, folds, row = (np.concatenate(x) for x in zip(*out))
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(r), batch.column(0).take(row), batch.column(1).take(row), pa.array(a), pa.array(b), pa.array(folds)], ["anchor", "r", "doc_id", "th", "a", "b", "folds"])
                    out, held = [], 0

    return keyed.mapInArrow(tidied(run), f"anchor long, r long, {KEY}, {RUN}, folds boolean")


def _sorted_shards(rows: DataFrame, length: int, across: bool) -> DataFrame:
    """Suffix arrays of the shards. Rows: (anchor, part, spread, many, r, low,
    high, a, doc_id, th, body). Returns (kind, anchor, r, doc_id, th, a, b, w1,
    w2, todo, low, high): kind 0 are repeated starts, kind 1 windows of anchors
    that lie in several shards."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        raw, at = text_buffer(table.column("body").combine_chunks())
        base, data = at[:-1] - at[0], raw[at[0]:at[-1]]
        count = np.diff(at) - length + 1
        spread, many = (table.column(x).to_numpy(zero_copy_only=False).astype(bool) for x in ("spread", "many"))
        a0, least, most = (table.column(x).to_numpy().astype(np.int64) for x in ("a", "low", "high"))
        mark, kind, low, high = shard_repeats(data, base, count, length, least, most, across)
        rows, lo, hi, wrow, wpos, w1, w2, todo = [], [], [], [], [], [], [], []
        seen: set[int] = set()
        text = memoryview(data)
        for r in range(len(base)):
            own = slice(base[r], base[r] + count[r])
            if not many[r]:
                x, y = _spans(mark[own])
                rows += [r] * len(x)
                lo.append(x + a0[r])
                hi.append(y + a0[r])
            if spread[r]:
                # each start that is still open, and one witness of the classes that are done
                for p, (k, done) in enumerate(zip(kind[own].tolist(), mark[own].tolist())):
                    is_open = not (done or many[r])
                    if is_open or k not in seen:
                        seen.add(k)
                        w = xxhash.xxh3_128_digest(text[base[r] + p:base[r] + p + length])
                        wrow.append(r)
                        wpos.append(p)
                        w1.append(int.from_bytes(w[:8], "little", signed=True))
                        w2.append(int.from_bytes(w[8:], "little", signed=True))
                        todo.append(is_open)
        at_window = base[wrow] + np.array(wpos, np.int64) if wrow else np.empty(0, np.int64)
        none, wpos = np.zeros(len(rows), np.int64), a0[wrow] + np.array(wpos, np.int64) if wrow else []
        for kind_, row, x, y, h1, h2, t, d1, d2 in ((0, rows, np.concatenate([*lo, []]), np.concatenate([*hi, []]), none, none, none.astype(bool), none, none),
                                                    (1, wrow, wpos, wpos, w1, w2, todo, low[at_window], high[at_window])):
            if len(row):
                ids = pa.array(row, pa.int64())
                take = {c: table.column(c).combine_chunks().take(ids) for c in ("anchor", "r", "doc_id", "th")}
                cols = [pa.array([kind_] * len(row), pa.int32()), *take.values(), pa.array(np.asarray(x, np.int32)), pa.array(np.asarray(y, np.int32)), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(t, pa.bool_()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["kind", *take, "a", "b", "w1", "w2", "todo", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole groups of up to SHARD_BYTES, and the group that is not over

        def groups(table: pa.Table) -> np.ndarray:
            key, part = (table.column(x).to_numpy() for x in ("anchor", "part"))
            return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])

        for batch in batches:
            held.append(batch)
            if sum(x.column("body").nbytes for x in held) < SHARD_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(groups(table)[-1])
            if last:
                yield from in_shards(table.slice(0, last), groups(table)[:-1])
            held = table.slice(last).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            if table.num_rows:
                yield from in_shards(table, groups(table))

    def in_shards(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, at = text_buffer(table.column("body").combine_chunks())
        lo, ends = 0, np.r_[cuts[1:], table.num_rows]
        for k, end in enumerate(ends.tolist()):
            if k + 1 == len(ends) or at[ends[k + 1]] - at[lo] > SHARD_BYTES:
                yield from solve(table.slice(lo, end - lo))
                lo = end

    return rows.mapInArrow(tidied(run), f"kind int, anchor long, r long, {KEY}, {RUN}, w1 long, w2 long, todo boolean, low long, high long")


def _merged(windows: DataFrame) -> DataFrame:
    """Open windows whose string lies at several places of all shards:
    dealt by hash and sorted, a binary search gives each window the range of
    its equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches(([held] if held is not None else []) + [batch]).combine_chunks()
            w1 = table.column("w1").to_numpy()
            last = int(np.searchsorted(w1, w1[-1], "left")) if len(w1) else 0
            yield from shared(table.slice(0, last))
            rest = table.slice(last).combine_chunks().to_batches()
            held = rest[0] if rest else None
        if held is not None:
            yield from shared(pa.Table.from_batches([held]))

    def shared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        w1, w2 = (table.column(x).to_numpy() for x in ("w1", "w2"))
        name = np.cumsum(np.r_[False, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
        first = np.searchsorted(name, np.arange(name[-1] + 1))
        low, high = (table.column(x).to_numpy() for x in ("low", "high"))
        several = np.minimum.reduceat(low, first) < np.maximum.reduceat(high, first)
        keep = several[name] & table.column("todo").to_numpy(zero_copy_only=False).astype(bool)
        out = table.select(["anchor", "r", "doc_id", "th", "a", "b"]).filter(pa.array(keep)).combine_chunks()
        yield from out.to_batches()

    return (windows.select("w1", "w2", "anchor", "r", "doc_id", "th", "a", "b", "todo", "low", "high").repartition("w1", "w2")
            .sortWithinPartitions("w1", "w2").mapInArrow(tidied(run), f"anchor long, r long, {KEY}, {RUN}"))


def repeated_starts(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, across: bool = False) -> DataFrame:
    """(doc_id, th, a, b): stretches of starts whose ``length`` bytes also
    start elsewhere (``across``: in another document)."""
    ship_by_value()
    runs = written(find_runs(keyed, length, gram), "runs")
    # written, so that the join below reads plain exchanges, which may be split where an anchor is hot
    folds = F.lit(False) if across else F.bool_or("folds")
    twice = written(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), folds.alias("folds")).where("n > 1 or folds").select("anchor"), "twice")
    runs = written(runs.join(twice, "anchor", "left_semi"), "anchored")
    place = F.xxhash64("doc_id", "th") if across else F.xxhash64("doc_id", "th", "a")
    different = runs.groupBy("anchor", "r").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("low"), F.max(place).alias("high"), folds.alias("folds"), *[F.first(c).alias(c) for c in ("doc_id", "th", "a", "b")])
    # rows that repeat a row share its places, and are its copies
    different = written(different.withColumn("many", F.expr("low < high") if across else F.col("n") > 1), "different")
    whole = runs.join(different.where("many").select("anchor", "r"), ["anchor", "r"], "left_semi").select("doc_id", "th", "a", "b")
    several = written(different.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.bool_and("many").alias("done"), F.bool_or("folds").alias("folds")).where("(kinds > 1 or folds) and not done").select("anchor", "kinds"), "several")
    shards = F.ceil(F.col("kinds") / SHARD_RUNS)
    ends = [F.when(F.col("many"), F.lit(end)).otherwise(F.col(c)).alias(c) for c, end in zip(("low", "high"), SEVERAL)]
    asked = (different.join(several, "anchor").withColumn("part", F.pmod("r", shards).cast("int"))
             .select("doc_id", "th", F.struct("anchor", "part", (shards > 1).alias("spread"), "many", "r", *ends, "a", "b").alias("run"))
             .groupBy("doc_id", "th").agg(F.collect_list("run").alias("asked")))
    texts = keyed.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "text")
    fetched = asked.join(texts, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__t"))).select("doc_id", "th", "text", "asked")

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "part", "spread", "many", "r", "low", "high", "a"]
        for batch in batches:
            raw, at = text_buffer(batch.column(2))
            lists = batch.column(3)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            run = lists.flatten()
            a, b = (run.field(x).to_numpy().astype(np.int64) for x in ("a", "b"))
            for lo in range(0, len(rows), 4096):
                own = slice(lo, lo + 4096)
                body = [raw[at[r] + x:at[r] + y + length].tobytes() for r, x, y in zip(rows[own].tolist(), a[own].tolist(), b[own].tolist())]
                ids = pa.array(rows[own])
                yield pa.RecordBatch.from_arrays([*[run.field(x)[own] for x in names], batch.column(0).take(ids), batch.column(1).take(ids), pa.array(body, pa.binary())], [*names, "doc_id", "th", "body"])

    rows = fetched.mapInArrow(tidied(bodies), f"anchor long, part int, spread boolean, many boolean, r long, low long, high long, a int, {KEY}, body binary")
    rows = rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "doc_id", "th", "a")
    solved = written(_sorted_shards(rows, length, across), "solved")
    found = solved.where("kind = 0").select("anchor", "r", "doc_id", "th", "a", "b").unionByName(_merged(solved.where("kind = 1")))
    if across:  # a run that only its own document repeats stood for its copies there
        found = written(found, "found")
        folded = different.where("n > 1 and not many").select("anchor", "r", F.col("a").alias("from"))
        copies = runs.select("anchor", "r", F.col("a").alias("to")).join(folded, ["anchor", "r"])
        moved = F.col("to") - F.col("from")
        there = found.join(copies, ["anchor", "r"]).select("doc_id", "th", (F.col("a") + moved).alias("a"), (F.col("b") + moved).alias("b"))
        whole = whole.unionByName(there)
    return whole.unionByName(found.select("doc_id", "th", "a", "b"))


def _covered(spans: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mark of the bytes that the windows from these starts cover."""
    edge = np.zeros(n + 1, np.int32)
    if len(spans):
        np.add.at(edge, spans[:, 0], 1)
        np.add.at(edge, spans[:, 1] + length, -1)
    return np.cumsum(edge[:n]) > 0


def _long_enough(mark: np.ndarray, data: np.ndarray, min_words: int) -> np.ndarray:
    """``mark`` without the stretches that hold fewer whole words."""
    white = (data == 32) | ((data >= 9) & (data <= 13))
    first, last = _spans(~white)
    out = mark.copy()
    for x, y in zip(*_spans(mark)):
        if np.searchsorted(last, y, "right") - np.searchsorted(first, x, "left") < min_words:
            out[x:y + 1] = False
    return out


def decoded(kept: str = "kept") -> Column:
    """The remaining bytes as text. Where a removed stretch cut a character
    in two, the bytes left of it go as well."""
    return F.coalesce(F.try_validate_utf8(kept), F.regexp_replace(F.make_valid_utf8(kept), "\ufffd", ""))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH, gram: int = GRAM, across: bool = False, min_words: int = 0) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, other): one row per row of
    ``docs``; kept are the remaining bytes, other the columns besides the two
    named."""
    ship_by_value()
    keyed = _keyed(docs, id_col, text_col)
    found = (repeated_starts(keyed.drop("other"), length, gram, across).groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
             .select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "spans"))
    both = (keyed.join(found, keyed.doc_id.eqNullSafe(F.col("__d")) & (keyed.th == F.col("__t")), "left")
            .select("doc_id", "text", "spans", "other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffer(batch.column(1))
            lists = batch.column(2)
            has = lists.is_valid().to_numpy(zero_copy_only=False)
            removed, spans, kept = [], [], []
            for i in range(batch.num_rows):
                data = raw[at[i]:at[i + 1]]
                if has[i]:
                    own = lists[i].values
                    mark = _covered(np.stack([own.field(0).to_numpy(), own.field(1).to_numpy()], 1).astype(np.int64), length, len(data))
                    if min_words:
                        mark = _long_enough(mark, data, min_words)
                    removed.append(int(mark.sum()))
                    spans.append(len(_spans(mark)[0]))
                    data = data[~mark]
                else:
                    removed.append(0)
                    spans.append(0)
                kept.append(data.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), batch.column(3)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "other"])

    fields = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept binary").fields
    return both.mapInArrow(tidied(run), T.StructType([*fields, both.schema["other"]]))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = PASSAGE_BYTES,
                    gram: int = PASSAGE_GRAM, across: bool = True, min_words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` with the passages that other documents hold too taken out of
    the text, at all their places (and ``n_chars`` counted anew, if there is
    such a column); all rows stay, if need be with empty text."""
    out = remove_repeats(docs, id_col, text_col, length, gram, across, min_words)
    other = {c: F.col("other").getField(c) for c in docs.columns if c not in (id_col, text_col)}
    if "n_chars" in other:
        other["n_chars"] = F.length(decoded()).cast(docs.schema["n_chars"].dataType)
    columns = {id_col: F.col("doc_id").cast(docs.schema[id_col].dataType), text_col: decoded(), **other}
    return out.select(*[columns[c].alias(c) for c in docs.columns])
