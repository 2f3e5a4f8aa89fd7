"""Mixing sources to target weights by Pareto order sampling.

Sources in code point order (null last) get the weights 5, 2, 1, repeating,
of 150 % of all words; a source's target stops at ``max_copies`` times its
size and the excess is shared again by weight until none is above.

Every document is taken floor(target / size) whole times for certain. What
is left of the target is a share f < 1 of the source: each document is taken once more
with inclusion probability f times its importance over the mean importance of
the source's words (at most 1). The importance is a column, or by default
``size ** -TILT``: a document of 16 times the words has half the odds, so the
part copies hold more different documents than an even draw would. It is done
by Pareto order sampling: documents are ranked by the odds of a random number
(a hash of id, text and seed, so reruns agree) divided by their inclusion
odds, and the first are selected as long as they hold no more words than the
sample is to have, which fixes its size. The document that does not fit any
more is left out and the ranks behind it are gone on with (``_fill``), until
what is lacking is less than each document left (a few documents of a source,
smaller ones more often than their odds say); at the threshold one document
on either side may then trade places, if that brings the words nearer.

The threshold is found as a histogram quantile: the ranking key is mapped to
``BINS`` bins per source, bins below the target are taken whole, bins above
not at all, and only the bin that holds the threshold is put in order. A
source with a third of all rows is an aggregate with map-side combine, and
one of its bins is ordered in a task.

Null text has size 0 and is never taken (0 words); sources of size 0 have
target 0. Documents tie in rank only if id and text repeat; then both are
taken or neither. An empty table gives an empty result. Only DataFrame
functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import written
from ledgerlens.operators.indexing import global_index

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_COPIES = 2
SEED = 17
BINS = 4096
EDGE = 64
TILT = 0.25


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``: white space is folded and
    trimmed, what is left between is counted."""
    blank = "[\\u0020\\u0009-\\u000D]+"
    folded = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), blank, " "))
    spaces = F.length(folded) - F.length(F.replace(folded, F.lit(" "), F.lit("")))
    return F.when(folded == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    With caps c = max_copies * size and weights w, the targets are
    min(c, w * t): sources are capped in the order of c / w, and t is what
    the words left give per weight left, at the first source that its share
    does not fill. One row per source; numbering is by range partitions."""
    named = sizes.withColumn("last", F.col("source").isNull())
    ordered = global_index(named, ["last", "source"], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    full = (ordered.withColumn("w", weight).withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
            .withColumn("per", F.col("cap") / F.col("w")))
    words, all_w = full.agg(F.sum("source_size"), F.sum("w")).first()
    # one row per source: a running sum over them in one task
    ahead = Window.orderBy("per", "place").rowsBetween(Window.unboundedPreceding, -1)
    capped, used = (F.coalesce(F.sum(c).over(ahead), F.lit(0.0)) for c in ("cap", "w"))
    level = (full.select("per", "place", ((F.lit(float(words or 0) * share) - capped) / (F.lit(float(all_w or 0)) - used)).alias("t"))
             .where("t <= per").agg(F.min_by("t", F.struct("per", "place"))).first()[0])
    return full.select("source", "source_size", (F.col("cap") if level is None else F.least(F.col("cap"), F.col("w") * level)).alias("target"))


def _sample(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` (s, size, key, ...) with ``more``: 1 where the document is
    among the first of its source that hold no more than ``words`` of
    ``asked`` (s, words) together."""
    binned = rows.withColumn("bin", F.least(F.floor(F.col("key") * BINS), F.lit(BINS - 1)).cast("int"))
    ahead = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    held = (binned.groupBy("s", "bin").agg(F.sum("size").alias("words_in")).join(asked, "s")  # at most BINS rows per source
            .withColumn("words_ahead", F.coalesce(F.sum("words_in").over(ahead), F.lit(0)).cast("double")))
    state = (F.when(F.col("words_ahead") + F.col("words_in") <= F.col("words"), 1)
             .when(F.col("words_ahead") >= F.col("words"), 0).otherwise(2))
    bins = held.select("s", "bin", state.alias("state"), (F.col("words") - F.col("words_ahead")).alias("room"))
    told = binned.join(bins, ["s", "bin"])
    order = Window.partitionBy("s", "bin").orderBy("key", "tie")
    upto = F.sum("size").over(order.rangeBetween(Window.unboundedPreceding, 0))
    chosen = told.where("state = 2").withColumn("more", (upto <= F.col("room")).cast("int"))
    return (told.where("state <> 2").withColumn("more", F.col("state")).unionByName(chosen)
            .drop("bin", "state", "room"))


def _open(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(s, open): words of ``asked`` (s, words) that the selected rows leave."""
    got = rows.groupBy("s").agg(F.sum(F.col("more") * F.col("size")).alias("got"))
    return asked.join(got, "s").select("s", (F.col("words") - F.col("got")).alias("open"))


def _fill(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(s, key, tie): documents behind the threshold that fill what the first
    ones leave open; afterwards each document left is larger than the gap.

    Three passes. The first goes down the ranks again with the documents of at
    most half the gap. The second does so per size class (a power of two),
    larger classes first: of a class only the first documents that together
    fit the gap can be needed. Where a class is not used up, its next document
    did not fit, so that the gap is less than twice the smallest document left,
    and the third pass takes the first one that still fits, if any."""
    gaps = _open(rows, asked).where("open >= 1")
    # rows that repeat id and text are one: both are taken or neither
    free = written(rows.where(F.col("more") == 0).groupBy("s", "key", "tie").agg(F.sum("size").alias("size")).where("size > 0")
                   .join(gaps, "s").where("size <= open"), "free")
    again = _sample(free.where("size <= open / 2").select("s", "key", "tie", "size"), gaps.select("s", F.col("open").alias("words"))).where("more = 1")
    first = written(again.select("s", "key", "tie", "size"), "fill")
    held = first.groupBy("s").agg(F.sum("size").alias("held"))
    free = (free.join(first.select("s", "key", "tie"), ["s", "key", "tie"], "left_anti").join(held, "s", "left")
            .withColumn("open", F.col("open") - F.coalesce("held", F.lit(0))).drop("held").where("size <= open"))
    free = written(free.withColumn("class", F.floor(F.log2("size")).cast("int")), "free")
    name = F.struct("s", "class")
    rooms = free.select(name.alias("s"), F.col("open").alias("words")).distinct()
    near = _sample(free.select(name.alias("s"), "key", "tie", "size"), rooms).where("more = 1")
    # of each class at most as many documents as fit the gap
    upto = F.sum("size").over(Window.partitionBy("s", "class").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, 0))
    near = written(near.select("s.s", "s.class", "key", "tie", "size").withColumn("upto", upto), "near")
    sums = (near.groupBy("s", "class").agg(F.collect_list("upto").alias("sums")).groupBy("s")
            .agg(F.reverse(F.sort_array(F.collect_list(F.struct("class", "sums")))).alias("classes"))
            .join(free.select("s", "open").distinct(), "s"))
    start = F.struct(F.col("open").alias("room"), F.lit(0).cast("double").alias("last"))

    def step(state: Column, one: Column) -> Column:
        fits = F.coalesce(F.array_max(F.filter(one["sums"], lambda x: x <= state["room"])), F.lit(0)).cast("double")
        return F.struct((state["room"] - fits).alias("room"), fits.alias("last"))

    # a class's words depend on the classes before it: at most 64 of them
    shares = F.transform(F.sequence(F.lit(1), F.size("classes")), lambda k: F.struct(
        F.element_at("classes", k)["class"].alias("class"), F.aggregate(F.slice("classes", F.lit(1), k), start, step)["last"].alias("most")))
    limits = sums.select("s", F.explode(shares).alias("l")).select("s", "l.class", "l.most")
    second = written(near.join(limits, ["s", "class"]).where("upto <= most").select("s", "key", "tie", "size"), "fill")
    held = second.groupBy("s").agg(F.sum("size").alias("held"))
    third = (free.join(second.select("s", "key", "tie"), ["s", "key", "tie"], "left_anti").join(held, "s", "left")
             .where(F.col("size") <= F.col("open") - F.coalesce("held", F.lit(0)))
             .groupBy("s").agg(F.min(F.struct("key", "tie")).alias("b")).select("s", "b.key", "b.tie"))
    return first.drop("size").unionByName(second.drop("size")).unionByName(third)


def _trades(rows: DataFrame, lacking: DataFrame, edge: int) -> DataFrame:
    """(s, key, tie, now): the documents that change sides at the threshold.
    Of the last ``edge`` documents selected and the first ``edge`` left out,
    at most one of each trade places: those that bring the words nearest to
    ``open`` of ``lacking``. ``edge`` bounds the search for a better fit, not
    the documents that are mixed."""
    near = Window.partitionBy("s", "more").orderBy(F.when(F.col("more") == 1, -F.col("key")).otherwise(F.col("key")), "tie")
    sides = rows.withColumn("k", F.row_number().over(near)).where(F.col("k") <= edge)
    one = F.struct(F.col("size").cast("double").alias("size"), "key", "tie")
    none = F.array(F.struct(F.lit(0.0).alias("size"), F.lit(None).cast("double").alias("key"), F.lit(None).cast("long").alias("tie")))
    lists = sides.groupBy("s").agg(F.sort_array(F.collect_list(F.when(F.col("more") == 0, one))).alias("ins"),
                                   F.sort_array(F.collect_list(F.when(F.col("more") == 1, one))).alias("outs")).join(lacking, "s")
    pairs = F.flatten(F.transform(F.concat(none, "ins"), lambda i: F.transform(F.concat(none, "outs"), lambda o: F.struct(
        F.abs(F.col("open") - i["size"] + o["size"]).alias("off"), i["size"].alias("in_size"), i["key"].alias("in_key"), i["tie"].alias("in_tie"), o["key"].alias("out_key"), o["tie"].alias("out_tie")))))
    best = lists.select("s", F.array_min(pairs).alias("b"))
    both = F.array(F.struct(F.col("b.in_key").alias("key"), F.col("b.in_tie").alias("tie"), F.lit(1).alias("now")),
                   F.struct(F.col("b.out_key").alias("key"), F.col("b.out_tie").alias("tie"), F.lit(0).alias("now")))
    return best.select("s", F.explode(both).alias("t")).select("s", "t.*").where("key is not null").distinct()


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        importance_col: str | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
        max_copies: int = MAX_COPIES, seed: int = SEED, edge: int = EDGE) -> DataFrame:
    """(doc_id, th, size, source_size, target, copies, taken): copies are the
    whole times that the document is taken."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), word_count(F.col(text_col).cast("string")).alias("size"),
        F.col(source_col).cast("string").alias("source"),
        *([] if importance_col is None else [F.greatest(F.coalesce(F.col(importance_col).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("importance")]))
    if importance_col is None:
        rows = rows.withColumn("importance", F.pow(F.greatest("size", F.lit(1)), F.lit(-TILT)))
    rows = written(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("importance")).alias("pull"))
    aims = written(targets(sizes.drop("pull"), weights, share, max_copies).alias("t").join(
        sizes.select(F.col("source").alias("o"), "pull"), F.col("source").eqNullSafe(F.col("o"))).drop("o"), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = (aims.withColumn("base", F.floor(ratio).cast("int"))
            .withColumn("left", F.col("target") - F.col("base") * F.col("source_size"))
            .withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    # random odds over inclusion odds, mapped to 0..1 by x / (1 + x)
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "th"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    pi = F.least(F.when(F.col("pull") > 0, F.col("left") * F.col("importance") / F.col("pull")).otherwise(F.lit(0.0)), F.lit(1 - 1e-12))
    odds = F.when(pi > 0, (u / (1 - u)) / (pi / (1 - pi)))
    state = (rows.withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
             .join(aims.select("s", "source_size", "target", "base", "left", "pull"), "s")
             .withColumn("key", F.coalesce(odds / (1 + odds), F.lit(1.0))).withColumn("tie", F.xxhash64(F.lit(seed + 1), "doc_id", "th")))
    state = written(_sample(state.select("s", "doc_id", "th", "size", "source_size", "target", "base", "key", "tie"),
                            aims.select("s", F.col("left").alias("words"))), "sample")
    asked = aims.select("s", F.col("left").alias("words"))
    filled = _fill(state.where(F.col("base") < max_copies), asked).withColumn("fill", F.lit(1))
    state = written(state.join(filled, ["s", "key", "tie"], "left").withColumn("more", F.coalesce("fill", "more")).drop("fill"), "filled")
    trades = _trades(state.where((F.col("size") > 0) & (F.col("base") < max_copies)), _open(state, asked), edge)
    state = state.join(trades, ["s", "key", "tie"], "left").withColumn("more", F.coalesce("now", "more"))
    copies = (F.col("base") + F.col("more")).cast("int")
    return state.select("doc_id", "th", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it. Rows
    without words are in no mix: they stay once."""
    plan = (mix(docs, id_col, text_col, source_col, **options).groupBy("doc_id", "th")
            .agg(F.max("copies").alias("__copies"), F.max("size").alias("__size"))
            .select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th"), "__copies", "__size"))
    th = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    both = docs.join(plan, docs[id_col].cast("long").eqNullSafe(F.col("__doc")) & (th == F.col("__th")))
    times = F.when(F.col("__size") == 0, F.lit(1)).otherwise(F.col("__copies"))
    return (both.where(times > 0).withColumn("__k", F.explode(F.sequence(F.lit(1), times)))
            .select(*[docs[c] for c in docs.columns]))
