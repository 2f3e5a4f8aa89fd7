"""Row-level joins that stay balanced when one key holds a large share of
the rows (a blank merchant, one busy account, one big upload).

When the lookup side is small (its row count is checked, not guessed) it is
broadcast: a map-only join, indifferent to skew, with no shuffle of the
rows. Otherwise a sort-merge join would send every row of a key to one
task. The callers here already aggregate the join keys (distinct pairs to
classify, merchants to count), so the per-key row counts come for free. Keys with more than
``hot_rows`` rows are few: at most ``total rows / hot_rows`` of them, and
the count is checked before that table is broadcast. A row of a hot key
gets a salt in ``[0, ceil(count / hot_rows))`` from a hash of its own
columns (deterministic, so a recomputed task salts the same way); the other
side repeats each hot key's rows once per salt value. The join then runs
on (key, salt) and no task takes more than about ``hot_rows`` rows of one
key. Cold keys keep salt 0, so their rows are not replicated.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one key that one join task should take at most.
HOT_ROWS = 2_000_000
# Largest lookup side (rows) that is broadcast whole; beyond it the join is
# a salted sort-merge join.
BROADCAST_ROWS = 1_000_000
# And its largest size in bytes of cell text.
BROADCAST_BYTES = 256 << 20
# Largest hot-key table that is broadcast (a guard, far above the bound
# total/HOT_ROWS of any realistic input).
MAX_HOT_KEYS = 200_000

SALT = "_salt"
BUCKETS = "_buckets"


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and bytes of its cells as text, by one aggregate."""
    cells = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in df.columns]
    n, size = df.agg(F.count(F.lit(1)), F.sum(reduce(lambda a, b: a + b, cells))).first()
    return n, size or 0


def small_enough(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` may be broadcast: both its rows and its bytes are counted."""
    n, size = measured(df)
    return n <= max_rows and size <= max_bytes


def hot_keys(counts: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS,
             count_col: str = "count") -> DataFrame:
    """Keys of ``counts`` with more than ``hot_rows`` rows and the number of
    salt buckets each needs."""
    return counts.filter(F.col(count_col) > hot_rows).select(
        *on, F.ceil(F.col(count_col) / F.lit(hot_rows)).cast("int").alias(BUCKETS))


def _null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[lc].eqNullSafe(right[rc]) for lc, rc in pairs])


def _with_buckets(df: DataFrame, hot: DataFrame, on: Sequence[str]) -> DataFrame:
    """``df`` plus the bucket count of its key (NULL for a cold key), by a
    broadcast of the checked-size hot-key table: no shuffle of ``df``."""
    h = hot.select(*[F.col(c).alias(f"_hot_{c}") for c in on], BUCKETS)
    joined = df.join(F.broadcast(h), _null_safe(df, h, [(c, f"_hot_{c}") for c in on]), "left")
    return joined.drop(*[f"_hot_{c}" for c in on])


def balanced_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str,
                  counts: DataFrame, salt_by: Sequence[str], hot_rows: int = HOT_ROWS,
                  broadcast_rows: int = BROADCAST_ROWS, max_hot_keys: int = MAX_HOT_KEYS,
                  count_col: str = "count") -> DataFrame:
    """``left`` joined with ``right`` on the null-safe equality of ``on``
    (``how`` in left, inner, left_semi, left_anti), never one task per key.

    ``right`` with at most ``broadcast_rows`` rows and ``BROADCAST_BYTES``
    bytes (counted here, so it should be materialised or cheap to read) is
    broadcast. Otherwise the
    hot keys of ``left`` are salted: ``counts`` holds the row count of every
    key of ``left`` (also counted here); ``salt_by`` are columns of ``left``
    that vary within a key (e.g. a transaction id). ``right``'s columns
    other than ``on`` must not clash with ``left``'s."""
    on = list(on)
    if small_enough(right, broadcast_rows):
        r = right.select(*[F.col(c).alias(f"_r_{c}") for c in on],
                         *[c for c in right.columns if c not in on])
        r_on = [f"_r_{c}" for c in on]
        out = left.join(F.broadcast(r), _null_safe(left, r, list(zip(on, r_on))), how)
        return out.drop(*r_on)
    return salted_join(left, right, on, how, counts, salt_by, hot_rows, max_hot_keys, count_col)


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str,
                counts: DataFrame, salt_by: Sequence[str], hot_rows: int = HOT_ROWS,
                max_hot_keys: int = MAX_HOT_KEYS, count_col: str = "count") -> DataFrame:
    """The sort-merge branch of ``balanced_join``: hot keys of ``left``
    (more than ``hot_rows`` rows in ``counts``) spread over several tasks."""
    on = list(on)
    hot = hot_keys(counts, on, hot_rows, count_col)
    n_hot = hot.count()
    while n_hot > max_hot_keys:   # at most rows / hot_rows keys are hot: fewer, each spread in larger parts
        hot_rows = max(1, 2 * hot_rows)
        hot = hot_keys(counts, on, hot_rows, count_col)
        n_hot = hot.count()
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in on],
                     *[c for c in right.columns if c not in on])
    r_on = [f"_r_{c}" for c in on]
    if n_hot == 0:
        out = left.join(r, _null_safe(left, r, list(zip(on, r_on))), how)
        return out.drop(*r_on)

    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_by]), F.col(BUCKETS)).cast("int")
    lk = (_with_buckets(left, hot, on)
          .withColumn(SALT, F.when(F.col(BUCKETS).isNull(), F.lit(0)).otherwise(salt))
          .drop(BUCKETS))
    rk = (_with_buckets(right.select(*on, *[c for c in right.columns if c not in on]), hot, on)
          .withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(BUCKETS), F.lit(1)) - 1)))
          .drop(BUCKETS))
    rk = rk.select(*[F.col(c).alias(f"_r_{c}") for c in on],
                   *[c for c in rk.columns if c not in on and c != SALT], F.col(SALT).alias("_r_salt"))
    cond = _null_safe(lk, rk, [*zip(on, r_on), (SALT, "_r_salt")])
    return lk.join(rk, cond, how).drop(*r_on, SALT, "_r_salt")
