"""Transaction-table exploration moved from the browser to the cluster:
category filter, search, sort, paging (P9–P11, O3, O4, O6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.schema import PAGE_SIZE

SORT_COLUMNS = ("date", "merchant", "amount", "category")


def filter_categories(df: DataFrame, categories: Sequence[str] | None) -> DataFrame:
    """Keep the chosen categories; an empty selection keeps everything."""
    if not categories:
        return df
    return df.filter(F.col("category").isin(list(categories)))


def search_predicate(query: str | None, regex: bool = False,
                     columns: Sequence[str] = ("merchant", "description")) -> Column | None:
    """Case-insensitive match of ``query`` in any of ``columns``.
    Literal substring by default (the browser table); ``regex=True`` treats
    the lowered query as a regular expression (the alternative UI)."""
    if not query:
        return None
    q = query.lower()
    hits = [
        (F.lower(F.col(c)).rlike(q) if regex else F.lower(F.col(c)).contains(F.lit(q)))
        for c in columns
    ]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return F.coalesce(out, F.lit(False))


def search(df: DataFrame, query: str | None, regex: bool = False) -> DataFrame:
    pred = search_predicate(query, regex)
    return df if pred is None else df.filter(pred)


def default_direction(column: str) -> str:
    """A newly chosen column starts ascending, amount descending."""
    return "desc" if column == "amount" else "asc"


def toggle_sort(current: str, direction: str, clicked: str) -> tuple[str, str]:
    """Clicking the current column flips it; another column starts at
    its default direction. (The initial state is date, descending.)"""
    if clicked == current:
        return current, ("desc" if direction == "asc" else "asc")
    return clicked, default_direction(clicked)


def sort_key(column: str = "date", direction: str = "desc", locale: bool = True) -> list[Column]:
    """O3: ordering by one of date/merchant/amount/category, then txn_id.
    Text is compared under the UNICODE collation (a, A, b, B), like the
    browser's localeCompare; ``locale=False`` gives binary order."""
    if column not in SORT_COLUMNS:
        raise ValueError(f"cannot sort by {column!r}; choose one of {SORT_COLUMNS}")
    c = F.col(column)
    if locale and column in ("merchant", "category"):
        c = F.collate(c, "UNICODE")
    primary = c.asc_nulls_first() if direction == "asc" else c.desc_nulls_last()
    return [primary, F.col("txn_id").asc()]


def sort_transactions(df: DataFrame, column: str = "date", direction: str | None = None,
                      locale: bool = True) -> DataFrame:
    direction = direction or ("desc" if column == "date" else default_direction(column))
    return df.orderBy(*sort_key(column, direction, locale))


def page(df: DataFrame, number: int = 1, column: str = "date", direction: str | None = None,
         size: int = PAGE_SIZE, locale: bool = True) -> DataFrame:
    """Page ``number`` (1-based) of ``size`` rows under the chosen sort.
    Plans as a top-(offset+size) per partition plus a merge, so shallow
    pages never sort the whole set; use ``page_after`` for deep pages."""
    if number < 1:
        raise ValueError("page numbers start at 1")
    return (
        sort_transactions(df, column, direction, locale)
        .offset((number - 1) * size)
        .limit(size)
    )


def page_after(df: DataFrame, last: dict, column: str = "date", direction: str = "desc",
               size: int = PAGE_SIZE, locale: bool = True, shown: int = 1) -> DataFrame:
    """Keyset page: the ``size`` rows after the row ``last`` (its sort value,
    which may be None, and txn_id). Cost is independent of how deep the page
    is. NULLs come first ascending and last descending, as in ``page``. Rows
    that repeat both keys of ``last`` go on where the page before stopped:
    ``shown`` is how many of them have been shown."""
    c, t = F.col(column), F.col("txn_id")
    v = F.lit(last[column]).cast(df.schema[column].dataType)
    if locale and column in ("merchant", "category"):
        c, v = F.collate(c, "UNICODE"), F.collate(v, "UNICODE")
    tied = c.eqNullSafe(v) & (t >= F.lit(last["txn_id"]))
    if last[column] is None:
        beyond = c.isNotNull() if direction == "asc" else F.lit(False)
    else:
        beyond = (c > v) if direction == "asc" else (c < v) | c.isNull()
    after = tied | F.coalesce(beyond, F.lit(False))
    return df.filter(after).orderBy(*sort_key(column, direction, locale)).offset(shown).limit(size)


def page_count(df: DataFrame, size: int = PAGE_SIZE, keys: Sequence[str] = ()) -> DataFrame:
    """Total pages = max(1, ceil(rows / size))."""
    keys = list(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).select(
        *keys, "rows",
        F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(size))).cast("bigint").alias("pages"))
