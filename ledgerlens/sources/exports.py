"""Card-export ingestion (S1–S5, S10): records of all files from one folded
text scan (``sources/records.py``), cells named by each file's own header
(never by position), both dialects normalised to one schema."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.cleaning import display_merchant
from ledgerlens.functions.parsing import parse_amount, parse_date
from ledgerlens.operators.skew import small_enough
from ledgerlens.schema import (
    NORMALIZED_COLUMNS, PAYMENT_CATEGORY, STATUS_POSTED, TYPE_PAYMENT, TYPE_PURCHASE,
)
from ledgerlens.sources.records import read_records

# The header names that identify each dialect. B is tested
# first, so a file satisfying both is dialect B.
DIALECT_B = "capital_one"
DIALECT_A = "robinhood"
DIALECT_B_COLUMNS = ["Transaction Date", "Posted Date", "Debit"]
DIALECT_A_COLUMNS = ["Status", "Type", "Merchant"]
DIALECT_A_OPTIONAL = ["Cardholder", "Merchant", "Description", "Status", "Type", "Time"]

# S3: only .csv files, any letter case.
CSV_GLOB = "*.[cC][sS][vV]"


def detect_dialect(columns: Iterable[str]) -> str:
    """S2 for one known column set."""
    cols = set(columns)
    if set(DIALECT_B_COLUMNS) <= cols:
        return DIALECT_B
    if set(DIALECT_A_COLUMNS) <= cols:
        return DIALECT_A
    raise ValueError(f"no card export has these columns: {sorted(cols)}; dialect A needs {DIALECT_A_COLUMNS}, dialect B {DIALECT_B_COLUMNS}")


def _header_cells(line):
    cells = F.split(F.regexp_replace(line, "^\ufeff|\r$", ""), ",")
    return F.transform(cells, lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))


def _dialect_of(cells: Column) -> Column:
    """S2 as a column: the dialect of a header's cells, NULL if there is none."""
    has_all = lambda names: reduce(lambda a, b: a & b, [F.array_contains(cells, n) for n in names])
    return F.when(has_all(DIALECT_B_COLUMNS), F.lit(DIALECT_B)).when(has_all(DIALECT_A_COLUMNS), F.lit(DIALECT_A))


def sniff_dialects(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """S2, per file: (file_path, header, dialect or NULL when unknown).

    One text scan of the exports: the first line of a file is the first line
    of its first split (``file_block_start = 0``), in read order within that
    split. ``read_exports`` does not need it; it is for looking at a folder
    before loading it."""
    paths = [path] if isinstance(path, str) else list(path)
    lines = (
        spark.read.option("pathGlobFilter", CSV_GLOB).text(paths)
        .select("value", F.col("_metadata.file_path").alias("file_path"),
                F.col("_metadata.file_block_start").alias("_start"),
                F.monotonically_increasing_id().alias("_pos"))
        .filter(F.col("_start") == 0)
    )
    heads = lines.groupBy("file_path").agg(F.min_by("value", "_pos").alias("header"))
    return heads.select("file_path", "header", _dialect_of(_header_cells(F.col("header"))).alias("dialect"))


def csv_options(multiline: bool = True) -> dict[str, object]:
    """How exports are read, in batch and as a stream: quotes are doubled
    inside quoted cells, and every file's header is checked by name."""
    return {"header": True, "multiLine": multiline, "escape": '"', "enforceSchema": False, "mode": "PERMISSIVE"}


def row_id(file: Column, cells: Sequence[str]) -> Column:
    """Id of a row, the same in batch and stream and under any file packing:
    a hash of its file and raw cells, by the columns' names. Rows of a file
    that are equal in every cell share it (nothing tells them apart)."""
    return F.xxhash64(file, *[F.col(f"`{c}`") for c in sorted(cells)])


def _read_layout(spark: SparkSession, files: list[str], multiline: bool,
                 glob: str | None = None) -> DataFrame:
    reader = spark.read.options(**csv_options(multiline), inferSchema=False)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.csv(files)
    raw = raw.na.fill("")
    return raw.withColumn("_file", F.col("_metadata.file_path"))


def _common(df: DataFrame, dialect_tag: str, account_pattern: str | None) -> DataFrame:
    acct = (F.regexp_extract(F.col("_file"), account_pattern, 1) if account_pattern
            else F.lit(""))
    cells = [c for c in df.columns if c != "_file"]
    return (
        df.withColumn("txn_id", row_id(F.col("_file"), cells))
        .withColumn("account_id", acct)
        .withColumn("source_file", F.element_at(F.split(F.col("_file"), "/"), -1))
        .withColumn("dialect", F.lit(dialect_tag))
    )


def _columns_a() -> dict[str, Column]:
    """Dialect A; date and amount coerced (bad → NULL)."""
    return {"date": parse_date(F.col("Date")), "time": F.col("Time"), "amount": parse_amount(F.col("Amount")), "merchant": F.col("Merchant"),
            "description": F.col("Description"), "status": F.col("Status"), "type": F.col("Type")}


def _columns_b() -> dict[str, Column]:
    """Dialect B. Debit is the amount (blank/bad → 0); the
    merchant is derived from the description; every row is posted; a zero
    amount or a payment/credit source category marks a payment."""
    amount = parse_amount(F.col("Debit"), default=0)
    is_payment = (amount == 0) | (F.col("Category") == PAYMENT_CATEGORY)
    return {"date": parse_date(F.col("Transaction Date")), "time": F.lit(""), "amount": amount, "merchant": display_merchant(F.col("Description")),
            "description": F.col("Description"), "status": F.lit(STATUS_POSTED),
            "type": F.when(is_payment, F.lit(TYPE_PAYMENT)).otherwise(F.lit(TYPE_PURCHASE))}


ROW_COLUMNS = ("account_id", "txn_id", "source_file", "dialect")


def _normalized(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(*[c for c in ROW_COLUMNS if c in df.columns], *[e.alias(name) for name, e in columns.items()])


def normalize_a(df: DataFrame) -> DataFrame:
    """Dialect A. Missing optional columns become "" (see ``_columns_a``)."""
    return _normalized(df.withColumns({c: F.lit("") for c in DIALECT_A_OPTIONAL if c not in df.columns}), _columns_a())


def normalize_b(df: DataFrame) -> DataFrame:
    """Dialect B (see ``_columns_b``)."""
    return _normalized(df, _columns_b())


def normalize(df: DataFrame, dialect: str | None = None) -> DataFrame:
    dialect = dialect or detect_dialect(df.columns)
    return normalize_b(df) if dialect == DIALECT_B else normalize_a(df)


# Columns that a file of the dialect must have beyond those that identify it.
REQUIRED = {DIALECT_A: ["Date", "Amount", *DIALECT_A_COLUMNS], DIALECT_B: ["Description", "Category", *DIALECT_B_COLUMNS]}
CELLS = list(dict.fromkeys(["Date", "Amount", *DIALECT_A_OPTIONAL, *DIALECT_B_COLUMNS, "Category"]))


def read_exports(spark: SparkSession, path: str | Sequence[str], dialect: str | None = None,
                 account_pattern: str | None = None, multiline: bool = True,
                 single_layout: bool = False, unknown: str = "fail") -> DataFrame:
    """Every ``.csv`` under ``path`` as one normalised DataFrame.

    Files are read as lines, by as many tasks as their sizes ask for, and
    folded to records (a quoted cell may hold line breaks). Each record's
    cells are named by its own file's header, so column order and optional
    columns may differ between files, and one scan reads all of them. An
    unknown header raises, or with ``unknown="skip"`` its file is left out
    (``unknown_exports`` lists those). ``account_pattern`` (a regex with one
    group on the file path) fills ``account_id``; otherwise it is "".

    ``single_layout=True`` is Spark's own CSV scan, for files that all share
    one header: a file whose header differs fails the job rather than being
    read out of alignment, and a file with ``multiline`` is one task."""
    if single_layout:
        paths = [path] if isinstance(path, str) else list(path)
        raw = _read_layout(spark, paths, multiline, CSV_GLOB)
        found = dialect or detect_dialect(raw.columns)
        tag = "A" if found == DIALECT_A else "B"
        return normalize(_common(raw, tag, account_pattern), found).select(*NORMALIZED_COLUMNS)
    records, files = read_records(spark, path, CSV_GLOB, multiline)
    return by_header(records, header_table(files, dialect), account_pattern, unknown, f"{path!r}")


def header_table(files: DataFrame, dialect: str | None = None) -> DataFrame:
    """(file_path, names, kind, known) of files with their header lines: the
    dialect (the given one, if there is one), and whether the header has all
    columns that it needs."""
    names = _header_cells(F.col("header"))
    lacks = reduce(lambda a, b: a | b, [(F.col("kind") == kind) & (F.size(F.array_except(F.lit(cols), F.col("names"))) > 0) for kind, cols in REQUIRED.items()])
    return (files.select("file_path", names.alias("names")).withColumn("kind", F.lit(dialect) if dialect else _dialect_of(F.col("names")))
            .withColumn("known", F.col("kind").isNotNull() & ~lacks))


def by_header(records: DataFrame, headers: DataFrame, account_pattern: str | None, unknown: str, where: str) -> DataFrame:
    """Normalised rows of ``records`` (record, file_path) with the names and
    the dialect that ``headers`` (see ``header_table``) has for their files."""
    widest = headers.agg(F.max(F.size("names")), F.count(F.lit(1))).first()
    if not widest[1]:
        raise ValueError(f"no CSV export found under {where}")
    first = headers.where("not known").first()
    if first is not None:
        if unknown == "fail":
            detect_dialect(first["names"])
            raise ValueError(f"{first['file_path']} lacks columns of {first['kind']}: it has {first['names']}")
        headers = headers.where("known")
    headers = headers.drop("known")
    if small_enough(headers):
        headers = F.broadcast(headers)
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in csv_options().items() if k in ("multiLine", "escape", "mode")}
    parsed = F.from_csv("record", F.lit(", ".join(f"c{k} string" for k in range(widest[0]))), options)
    rows = records.join(headers, "file_path").withColumn("_row", parsed)
    cells = F.slice(F.array(*[F.coalesce(F.col(f"_row.c{k}"), F.lit("")) for k in range(widest[0])]), 1, F.size("names"))
    rows = rows.select("file_path", "names", "kind", cells.alias("cells"))

    def cell(name: str) -> Column:
        at = F.array_position("names", name).cast("int")
        return F.coalesce(F.when(at > 0, F.get("cells", at - 1)), F.lit("")).alias(name)

    by_name = F.transform(F.array_sort(F.arrays_zip("names", "cells")), lambda c: c["cells"])
    account = F.regexp_extract("file_path", account_pattern, 1) if account_pattern else F.lit("")
    raw = rows.select(F.xxhash64("file_path", by_name).alias("txn_id"), account.alias("account_id"), F.element_at(F.split("file_path", "/"), -1).alias("source_file"),
                      F.when(F.col("kind") == DIALECT_A, "A").otherwise("B").alias("dialect"), *[cell(c) for c in CELLS])
    a, b = _columns_a(), _columns_b()
    both = {name: F.when(F.col("dialect") == "B", b[name]).otherwise(a[name]) for name in a}
    return _normalized(raw, both).select(*NORMALIZED_COLUMNS)


def unknown_exports(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file_path, header) of the files whose header names no dialect."""
    return sniff_dialects(spark, path).where(F.col("dialect").isNull()).select("file_path", "header")
