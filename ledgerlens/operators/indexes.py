"""Stored indexes for exploring many transactions: an order index for pages of
any depth (O3, O6) and a trigram index for substring search (P10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.operators.explore import search_predicate, sort_key
from ledgerlens.operators.skew import small_enough
from ledgerlens.schema import PAGE_SIZE

# ---------------------------------------------------------------------------
# Sorted range files with a prefix table of counts
# ---------------------------------------------------------------------------


def build_order_index(df: DataFrame, root: str, column: str = "date", direction: str = "desc",
                      locale: bool = True, parts: int | None = None) -> None:
    """Write ``df`` in the order of ``sort_transactions`` as ``parts`` range
    files (default: the session's shuffle partitions) and a table of how many
    rows lie before each. One shuffle; every page is then read from the files
    that hold it."""
    spark, root = df.sparkSession, root.rstrip("/")
    order = sort_key(column, direction, locale)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    placed.write.partitionBy("_part").parquet(f"{root}/rows")
    df.limit(0).write.parquet(f"{root}/columns")  # what a page behind the last one has
    sizes = spark.read.schema(placed.schema).parquet(f"{root}/rows").groupBy("_part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    sizes.select("_part", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before")).coalesce(1).write.parquet(f"{root}/prefix")


def indexed_page(spark: SparkSession, root: str, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``number`` of an order index. The prefix table names the files
    that hold the page; of those, only the rows of the page are read."""
    if number < 1:
        raise ValueError("page numbers start at 1")
    root = root.rstrip("/")
    first, end = (number - 1) * size, number * size
    prefix = spark.read.parquet(f"{root}/prefix")
    held = prefix.where((F.col("before") < end) & (F.col("before") + F.col("rows") > first)).orderBy("_part").collect()  # at most ``size`` files
    if not held:
        return spark.read.parquet(f"{root}/columns")
    rows = spark.read.option("basePath", f"{root}/rows").parquet(*[f"{root}/rows/_part={h['_part']}" for h in held])
    wanted = F.lit(False)
    for h in held:
        wanted = wanted | ((F.col("_part") == h["_part"]) & (F.col("_at") >= max(0, first - h["before"])) & (F.col("_at") < end - h["before"]))
    return rows.where(wanted).orderBy("_part", "_at").drop("_part", "_at")


def indexed_page_count(spark: SparkSession, root: str, size: int = PAGE_SIZE) -> int:
    """Total pages, from the prefix table."""
    rows = spark.read.parquet(f"{root.rstrip('/')}/prefix").agg(F.sum("rows")).first()[0] or 0
    return max(1, -(-rows // size))


# ---------------------------------------------------------------------------
# P10: trigram postings over the distinct texts
# ---------------------------------------------------------------------------

TEXTS = ("merchant", "description")


def _grams(text: str):
    """The distinct trigrams of a text column."""
    c = F.col(text)
    count = F.length(c) - 2
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.substr(c, k, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def build_search_index(df: DataFrame, root: str) -> None:
    """Write the rows with the ids of their texts, the distinct lower-cased
    texts of merchant and description, and the postings (trigram, text id)
    sorted by trigram, so that a search reads the row groups of its trigrams."""
    spark, root = df.sparkSession, root.rstrip("/")
    low = [F.lower(F.col(c)) for c in TEXTS]
    df.withColumns({f"_{c}": F.xxhash64(t) for c, t in zip(TEXTS, low)}).write.parquet(f"{root}/rows")
    texts = df.select(F.explode(F.array(*low)).alias("text")).where("text is not null").distinct()
    texts.select(F.xxhash64("text").alias("id"), "text").write.parquet(f"{root}/texts")
    postings = spark.read.parquet(f"{root}/texts").select("id", F.explode(_grams("text")).alias("gram"))
    postings.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{root}/postings")


def matching_texts(spark: SparkSession, root: str, query: str) -> tuple[DataFrame, DataFrame]:
    """(candidates (id, text), matches (id, text)): texts that have all
    trigrams of the query, and those of them that contain it. A query of fewer
    than three characters has no trigram: all distinct texts are candidates."""
    root, low = root.rstrip("/"), query.lower()
    texts = spark.read.parquet(f"{root}/texts")
    grams = sorted({low[k:k + 3] for k in range(len(low) - 2)})
    if grams:
        hits = (spark.read.parquet(f"{root}/postings").where(F.col("gram").isin(grams)).groupBy("id")
                .agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("id"))
        texts = texts.join(hits, "id", "left_semi")
    return texts, texts.where(F.col("text").contains(F.lit(low)))


def indexed_search(spark: SparkSession, root: str, query: str | None) -> DataFrame:
    """P10 through the index: the rows whose merchant or description contains
    the query, ignoring case. Texts are compared, not rows; the rows of matching
    texts are found by id, and looked at again (two texts may share an id)."""
    root = root.rstrip("/")
    rows = spark.read.parquet(f"{root}/rows")
    ids = [f"_{c}" for c in TEXTS]
    if not query:
        return rows.drop(*ids)
    _, found = matching_texts(spark, root, query)
    found = found.select("id").checkpoint(eager=True)
    side = F.broadcast(found) if small_enough(found) else found
    for c in ids:
        rows = rows.join(side.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_hit")), c, "left")
    kept = rows.where(" or ".join(f"{c}_hit" for c in ids)).where(search_predicate(query))
    return kept.drop(*ids, *[f"{c}_hit" for c in ids])
