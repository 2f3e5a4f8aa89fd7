"""Categorisation.

Two classifier kinds:

* a rule set (U2): a chained ``CASE WHEN rlike`` column, first match by
  priority wins. It runs inside whole-stage codegen row by row, so the rule
  path needs no distinct, no shuffle and no join at all.
* a pluggable batch function (U3), e.g. a call to a hosted model. Calls
  cost money, so only distinct (merchant, parsed_description) pairs that
  the category cache does not hold are sent, 20 per call, from
  ``mapInPandas`` on the executors. Results are written to the shared
  checkpoint folder before they are reused, so a retried task or a second
  action never calls the function again for finished batches.
"""

from __future__ import annotations

import inspect
import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import journal as jn
from ledgerlens.operators.indexing import global_index
from ledgerlens.operators.skew import BROADCAST_ROWS, HOT_ROWS, balanced_join, small_enough
from ledgerlens.schema import CATEGORIES, REPLY_SCHEMA, UNCATEGORIZED
from ledgerlens.session import scratch_path

# ---------------------------------------------------------------------------
# U2 seed rules. Keywords are matched as whole words in
# lower(merchant || ' ' || parsed_description); the lowest priority that
# matches wins. Distilled from the written classification guidance.
# ---------------------------------------------------------------------------

SEED_RULES: list[tuple[int, str, list[str]]] = [
    (10, "Fees & Charges", ["annual fee", "late fee", "returned payment", "card fee"]),
    (20, "Dining & Drinks", ["uber eats", "eats", "doordash"]),
    (30, "Travel", ["hudson news", "duty free", "airline", "airlines", "airways", "hotel", "airbnb"]),
    (40, "Transport", ["uber", "lyft", "trip", "ride", "shell", "chevron", "exxon", "waymo",
                       "parking", "transit"]),
    (50, "Groceries & Essentials", ["cvs", "walgreens", "costco", "walmart", "grocery",
                                    "supermarket", "pharmacy", "liquor", "whole foods"]),
    (60, "Subscriptions & Services", ["spotify", "netflix", "chatgpt", "openai", "insurance",
                                      "lemonade", "membership"]),
    (70, "Entertainment", ["movie", "cinema", "theater", "museum", "concert", "park",
                           "sporting goods"]),
    (80, "Dining & Drinks", ["restaurant", "cafe", "coffee", "boba", "tea", "bar", "bakery",
                             "ice cream", "pizza", "burger", "starbucks"]),
    (90, "Shopping", ["amazon", "amzn", "target", "etsy", "clothing", "electronics",
                      "department store"]),
]

# Costco/Walmart count as groceries unless the text names electronics or
# furniture; this rule sits between Transport and Groceries.
SEED_PATTERN_RULES: list[tuple[int, str, str]] = [
    (45, "Shopping", r"\b(costco|walmart)\b.*\b(electronics|furniture)\b"),
]


@dataclass(frozen=True)
class Rule:
    priority: int
    category: str
    pattern: str          # Java / RE2-compatible regex on the lowered text


def keyword_pattern(words: Sequence[str]) -> str:
    return r"\b(" + "|".join(w.replace(" ", r"\s+") for w in words) + r")\b"


def seed_rules() -> list[Rule]:
    rules = [Rule(p, c, keyword_pattern(ws)) for p, c, ws in SEED_RULES]
    rules += [Rule(p, c, pat) for p, c, pat in SEED_PATTERN_RULES]
    return sorted(rules, key=lambda r: r.priority)


def rules_from_table(df: DataFrame) -> list[Rule]:
    """A user rule table (priority, pattern, category) becomes a column
    expression: rules are configuration, not data. Neighbours in priority
    order with one category become one rule (any of their patterns), so the
    expression grows with the changes of category, not with the rules."""
    rows = df.select("priority", "category", "pattern").collect()
    out: list[Rule] = []
    for r in sorted((Rule(int(r[0]), r[1], r[2]) for r in rows), key=lambda r: r.priority):
        if out and out[-1].category == r.category:
            out[-1] = Rule(out[-1].priority, r.category, f"{out[-1].pattern}|(?:{r.pattern})")
        else:
            out.append(Rule(r.priority, r.category, f"(?:{r.pattern})"))
    return out


def classify_text(merchant: Column | str = "merchant",
                  parsed_description: Column | str = "parsed_description") -> Column:
    m = F.col(merchant) if isinstance(merchant, str) else merchant
    d = F.col(parsed_description) if isinstance(parsed_description, str) else parsed_description
    return F.lower(F.concat_ws(" ", F.coalesce(m, F.lit("")), F.coalesce(d, F.lit(""))))


def rule_category(text: Column, rules: Sequence[Rule] | None = None) -> Column:
    """First matching rule (by priority) wins; no match → Uncategorized."""
    rules = sorted(rules if rules is not None else seed_rules(), key=lambda r: r.priority)
    expr = None
    for r in rules:
        cond = text.rlike(r.pattern)
        expr = F.when(cond, F.lit(r.category)) if expr is None else expr.when(cond, F.lit(r.category))
    return F.lit(UNCATEGORIZED) if expr is None else expr.otherwise(F.lit(UNCATEGORIZED))


def with_rule_category(df: DataFrame, rules: Sequence[Rule] | None = None, first: str | None = None) -> DataFrame:
    """``df`` with ``category`` by rules. The lowered text is a column of its
    own projection, so it is made once per row and not once per rule.
    ``first`` names a column whose value, if there is one, goes before."""
    ruled = rule_category(F.col("_rule_text"), rules)
    return (df.withColumn("_rule_text", classify_text())
            .withColumn("category", ruled if first is None else F.coalesce(F.col(first), ruled)).drop("_rule_text"))


WORD_BREAK = r"([^\w\s])"


def _words(text: Column) -> Column:
    """Words of a lowered text; a character that is neither of a word nor white
    space stands as a word of its own, so no phrase goes across it."""
    return F.filter(F.split(F.regexp_replace(text, WORD_BREAK, " $1 "), r"\s+"), lambda w: w != "")


def phrase_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(phrases, patterns) of a rule table (priority, pattern, category):
    patterns of words and blanks alone are phrases, the others stay regular
    expressions for ``rules_from_table``."""
    plain = F.col("pattern").rlike(r"^\w+( +\w+)*$")
    return rules.where(plain), rules.where(~plain | F.col("pattern").isNull())


def indexed_rule_category(pairs: DataFrame, phrases: DataFrame) -> DataFrame:
    """U2 for large rule tables: ``pairs`` with the category of the phrase of
    lowest priority that stands in merchant and description as whole words
    (ties: the lesser phrase), else ``Uncategorized``.

    Each pair gives the n-grams of its words, n up to the longest phrase, and an
    equi-join on their hashes finds the phrases, whose number does not matter:
    no rule is tried on a text that lacks its words. One row per phrase is left
    before the join, so a common word multiplies nothing."""
    rules = phrases.select(F.lower(F.regexp_replace("pattern", " +", " ")).alias("_phrase"), "priority", F.col("category").alias("_rule"))
    rules = rules.groupBy("_phrase").agg(F.min("priority").alias("_priority"), F.min_by("_rule", "priority").alias("_rule"))
    rules = rules.withColumn("_words", F.size(F.split("_phrase", " "))).withColumn("_key", F.xxhash64("_phrase")).checkpoint(eager=True)
    longest = rules.agg(F.max("_words")).first()[0]
    texts = pairs.select(*PAIR_KEYS).distinct().withColumn("_w", _words(classify_text()))
    if longest is None:
        return texts.select(*PAIR_KEYS, F.lit(UNCATEGORIZED).alias("category"))

    def runs(n: int) -> Column:
        """The runs of n neighbouring words (all words, if they are fewer)."""
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - (n - 1), F.lit(1))), lambda k: F.array_join(F.slice("_w", k, n), " "))

    grams = [runs(n) for n in range(1, longest + 1)]
    found = texts.select(*PAIR_KEYS, F.explode(F.array_distinct(F.flatten(F.array(*grams)))).alias("_gram")).withColumn("_key", F.xxhash64("_gram"))
    side = F.broadcast(rules) if small_enough(rules) else rules
    best = (found.join(side, (found["_key"] == side["_key"]) & (found["_gram"] == side["_phrase"]))
            .groupBy(*PAIR_KEYS).agg(F.min_by("_rule", F.struct("_priority", "_phrase")).alias("category")))
    b = best.select(*[F.col(c).alias("_" + c) for c in PAIR_KEYS], "category")
    cond = reduce(lambda x, y: x & y, [texts[c].eqNullSafe(b["_" + c]) for c in PAIR_KEYS])
    return texts.join(b, cond, "left").select(*PAIR_KEYS, F.coalesce("category", F.lit(UNCATEGORIZED)).alias("category"))


def rule_category_sql(text_sql: str, rules: Sequence[Rule] | None = None) -> str:
    """The same rules as a DuckDB CASE (oracle side)."""
    rules = sorted(rules if rules is not None else seed_rules(), key=lambda r: r.priority)
    arms = " ".join(
        f"WHEN regexp_matches({text_sql}, '{r.pattern}') THEN '{r.category}'" for r in rules)
    return f"(CASE {arms} ELSE '{UNCATEGORIZED}' END)"


def taxonomy(spark: SparkSession) -> DataFrame:
    """The eight categories with their display order."""
    return spark.createDataFrame(
        [(c, i + 1) for i, c in enumerate(CATEGORIES)], "category string, ordinal int")


# ---------------------------------------------------------------------------
# Pair-level building blocks
# ---------------------------------------------------------------------------

PAIR_KEYS = ["merchant", "parsed_description"]


def distinct_pairs(df: DataFrame) -> DataFrame:
    """The distinct pairs to classify (partial aggregation per task)."""
    return df.select(*PAIR_KEYS).distinct()


def cache_split(pairs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs the cache holds, pairs it does not)."""
    labelled = cache_labels(pairs, cache)
    return (labelled.filter(F.col("_hit")).select(*PAIR_KEYS),
            labelled.filter(~F.col("_hit")).select(*PAIR_KEYS))


def cache_labels(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """J2 in one join: every pair with ``_hit`` (the cache holds it) and the
    cached ``category``. Pairs are unique on both sides, so the join cannot
    skew or multiply rows; its size is the data's pairs, not the cache's."""
    c = cache.select(F.col("merchant").alias("_cm"), F.col("parsed_description").alias("_cd"),
                     F.col("category").alias("_cc"), F.lit(True).alias("_hit"))
    cond = pairs["merchant"].eqNullSafe(c["_cm"]) & pairs["parsed_description"].eqNullSafe(c["_cd"])
    return pairs.join(c, cond, "left").select(
        *PAIR_KEYS, F.col("_cc").alias("category"), F.coalesce(F.col("_hit"), F.lit(False)).alias("_hit"))


def attach_categories(df: DataFrame, mapping: DataFrame, counts: DataFrame | None = None,
                      hot_rows: int = HOT_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every row gets its pair's category; a miss → Uncategorized.

    Given ``counts`` (rows per pair, materialised): a mapping of at most
    ``broadcast_rows`` rows is broadcast (no shuffle of the rows), a larger
    one is a sort-merge join with the pairs of more than ``hot_rows`` rows
    salted over several tasks (``skew.balanced_join``). Without counts it is
    a plain null-safe equi-join left to AQE (broadcast when the mapping
    measures small, skew-join split otherwise)."""
    base = df.drop("category") if "category" in df.columns else df
    m = mapping.select(*PAIR_KEYS, F.col("category").alias("_cat"))
    if counts is not None:
        salt_by = ["txn_id"] if "txn_id" in base.columns else base.columns
        joined = balanced_join(base, m, PAIR_KEYS, "left", counts, salt_by, hot_rows, broadcast_rows)
    else:
        m = m.select(F.col("merchant").alias("_m"), F.col("parsed_description").alias("_d"), "_cat")
        cond = base["merchant"].eqNullSafe(m["_m"]) & base["parsed_description"].eqNullSafe(m["_d"])
        joined = base.join(m, cond, "left").drop("_m", "_d")
    return joined.withColumn("category", F.coalesce(F.col("_cat"), F.lit(UNCATEGORIZED))).drop("_cat")


def coverage(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct pairs categorised (not Uncategorized) over all pairs."""
    keys = list(keys)
    pairs = df.groupBy(*keys, *PAIR_KEYS).agg(F.max(F.col("category") != UNCATEGORIZED).alias("_done"))
    return pairs.groupBy(*keys).agg(
        F.count_if(F.col("_done")).alias("done"),
        F.count(F.lit(1)).alias("total"),
    )


def observe_coverage(df: DataFrame, name: str = "coverage"):
    """U7, live: attach row-level counters (rows, rows categorised) that are
    reported when an action on the returned frame finishes. Returns
    (frame, Observation); read ``observation.get`` after the action."""
    from pyspark.sql import Observation
    obs = Observation(name)
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"),
                          F.count_if(F.col("category") != UNCATEGORIZED).alias("categorised"))
    return observed, obs


def taxonomy_audit(df: DataFrame) -> DataFrame:
    """U8: labels outside the eight categories (and not Uncategorized), with
    their row counts. Reported, not rewritten."""
    allowed = df.sparkSession.createDataFrame(
        [(c,) for c in [*CATEGORIES, UNCATEGORIZED]], "category string")
    return (
        df.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
        .join(F.broadcast(allowed), "category", "left_anti")
    )


# ---------------------------------------------------------------------------
# Batches and request text
# ---------------------------------------------------------------------------

# One request line per pair, and the line before them.
REQUEST_HEADER = "Classify these transactions:"
# Reply budget of a request, max(256, 40 × pairs) tokens.
REPLY_BUDGET_MIN = 256
REPLY_BUDGET_PER_ITEM = 40


def assign_batches(pairs: DataFrame, batch_size: int = 20) -> DataFrame:
    """Number the pairs in (merchant, parsed_description) order and cut
    them into batches of ``batch_size``: columns batch_id, position (1-based)."""
    ranked = global_index(pairs, PAIR_KEYS, "_rank")
    return ranked.select(
        *PAIR_KEYS,
        F.floor((F.col("_rank") - 1) / batch_size).cast("bigint").alias("batch_id"),
        (((F.col("_rank") - 1) % batch_size) + 1).cast("bigint").alias("position"),
    )


def request_line(position: Column, merchant: Column, description: Column) -> Column:
    return F.concat(position.cast("string"), F.lit('. Merchant: "'), F.coalesce(merchant, F.lit("")),
                    F.lit('"  Description: "'), F.coalesce(description, F.lit("")), F.lit('"'))


def _prompt_agg() -> Column:
    lines = F.array_sort(F.collect_list(F.struct(
        F.col("position"), request_line(F.col("position"), F.col("merchant"),
                                        F.col("parsed_description")).alias("line"))))
    return F.concat_ws("\n", F.lit(REQUEST_HEADER),
                       F.concat_ws("\n", F.transform(lines, lambda s: s.getField("line"))))


def _items_agg() -> Column:
    return F.to_json(F.array_sort(F.collect_list(F.struct(
        "position", F.col("merchant"), F.col("parsed_description").alias("description")))))


def build_prompts(batched: DataFrame, with_items: bool = False) -> DataFrame:
    """One request text per batch, lines numbered in batch order,
    with its reply budget (``max_tokens``). ``collect_list`` holds at most
    ``batch_size`` lines: bounded. With ``with_items`` the same aggregation
    also returns the batch's pairs as JSON (what the classifier call
    needs), so there is one shuffle and no join."""
    aggs = [F.count(F.lit(1)).alias("items"), _prompt_agg().alias("prompt")]
    if with_items:
        aggs.append(_items_agg().alias("items_json"))
    out = batched.groupBy("batch_id").agg(*aggs)
    budget = F.greatest(F.lit(REPLY_BUDGET_MIN), F.col("items") * REPLY_BUDGET_PER_ITEM)
    return out.withColumn("max_tokens", budget.cast("bigint"))


# ---------------------------------------------------------------------------
# Calling a user function from the executors
# ---------------------------------------------------------------------------

ClassifierFn = Callable[..., object]


class PermanentClassifierError(RuntimeError):
    """Raised by a classifier function for an error that no retry mends (a
    rejected key, an exhausted account): it stops the run instead of turning
    the batch into Uncategorized. ``call_classifier`` with a journal and
    ``categorize`` raise it themselves, after the finished batches are saved."""


def _is_permanent(failed: Exception) -> bool:
    """By name: a function shipped with this package by value and one that
    imports it on the executor have classes of their own."""
    return any(c.__name__ == PermanentClassifierError.__name__ for c in type(failed).__mro__)


def _call_with_retry(fn: ClassifierFn, prompt: str, items: list[dict], max_tokens: int,
                     retries: int, pause: float) -> str | None:
    args = (prompt, items, max_tokens)[:max(1, min(3, len(inspect.signature(fn).parameters)))]
    for attempt in range(retries + 1):
        try:
            reply = fn(*args)
            if reply is None:
                return None
            return reply if isinstance(reply, str) else json.dumps(reply)
        except Exception as failed:  # noqa: BLE001 - any failure of the plug but a permanent one → retry, then give up
            if _is_permanent(failed):
                raise
            if attempt < retries:
                time.sleep(pause * (attempt + 1))
    return None


def _pickle_package_by_value() -> None:
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])


def call_classifier(batched: DataFrame, fn: ClassifierFn, retries: int = 1, pause: float = 1.0,
                    tasks: int | None = None, threads: int = 1, journal: str | None = None,
                    journal_every: int = 16) -> DataFrame:
    """One call of ``fn`` per batch, from ``mapInPandas`` on the
    executors; a batch that still fails after ``retries`` gets reply NULL.
    ``fn(prompt)``, ``fn(prompt, items)`` or ``fn(prompt, items,
    max_tokens)`` returns the reply JSON text (or an object that serialises
    to it). It must be idempotent: a retried task calls it again.

    The request table is tiny next to the time a call takes, so AQE would
    coalesce it into one partition and make every call wait for the one
    before. It is dealt by batch number into at least ``tasks`` partitions
    (default: the cluster's default parallelism) of at most ``journal_every``
    batches, and each task keeps up to ``threads`` calls in flight. Every
    finished batch goes to the journal (see ``operators/journal.py``; a folder
    of its own under the checkpoint root if none is named), batches that the
    journal answers already are not called, and a ``PermanentClassifierError``
    is raised here, when the journal is written."""
    spark = batched.sparkSession
    journal = journal or scratch_path(spark, "reply-journal")
    work = build_prompts(batched, with_items=True).withColumn("key", F.sha2(F.concat_ws("\n", "prompt", "items_json"), 256))
    work = work.checkpoint(eager=True)  # its batches, their keys and the reply join below must be the same
    known = jn.entries(spark, journal).where(F.col("status") == jn.ANSWERED)
    todo = work.join(known.select("key"), "key", "left_anti")
    this = uuid.uuid4().hex
    n_tasks = max(tasks or spark.sparkContext.defaultParallelism, -(-work.count() // journal_every))
    # Ship this package's code with the closure, so executors whose Python
    # path lacks ledgerlens can still run it (a user's own ``fn`` module is
    # the user's to ship, e.g. with --py-files).
    _pickle_package_by_value()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        stopped: list[str] = []

        def one(prompt: str, items_json: str, budget: int) -> tuple[str, str | None]:
            if stopped:
                return jn.LEFT_OUT, None
            its = [{"merchant": i.get("merchant"), "description": i.get("description")} for i in json.loads(items_json)]
            try:
                reply = _call_with_retry(fn, prompt, its, int(budget), retries, pause)
            except Exception as rejected:  # noqa: BLE001 - only a permanent one gets here
                stopped.append(str(rejected))
                return jn.PERMANENT, str(rejected)
            return (jn.FAILED, None) if reply is None else (jn.ANSWERED, reply)

        with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
            for pdf in batches:
                said = list(pool.map(one, pdf["prompt"], pdf["items_json"], pdf["max_tokens"]))
                yield pd.DataFrame({"key": pdf["key"], "batch_id": pdf["batch_id"], "items_json": pdf["items_json"], "run": this,
                                    "status": [s for s, _ in said], "reply": [r for _, r in said]})

    dealt = todo.repartitionById(n_tasks, F.pmod("batch_id", F.lit(n_tasks)).cast("int"))
    jn.append(dealt.select("key", "batch_id", "items_json", "prompt", "max_tokens").mapInPandas(run, jn.JOURNAL_SCHEMA), journal)
    told = jn.entries(spark, journal)
    stop = told.where((F.col("status") == jn.PERMANENT) & (F.col("run") == this)).select("reply").first()
    if stop is not None:
        raise PermanentClassifierError(stop["reply"])
    answers = told.where(F.col("status") == jn.ANSWERED).select("key", "reply")
    # the journal may be cleared later: its answers are kept with the run
    return work.select("key", "batch_id").join(answers, "key", "left").select("batch_id", "reply").checkpoint(eager=True)


# Fixed value: where a chat-completion response body keeps the reply text.
ENVELOPE_CONTENT_PATH = "$.choices[0].message.content"


def unwrap_envelope(replies: DataFrame, column: str = "reply") -> DataFrame:
    """replace a chat-completion response body by the reply text it
    carries (NULL when the body is not such an envelope)."""
    return replies.withColumn(column, F.get_json_object(F.col(column), ENVELOPE_CONTENT_PATH))


def failed_batches(replies: DataFrame) -> DataFrame:
    """Number of batches without a reply."""
    return replies.agg(F.count(F.when(F.col("reply").isNull(), 1)).alias("failed_batches"), F.count(F.lit(1)).alias("batches"))


def parse_replies(replies: DataFrame, batched: DataFrame) -> DataFrame:
    """Parse each reply, match the echoed merchant+description
    back to the batch's pairs. Malformed reply → every pair of the batch
    Uncategorized; an echo that names no pair of its batch is ignored, so
    that pair stays Uncategorized. A missing merchant or description is "",
    on both sides; of several echoes of a pair the last one counts. Labels
    outside the taxonomy pass through (see taxonomy_audit)."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    parsed = replies.select("batch_id", F.from_json("reply", REPLY_SCHEMA).alias("r"))
    echoes = parsed.select("batch_id", F.posexplode_outer("r.results").alias("_pos", "e")).select(
        F.col("batch_id").alias("_b"), "_pos",
        blank(F.col("e.merchant")).alias("_m"),
        blank(F.col("e.description")).alias("_d"),
        F.col("e.category").alias("_cat"),
    ).filter(F.col("_cat").isNotNull())
    echoes = echoes.groupBy("_b", "_m", "_d").agg(F.max_by("_cat", "_pos").alias("_cat"))
    cond = ((batched["batch_id"] == echoes["_b"])
            & (blank(batched["merchant"]) == echoes["_m"])
            & (blank(batched["parsed_description"]) == echoes["_d"]))
    joined = batched.join(echoes, cond, "left")
    return joined.select(
        batched["batch_id"], "position", *PAIR_KEYS,
        F.coalesce(F.col("_cat"), F.lit(UNCATEGORIZED)).alias("category"),
        F.col("_cat").isNotNull().alias("answered"),
    )


# ---------------------------------------------------------------------------
# The whole categorisation
# ---------------------------------------------------------------------------

@dataclass
class BatchClassifier:
    """U3 plug: ``fn`` called with 20 pairs at a time, retried once;
    ``tasks`` × ``threads`` calls in flight, ``journal_every`` batches per
    task (see ``call_classifier``)."""
    fn: ClassifierFn
    batch_size: int = 20
    retries: int = 1
    pause: float = 1.0
    tasks: int | None = None
    threads: int = 1
    journal_every: int = 16


def categorize(df: DataFrame, classifier: Sequence[Rule] | BatchClassifier | None = None,
               cache: DataFrame | None = None, cache_root: str | None = None,
               cache_failures: bool = False, hot_rows: int = HOT_ROWS,
               broadcast_rows: int = BROADCAST_ROWS, journal: str | None = None,
               report: dict[str, int] | None = None) -> DataFrame:
    """Add ``category`` to every row (row count unchanged).

    Rules and no cache: one column expression, no shuffle.
    Rules and a cache to read that is small enough to broadcast: one
    map-only join, the rule column where the cache has no label; the rows
    are read once.
    Otherwise: distinct pairs with their row counts (written once to the
    checkpoint folder) → one left join with the cache labels them (hit with
    its cached label, or miss) → classify the misses →
    (optionally) upsert the new pairs into the versioned cache at
    ``cache_root`` → join back: a broadcast of a mapping of at most
    ``broadcast_rows`` pairs, else a sort-merge join salting the pairs of
    more than ``hot_rows`` rows. Failed batches are not cached unless
    ``cache_failures``.

    A batch classifier's replies go to ``journal`` (default: next to the
    cache at ``cache_root``) as they come. If a run fails, for whatever
    reason, the next one with the same journal takes its answers over and
    asks for the other pairs only; a run that has saved its pairs at
    ``cache_root`` clears the journal. ``report``, if given, is filled with
    the number of batches, of those without an answer, and of pairs taken over
    from the journal."""
    from ledgerlens.session import checkpoint_root
    from ledgerlens.sources.cache import upsert_cache

    if not isinstance(classifier, BatchClassifier):
        if cache is None:
            return with_rule_category(df, classifier)
        if cache_root is None and small_enough(cache, broadcast_rows):
            base = df.drop("category")
            c = F.broadcast(cache.select(F.col("merchant").alias("_m"), F.col("parsed_description").alias("_d"), F.col("category").alias("_cat")))
            cond = base["merchant"].eqNullSafe(c["_m"]) & base["parsed_description"].eqNullSafe(c["_d"])
            return with_rule_category(base.join(c, cond, "left"), classifier, first="_cat").drop("_m", "_d", "_cat")

    checkpoint_root(df.sparkSession)
    counts = df.groupBy(*PAIR_KEYS).agg(F.count(F.lit(1)).alias("count")).checkpoint(eager=True)
    pairs = counts.select(*PAIR_KEYS)
    hits = None
    if cache is not None:
        # One pair-level join, written once: hits keep their cached label,
        # misses go to the classifier.
        labelled = cache_labels(pairs, cache).checkpoint(eager=True)
        hits = labelled.filter(F.col("_hit")).select(*PAIR_KEYS, "category")
        misses = labelled.filter(~F.col("_hit")).select(*PAIR_KEYS)
    else:
        misses = pairs

    if isinstance(classifier, BatchClassifier):
        if journal is None and cache_root is not None:
            journal = f"{cache_root.rstrip('/')}/journal"
        taken = None
        if journal is not None:
            taken = parse_replies(*jn.answered_batches(df.sparkSession, journal)).checkpoint(eager=True)
            t = taken.select(*[F.col(c).alias("_" + c) for c in [*PAIR_KEYS, "category", "answered"]])
            cond = reduce(lambda a, b: a & b, [misses[c].eqNullSafe(t["_" + c]) for c in PAIR_KEYS])
            asked, taken = misses.join(t, cond, "left_anti"), t.join(misses, cond).select(*PAIR_KEYS, F.col("_category").alias("category"), F.col("_answered").alias("answered"))
        else:
            asked = misses
        batched = assign_batches(asked, classifier.batch_size)
        replies = call_classifier(batched, classifier.fn, classifier.retries, classifier.pause, classifier.tasks,
                                  classifier.threads, journal, classifier.journal_every)
        if report is not None:
            report.update(failed_batches(replies).first().asDict(), resumed_pairs=0 if taken is None else taken.count())
        fresh = parse_replies(replies, batched)
        if taken is not None:
            fresh = fresh.select(*PAIR_KEYS, "category", "answered").unionByName(taken.select(*PAIR_KEYS, "category", "answered"))
        keep = F.lit(True) if cache_failures else F.col("answered")
        new_pairs = fresh.filter(keep).select(*PAIR_KEYS, "category")
    else:
        new_pairs = with_rule_category(misses, classifier)
    # Write once before the two uses below (cache upsert, attach).
    new_pairs = new_pairs.checkpoint(eager=True)

    # Labels for the pairs of this data only: bounded by its distinct pairs,
    # however large the cache has grown.
    mapping = new_pairs if hits is None else hits.unionByName(new_pairs)
    if cache_root is not None:
        upsert_cache(df.sparkSession, cache_root, new_pairs)
        if isinstance(classifier, BatchClassifier):
            jn.clear(df.sparkSession, journal)
    return attach_categories(df, mapping, counts, hot_rows, broadcast_rows)


def categorize_one(spark: SparkSession, merchant: str, description: str,
                   classifier: Sequence[Rule] | BatchClassifier | None = None,
                   cache: DataFrame | None = None, cache_root: str | None = None) -> DataFrame:
    """One pair, same path as ``categorize``; with ``cache_root`` its
    answer is saved there."""
    one = spark.createDataFrame([(merchant, description, 1)], "merchant string, parsed_description string, txn_id long")
    if cache is None and cache_root is not None:
        from ledgerlens.sources.cache import load_cache

        cache = load_cache(spark, cache_root)
    return categorize(one, classifier, cache, cache_root=cache_root).drop("txn_id")


def rule_replies(batched: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """A JVM-side stand-in for a model: the reply JSON each batch would get
    from the rule set. Used to exercise U5/J5 on data Spark derives."""
    per_item = F.struct(
        F.col("merchant"), F.col("parsed_description").alias("description"),
        rule_category(classify_text(), rules).alias("category"))
    return batched.groupBy("batch_id").agg(
        F.to_json(F.struct(F.transform(
            F.array_sort(F.collect_list(F.struct("position", per_item.alias("item")))),
            lambda s: s.getField("item")).alias("results"))).alias("reply"))

