"""A dashboard that is kept up while uploads come and go.

A store under ``<root>`` holds, per upload, its rows, its rollup and each key's
largest purchase, and merged rollups that together stand for all uploads. A
rollup has exact sums and counts on three grains, made in one pass (grouping
sets):

* (keys, category, month)   totals, shares, metrics, monthly series
* (keys, date)              weekdays
* (keys, merchant, amount)  a multiset of amounts: counts, exact sums of squares
  and distinct amounts per merchant, so recurring charges can be taken back

All of it is sums, so an upload's rollup is a part with a sign: it is added
with one and taken out with the other, and grains that come to zero vanish.
Neither reads rows. Parts are merged by levels: ``FOLD`` parts of a level become
one of the next, so a grain is written anew once a level and not at every
change, and a store has a few parts a level. Once the parts stand for more than
twice the uploads that are there, all become one. The summaries of the
dashboard add up the parts of their grain; at most twice as many as there are
uploads and ``2 * FOLD`` more go into them, and their sum is bounded by keys ×
(categories × months + days + distinct merchant amounts). A maximum cannot be
taken back; the largest purchase is therefore kept per upload (a row per key)
and looked up among those that are there.

Parts are merged in tasks of about ``TASK_GRAINS`` grains, whatever their size
in files: a part holds a grain once, so adding up before the shuffle finds
nothing to add and fills the memory of the task. An upload's rows are dealt
likewise before they are rolled up: each stands for a grain of every kind, and
what a split of a file holds would grow with the upload.

``log/<n>.json`` names the uploads that are there and the parts. It is created
only if it is not there, so of two writers one does its change again on top
of the other's. A writer that dies leaves folders that no state names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import aggregates as agg
from ledgerlens.operators import insights as ins
from ledgerlens.operators.ordering import newest_first_key
from ledgerlens.operators.prepare import month_key
from ledgerlens.sources.files import create_new, listing, read_text
from ledgerlens.sources.sinks import to_records

GRAINS = {"category": ["category", "month"], "day": ["date"], "amount": ["merchant", "amount"]}
SUM = "decimal(38,2)"
#: Parts of a level that are merged into one of the next.
FOLD = 4
#: Grains that one task adds up.
TASK_GRAINS = 250_000


def rollup(df: DataFrame, keys: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """(grain, keys, category, month, date, merchant, amount, _sum, _n): the
    three grains of ``df`` from one pass, its rows dealt to so many ``tasks`` if
    need be; columns of other grains are null."""
    keys = list(keys)
    columns = [c for own in GRAINS.values() for c in own]
    own_columns = [*keys, "category", "date", "merchant", "amount"]
    dealt = df.select(*own_columns) if tasks is None else df.select(*own_columns).repartition(tasks, *own_columns)
    rows = dealt.withColumns({"month": month_key("date"), "_value": F.col("amount")})
    places = {c: F.grouping(c) for c in columns}
    sets = [[F.col(c) for c in [*keys, *own]] for own in GRAINS.values()]
    grouped = rows.groupingSets(sets, *[F.col(c) for c in [*keys, *columns]]).agg(
        F.sum("_value").cast(SUM).alias("_sum"), F.count(F.lit(1)).alias("_n"), *[places[own[0]].alias(f"_off_{g}") for g, own in GRAINS.items()])
    grain = F.when(F.col("_off_category") == 0, "category").when(F.col("_off_day") == 0, "day").otherwise("amount")
    return grouped.select(grain.alias("grain"), *keys, *columns, "_sum", "_n")


def merged(parts: DataFrame, keys: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """Rollups added up, if need be in so many ``tasks``; ``_n`` (and ``_sum``)
    of a part to take out are negative. Where only some parts are added up, as
    many rows may come as go and leave another sum."""
    columns = ["grain", *keys, *[c for own in GRAINS.values() for c in own]]
    return _summed(parts if tasks is None else parts.repartition(tasks, *columns), columns)


def _summed(parts: DataFrame, columns: Sequence[str]) -> DataFrame:
    return parts.groupBy(*columns).agg(F.sum("_sum").cast(SUM).alias("_sum"), F.sum("_n").alias("_n")).where("_n <> 0 or _sum <> 0")


def _tasks(grains: int) -> int:
    return -(-grains // TASK_GRAINS) or 1


class DashboardStore:
    """The maintained dashboard of the uploads under ``root``."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = ()) -> None:
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)

    def _state(self) -> tuple[int, dict]:
        numbers = [int(name.partition(".")[0]) for name, folder, _ in listing(self.spark, f"{self.root}/log") if not folder and name.endswith(".json")]
        if not numbers:
            return 0, {"uploads": {}, "parts": []}
        state = json.loads(read_text(self.spark, f"{self.root}/log/{max(numbers):09d}.json"))
        if "parts" not in state:  # of a store that had one merged rollup
            state["parts"] = [self._part(state["merged"], 1, len(state["uploads"]), 1)] if state["merged"] else []
        return max(numbers), state

    def _part(self, at: str, sign: int, uploads: int, level: int) -> dict:
        """What the log says of a part: its folder, sign, how many uploads'
        rollups went into it, level and number of grains."""
        grains = self.spark.read.parquet(f"{self.root}/{at}").count()
        return {"at": at, "sign": sign, "uploads": uploads, "level": level, "grains": grains}

    def uploads(self) -> list[str]:
        return sorted(self._state()[1]["uploads"])

    def _signed(self, part: dict) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{part['at']}")
        return df.withColumns({"_sum": (F.col("_sum") * part["sign"]).cast(SUM), "_n": F.col("_n") * part["sign"]})

    def _together(self, parts: list[dict]) -> DataFrame:
        together = self._signed(parts[0])
        for part in parts[1:]:
            together = together.unionByName(self._signed(part))
        return together

    def _added_up(self, parts: list[dict]) -> DataFrame:
        """The parts' sums, of all grains."""
        return merged(self._together(parts), self.keys, _tasks(sum(p["grains"] for p in parts)))

    def _fold(self, parts: list[dict], uploads: int, level: int) -> dict:
        """One part in the place of several."""
        target = f"merged/{uuid.uuid4().hex[:12]}"
        self._added_up(parts).write.parquet(f"{self.root}/{target}")
        return self._part(target, 1, uploads, level)

    def _levelled(self, parts: list[dict], uploads: int) -> list[dict]:
        """``parts`` with those merged that are due, for so many uploads."""
        if sum(p["uploads"] for p in parts) > 2 * (uploads + FOLD):
            level = 0
            while FOLD ** (level + 1) <= uploads:
                level += 1
            return [self._fold(parts, uploads, level)]
        level = 0
        while any(p["level"] >= level for p in parts):
            own = [p for p in parts if p["level"] == level]
            if len(own) >= FOLD:
                parts = [p for p in parts if p["level"] != level] + [self._fold(own, sum(p["uploads"] for p in own), level + 1)]
            level += 1
        return parts

    def _change(self, upload: str, folder: str | None) -> None:
        """Put ``folder`` in the place of the upload (None: take it out), and
        commit; done again on the newest state if another writer was first."""
        new = self._part(f"{folder}/rollup", 1, 1, 0) if folder is not None else None
        while True:
            number, state = self._state()
            old = state["uploads"].get(upload)
            if old is None and folder is None:
                return
            parts = list(state["parts"])
            if old is not None:
                parts.append(self._part(f"{old}/rollup", -1, 1, 0))
            if new is not None:
                parts.append(new)
            uploads = {**{k: v for k, v in state["uploads"].items() if k != upload}, **({upload: folder} if folder is not None else {})}
            parts = self._levelled(parts, len(uploads))
            if create_new(self.spark, f"{self.root}/log/{number + 1:09d}.json", json.dumps({"uploads": uploads, "parts": parts})):
                return

    def add(self, upload: str, categorised: DataFrame) -> None:
        """Add an upload's categorised rows, or put them in the place of
        the upload of that name. Its rows are written once and read back for
        the rollup and the largest purchases."""
        folder = f"uploads/{uuid.uuid4().hex[:12]}"
        categorised.write.parquet(f"{self.root}/{folder}/rows")
        rows = self.spark.read.parquet(f"{self.root}/{folder}/rows")
        rollup(rows, self.keys, _tasks(len(GRAINS) * rows.count())).write.parquet(f"{self.root}/{folder}/rollup")
        self._largest_rows(rows).write.parquet(f"{self.root}/{folder}/largest")
        self._change(upload, folder)

    def remove(self, upload: str) -> None:
        """Take an upload out of all results; unknown names change nothing."""
        self._change(upload, None)

    def _largest_rows(self, rows: DataFrame) -> DataFrame:
        fields = [c for c in ("txn_id", "date", "merchant", "description", "amount", "category") if c in rows.columns]
        if not self.keys:
            return rows.orderBy(F.col("amount").desc_nulls_last(), *newest_first_key()).limit(1).select(*fields)
        order = F.struct("amount", "date", (-F.col("txn_id")).alias("neg_txn"))
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*fields), order).alias("_row")).select(*self.keys, "_row.*")

    def _read(self, what: str) -> DataFrame:
        folders = list(self._state()[1]["uploads"].values())
        if not folders:
            raise ValueError(f"no upload under {self.root}")
        return self.spark.read.parquet(*[f"{self.root}/{f}/{what}" for f in folders])

    def grain(self, name: str) -> DataFrame:
        """The merged rollup of one grain: (keys, its columns, _sum, _n)."""
        return self._sums(name, GRAINS[name], [*self.keys, *GRAINS[name]])

    def _sums(self, name: str, by: Sequence[str], deal: Sequence[str]) -> DataFrame:
        """The sums of one grain by the keys and ``by``, straight from the
        parts, which are dealt by ``deal``; only these columns move."""
        parts = self._state()[1]["parts"]
        if not parts:
            raise ValueError(f"no upload under {self.root}")
        columns = [*self.keys, *by]
        own = self._together(parts).where(F.col("grain") == name).select(*columns, "_sum", "_n")
        return _summed(own.repartition(_tasks(sum(p["grains"] for p in parts)), *deal), columns)

    def category_totals(self) -> DataFrame:
        sums = self._per("category").select(*self.keys, "category", agg.money(F.col("_sum")).alias("amount"), F.col("_n").alias("count"))
        return sums if self.keys else sums.orderBy(F.desc("amount"), "category")

    def monthly_series(self, categories: Sequence[str]) -> DataFrame:
        dated = self.grain("category").where(F.col("month").isNotNull())
        wide = dated.groupBy(*self.keys, "month").pivot("category", sorted(categories)).agg(F.sum("_sum"))
        return wide.select(*self.keys, "month", *[F.coalesce(agg.money(F.col(f"`{c}`")), F.lit(0.0)).alias(c) for c in sorted(categories)])

    def metrics(self) -> DataFrame:
        return agg.metrics_of(self._per("category"), self.keys)

    def _per(self, column: str) -> DataFrame:
        """(keys, category or month, _sum, _n). Dealt by the keys alone, a key
        having at most categories × months a part: what a summary then does per
        key moves nothing again."""
        return self._sums("category", [column], self.keys or [column])

    def insights(self) -> dict[str, DataFrame]:
        """The cards of ``report.insight_cards``."""
        keys = self.keys
        days = self.grain("day").withColumnRenamed("_sum", "amount")
        months = self._per("month").where(F.col("month").isNotNull()).drop("_n")
        stats = ins.stats_of(self.grain("amount").withColumn("_newest", F.lit(None).cast("decimal(38,0)")), keys)
        return {
            "top_category": agg.share_of(self._per("category"), keys),
            "day_of_week": agg.weekday_profile(days, keys, rows="_n"),
            "peak_day": agg.peak_weekday(days, keys),
            "largest_purchase": ins.largest_purchase(self._read("largest"), keys),
            "month_over_month": ins.change_of(months, keys),
            "recurring": ins.recurring_of(stats, keys),
            "recurring_total": ins.recurring_total_of(ins.recurring_of(stats, keys, exact=True), keys),
        }

    def dashboard(self, categories: Sequence[str]) -> dict[str, object]:
        """The five results; only the transactions read rows."""
        return {
            "transactions": to_records(self._read("rows").orderBy(*newest_first_key()), include_category=True),
            "category_totals": self.category_totals(),
            "monthly_series": self.monthly_series(categories),
            "metrics": self.metrics(),
            "insights": self.insights(),
        }
