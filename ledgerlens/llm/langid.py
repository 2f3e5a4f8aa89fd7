"""Language identification by Bayesian evidence fusion.

Evidence for each language l of a document:

* text: naive Bayes over hashed byte trigrams of the whole text (letters
  only, ASCII folded). Neighbouring trigrams depend on each other, so the sum
  is scaled to ``EFFECTIVE`` independent ones.
* the declared markup language (``<html lang>`` or a language column):
  P(declared | l), counted over all documents by the language their text
  speaks for, smoothed; a source that declares at random gets little weight.
* the address suffix: P(suffix | l), likewise.
* the host: P(l | host), shrunk towards its domain, that towards all
  documents (Dirichlet pseudo-counts ``SHRINK``), all by grouped aggregation.

A background class "und" with uniform trigrams stands for text in none of the
languages. A document is rejected when it holds no letters, when "und" wins,
or when no language reaches ``MIN_POSTERIOR``.

The text model knows every declared language and is fitted on a bounded
sample: the ``SAMPLE`` documents of least hash of each. It holds the trigram
buckets that occur in a language's sample (at most ``BUCKETS``), one value
stands for the others. All counts over declarations, suffixes and hosts are
over all documents, kept for the languages that occur with them.

Null text is empty (rejected); null declarations, addresses and suffixes add
no evidence, null hosts share one prior. Repeated rows are judged alike. With
no labelled language every document is rejected; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import row_slices, ship_by_value, text_buffer, tidied, written

SAMPLE = 500
BUCKETS = 1 << 14
EFFECTIVE = 60.0
SHRINK = 20.0
UNDECIDED = 0.01
MIN_POSTERIOR = 0.5
#: Cells (documents by languages) that the fusion works on at once.
CELLS = 1 << 20

#: Bytes as the model sees them: letters folded, bytes of other scripts kept, all else a blank.
FOLD = np.array([b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def tag(column: Column) -> Column:
    """Primary subtag of a declared language, null if there is none."""
    primary = F.lower(F.trim(F.regexp_extract(column.cast("string"), r"^\s*([A-Za-z]{2,8})\b", 1)))
    return F.when(primary != "", primary)


def host(address: Column) -> Column:
    """Host of an address (or the whole of a bare source name)."""
    return F.lower(F.regexp_extract(address.cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)", 1))


def domain(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.]*\.?[^.]*)$", 1)


def suffix(name: Column) -> Column:
    last = F.regexp_extract(name, r"\.([A-Za-z][A-Za-z0-9-]*)$", 1)
    return F.when(last != "", last)


def trigrams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of the trigrams of texts that hold two letters at least."""
    x = FOLD[raw[at[0]:at[-1]]].astype(np.uint32)
    if len(x) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    blanks = (x == 32).astype(np.int8)
    ok = blanks[:-2] + blanks[1:-1] + blanks[2:] < 2
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok &= row[:-2] == row[2:]
    bucket = (code[ok] * np.uint32(2654435761)) >> np.uint32(18)
    return bucket.astype(np.int64) % BUCKETS, row[:-2][ok]


def _evidence(docs: DataFrame, id_col: str, text_col: str, declared_col: str, address_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = host(F.col(address_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"),
                       tag(F.col(declared_col)).alias("declared"), name.alias("host"), domain(name).alias("domain"), suffix(name).alias("suffix"))


def fit(evidence: DataFrame, sample: int = SAMPLE) -> tuple[list[str], tuple[np.ndarray, ...]]:
    """Languages, and their model: log P(trigram bucket | language) as one value
    for the buckets that the sample lacks, where the language's other buckets
    begin, these buckets and their values."""
    ship_by_value()
    # one row per declared language
    languages = sorted(r.declared for r in evidence.where("declared is not null").select("declared").distinct().collect())
    labelled = evidence.where("declared is not null").withColumn("h", F.xxhash64("doc_id", "th"))
    first = Window.partitionBy("declared").orderBy("h")
    least = (labelled.select("declared", "h").distinct().withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample)
             .groupBy("declared").agg(F.max("h").alias("most")))  # a row per language
    chosen = labelled.join(F.broadcast(least), "declared").where("h <= most").select("declared", "h", "text").dropDuplicates(["declared", "h"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {x: k for k, x in enumerate(languages)}
        for b in batches:
            raw, at = text_buffer(b.column(1))
            own = np.array([index[x] for x in b.column(0).to_pylist()], np.int64)
            for lo, hi in row_slices(at):
                bucket, row = trigrams(raw, at[lo:hi + 1])
                cell, n = np.unique(own[lo:hi][row] * BUCKETS + bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], ["cell", "n"])

    # at most BUCKETS cells per language
    cells = chosen.select("declared", "text").mapInArrow(tidied(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cell, n = cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64)
    by = np.argsort(cell)
    cell, n = cell[by], n[by]
    own = cell // BUCKETS
    whole = np.bincount(own, n, len(languages)) + 0.5 * BUCKETS
    return languages, (np.log(0.5 / whole), np.searchsorted(own, np.arange(len(languages) + 1)), (cell % BUCKETS).astype(np.uint16), np.log((n + 0.5) / whole[own]))


def text_scores(evidence: DataFrame, languages: list[str], model: tuple[np.ndarray, ...]) -> DataFrame:
    """Evidence with ``scores`` (log likelihood per language, then the
    background, scaled) and ``letters`` (number of trigrams)."""
    ship_by_value()
    n = len(languages) + 1
    names = ["doc_id", "th", "declared", "host", "domain", "suffix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other, begin, known, value = model
        rows = max(1, CELLS // n)
        for b in (whole.slice(lo, rows) for whole in batches for lo in range(0, whole.num_rows, rows)):
            raw, at = text_buffer(b.column(6))
            scores, letters = np.zeros((b.num_rows, n)), np.zeros(b.num_rows, np.int64)
            for lo, hi in row_slices(at):
                bucket, row = trigrams(raw, at[lo:hi + 1])
                number = np.bincount(row, minlength=hi - lo)
                letters[lo:hi] = number
                for k in range(n - 1):
                    logs = np.full(BUCKETS, other[k])
                    logs[known[begin[k]:begin[k + 1]]] = value[begin[k]:begin[k + 1]]
                    scores[lo:hi, k] = np.bincount(row, logs[bucket], minlength=hi - lo)
                scores[lo:hi, n - 1] = number * -np.log(BUCKETS)
            scores *= np.minimum(1.0, EFFECTIVE / np.maximum(letters, 1))[:, None]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, scores.size + 1, n, dtype=np.int32)), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], flat, pa.array(letters)], [*names, "scores", "letters"])

    return evidence.select(*names, "text").mapInArrow(tidied(run), "doc_id long, th long, declared string, host string, domain string, suffix string, scores array<double>, letters long")


def _dense(keys: pa.Array, counts: pa.Array, n: int) -> np.ndarray:
    """Rows of counts per language from lists of languages and their counts."""
    out = np.zeros((len(keys), n))
    size = keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(keys)), size), keys.flatten().to_numpy(zero_copy_only=False)] = counts.flatten().to_numpy(zero_copy_only=False)
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang",
             address_col: str = "source", sample: int = SAMPLE, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """(doc_id, th, language, posterior, accepted): one row per row of ``docs``."""
    evidence = _evidence(docs, id_col, text_col, declared_col, address_col)
    languages, model = fit(evidence, sample)
    if not languages:
        return evidence.select("doc_id", "th", F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    number = len(languages)
    scored = written(text_scores(evidence, languages, model).withColumn(
        "said", F.when(F.col("letters") > 0, F.array_position("scores", F.array_max("scores")).cast("int") - 1)), "scores")
    # the last number is the background's: it is no language
    votes = scored.where(F.col("said") < number)

    def spoken(name: str, *keys: str) -> DataFrame:
        """The languages that the texts speak for and their documents, by keys."""
        each = votes.groupBy(*keys, "said").agg(F.count(F.lit(1)).cast("double").alias("n"))  # at most a row per language and key
        lists = each.groupBy(*keys).agg(F.collect_list(F.struct("said", "n")).alias("l"))
        return lists.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.col("l.said").alias(f"{name}_k"), F.col("l.n").alias(f"{name}_n"))

    everything = np.zeros(number)
    for r in votes.groupBy("said").count().collect():  # a row per language
        everything[r["said"]] = r["count"]
    whole = everything.sum()
    prior = (everything + 1) / (whole + number)
    same = lambda name, key: F.col(key).eqNullSafe(F.col(f"{name}_{key}"))
    both = (scored.join(spoken("hosts", "host", "domain"), same("hosts", "host") & same("hosts", "domain"), "left")
            .join(spoken("domains", "domain"), same("domains", "domain"), "left")
            .join(spoken("tags", "declared"), F.col("declared") == F.col("tags_declared"), "left")
            .join(spoken("ends", "suffix"), F.col("suffix") == F.col("ends_suffix"), "left"))
    lists = [f"{name}_{c}" for name in ("hosts", "domains", "tags", "ends") for c in "kn"]

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows = np.array([*languages, "und"], object), max(1, CELLS // (number + 1))
        for b in (all_.slice(lo, rows) for all_ in batches for lo in range(0, all_.num_rows, rows)):
            logs = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, number + 1).copy()
            on_host, on_domain, by_tag, by_end = (_dense(b.column(6 + k), b.column(7 + k), number) for k in (0, 2, 4, 6))
            total = lambda n: n.sum(1, keepdims=True)
            towards = (on_domain + SHRINK * prior) / (total(on_domain) + SHRINK)
            logs[:, :number] += np.log((on_host + SHRINK * towards) / (total(on_host) + SHRINK) * (1 - UNDECIDED))
            logs[:, number] += np.log(UNDECIDED)
            for n, there in ((by_tag, b.column(4)), (by_end, b.column(5))):
                # P(key | language), smoothed by the key's share of all documents
                share = (total(n) + 1) / (whole + 1)
                per = np.where(there.to_numpy(zero_copy_only=False)[:, None], (n + SHRINK * share) / (everything + SHRINK), 1.0)
                logs[:, :number] += np.log(per)
                logs[:, number] += np.log(per.mean(1))
            best = logs.argmax(1)
            posterior = 1 / np.exp(logs - logs[np.arange(len(logs)), best][:, None]).sum(1)
            letters = b.column(2).to_numpy() > 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(letters), pa.array(names[best], pa.string()), pa.array(posterior)], ["doc_id", "th", "read", "language", "posterior"])

    fused = (both.select("doc_id", "th", "letters", "scores", F.col("declared").isNotNull().alias("tagged"), F.col("suffix").isNotNull().alias("ended"), *lists)
             .mapInArrow(tidied(fuse), "doc_id long, th long, read boolean, language string, posterior double").withColumn("posterior", F.round("posterior", 6)))
    good = F.col("read") & (F.col("language") != "und") & (F.col("posterior") >= min_posterior)
    return fused.select("doc_id", "th", F.when(F.col("read"), F.col("language")).otherwise("und").alias("language"), "posterior", good.alias("accepted"))


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that are rejected."""
    out = (identify(docs, id_col, text_col, **options).where("not accepted").select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th")).distinct())
    th = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(out, docs[id_col].cast("long").eqNullSafe(F.col("__doc")) & (th == F.col("__th")), "left_anti")
