"""Lexical search, spelling variants and exact dedup against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from ledgerlens.llm import exact, lexical, queries, variants
from tools.oracle_check import compare_all

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
DOC = "doc_id long, text string, row int, n string, score long, digest string, word string, kept int"


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(1, None), (2, ""), (3, " \t .. "), (4, prose(40_000)), (5, "Straße 12 ÉCOLE école"), (5, "Straße 12 ÉCOLE école"), (None, "straße 12 ÉCOLE école"), (None, None),
            (6, "x" * 100_000), (7, "x" * 99_999), (8, "X" * 100_000), (9, "日本 ٣ a1b2 ×÷ Ābc")]
    rows += [(100 + i, prose(rng.randint(1, 60))) for i in range(80)] + [(300 + i, "same words in many copies") for i in range(50)]
    return spark.createDataFrame([(i, t, 1, None, 2, "d", "w", 0) for i, t in rows], DOC)


def naive_search(docs, items, top=50):
    terms = [(i, TERM.findall(fold(t))) for i, t in docs]
    n_docs, words = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = collections.Counter(x for _, t in terms for x in set(t))
    out = collections.Counter()
    for item, text in items:
        scores = []
        for i, t in terms:
            tf = collections.Counter(t)
            m = 100 - 50 + 50 * len(t) * n_docs // words if words else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10 ** 9 * tf[x] // (1000 * tf[x] + 20 * m)) for x in set(TERM.findall(fold(text))) if tf[x])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out.update((item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1))
    return out


def test_lexical_search_odd_rows(odd, spark):
    items = [(1, "Straße école 12"), (2, None), (3, "..."), (4, "x" * 100_000), (5, "same words, in MANY copies"), (None, "日本"), (7, "nothing known")]
    items += [(10 + i, r.text) for i, r in enumerate(odd.where("doc_id between 100 and 130").collect())]
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = naive_search([(r.doc_id, r.text) for r in odd.collect()], items)
    for kind in ({}, {"first": 5, "bucket_rows": 7, "focus": (1, 2)}, {"block_terms": 40, "focus": (3,), "bucket_rows": 16}):
        got = lexical.rank_documents(odd, frame, **kind)
        assert collections.Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == want, kind
    assert lexical.rank_documents(odd.limit(0), frame).count() == 0 and lexical.rank_documents(odd, frame.limit(0)).count() == 0


def test_lexical_search_avoids_work(spark):
    """Bounds leave out most documents; what is left gives the results of the whole table."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "benchmark"))
    work = lexical.search_work(docs, items).agg({"scored": "sum"}).first()[0]
    assert work < 0.6 * docs.count() * items.count()


def naive_words(docs, drop_every=31, min_letters=7, min_count=2):
    n = collections.Counter()
    for i, text in docs:
        for run in LETTERS.findall(text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % drop_every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= min_letters and k >= min_count}


def edits(word, letters):
    for k in range(len(word) + 1):
        for c in letters:
            yield word[:k] + c + word[k:]
            if k < len(word):
                yield word[:k] + c + word[k + 1:]
        if k < len(word):
            yield word[:k] + word[k + 1:]


def naive_variants(n, ratio=10):
    letters = sorted({c for w in n for c in w})
    near = {w: {x for x in edits(w, letters) if x in n and x != w} for w in n if len(w) < 1000}
    long = [w for w in n if len(w) >= 1000]
    for w in long:
        near[w] = {x for x in long if x != w and (x in edits(w, {"x"}))}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.mark.parametrize("tile_rows", [4096, 3])
def test_spelling_variants_whole_table(spark, tile_rows, monkeypatch):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    want = naive_variants(naive_words([(r.doc_id, r.text) for r in docs.collect()]))
    got = rows_of(queries.op12_spelling_variants(spark, SF001) if tile_rows == 4096 else variants.group_variants(docs, tile_rows=tile_rows))
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r[1] is not None for r in want) > 5


def test_spelling_variants_odd_rows(odd):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    for least in (7, 1):
        want = naive_variants(naive_words(docs, min_letters=least))
        assert set(rows_of(variants.group_variants(odd, min_letters=least, tile_rows=2))) == want
    assert variants.group_variants(odd.limit(0)).count() == 0


def test_spelling_variants_chains_and_dense_tiles(spark, monkeypatch):
    """Chains of forms over several edits, and a tile in which all words share most letters."""
    words = ["aaaaaaaa"] * 4000 + ["aaaaaaab"] * 300 + ["aaaaaabb"] * 20 + ["aaaaabbb"] * 2
    rng = random.Random(4)
    dense = {"prefix" + "".join(rng.choice("abc") for _ in range(rng.randint(3, 5))) for _ in range(600)}
    words += [w for w in dense for _ in range(2 + 40 * (rng.random() < 0.1))]
    docs = [(i, " ".join(words[i::50])) for i in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = naive_variants(naive_words(docs, drop_every=1 << 40))
    for block in (48, 2):
        monkeypatch.setattr(variants, "BLOCK_ROWS", block)
        got = rows_of(variants.group_variants(frame, drop_every=1 << 40, tile_rows=100))
        assert len(got) == len(want) and set(got) == want
    assert {r[2] for r in got if r[0] == "aaaaabbb"} == {"aaaaaaaa"}


def check_exact(docs, got):
    name = lambda t: hashlib.sha256(fold(t).encode()).hexdigest()
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[name(t)].append(i)
    keep = {h: max((i for i in g if i is not None), default=None) for h, g in groups.items()}
    rows = [(r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in got]
    assert collections.Counter(rows) == collections.Counter((i, keep[name(t)], len(groups[name(t)]), name(t)) for i, t in docs)
    kept = collections.Counter(bytes(r.digest).hex() for r in got if r.kept)
    assert kept == collections.Counter(groups.keys()) and all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("share", [10_000, 3])
def test_exact_dedup_odd_rows(odd, tmp_path, share, monkeypatch):
    monkeypatch.setattr(exact, "HOT_SHARE", share)
    check_exact([(r.doc_id, r.text) for r in odd.collect()], exact.deduplicate(odd, str(tmp_path / "index")).collect())
    assert exact.deduplicate(odd.limit(0), str(tmp_path / "none")).count() == 0


def test_exact_dedup_appends_to_a_persistent_index(spark, tmp_path):
    root = str(tmp_path / "index")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = exact.deduplicate(frame([(1, "a"), (2, "A"), (3, "b")]), root, buckets=4)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.known) for r in first.collect()} == {(1, 2, 2, False, False), (2, 2, 2, True, False), (3, 3, 1, True, False)}
    second = exact.deduplicate(frame([(9, "a"), (10, "c"), (11, "B"), (12, "C")]), root).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.known) for r in second} == {
        (9, 2, 3, False, True), (10, 12, 2, False, False), (11, 3, 2, False, True), (12, 12, 2, True, False)}
    assert exact.read_index(spark, root).count() == 3 and exact.commits(spark, root) == 2
    plan = exact.read_index(spark, root).hint("merge").join(frame([(1, "a")]).selectExpr("unhex(sha2(text, 256)) digest").repartition(4, "digest"), "digest")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning") <= 1  # the index is not shuffled


def test_exact_dedup_survives_a_lost_writer(spark, tmp_path, monkeypatch):
    """A batch that died before its commit leaves nothing behind; a taken commit number is a conflict."""
    root = str(tmp_path / "index")
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    with monkeypatch.context() as patch:
        patch.setattr(exact, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            exact.deduplicate(docs, root)
    assert exact.read_index(spark, root).count() == 0
    assert all(r.kept for r in exact.deduplicate(docs, root).collect())
    with pytest.raises(exact.DigestConflict):
        exact._commit(spark, root, 0, "other")


def test_queries_match_their_sql(spark):
    assert compare_all(spark, SF01, ["op11_lexical_search", "op13_exact_dedup"]) == []
