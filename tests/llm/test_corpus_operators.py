"""Corpus operators against brute force on whole small tables."""

import bisect
import collections
import hashlib
import random
import re
import zlib

import pytest
import xxhash

from ledgerlens.llm import langid, mixing, packing, queries, simhash, suffixes
from ledgerlens.llm.common import components

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, fp long, size string, s int"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"wort{i % 997}" for i in range(30_000))
    shared = " ".join(f"passage{i}" for i in range(80))
    rows = [
        (1, None, None, None, None, 0, "x", 1), (2, "", "en", "a", 0, 0, "x", 1), (3, " \t\n\x0b ", "en", "a", 5, 0, "x", 1),
        (4, long, "de", "b", None, 1, None, 1), (5, "one two " + shared, "en", "a", None, 1, None, 1), (6, shared + " three", "en", None, None, 1, None, 1),
        (7, "Equal text here", "en", "a", 15, 2, None, None), (7, "Equal text here", "en", "a", 15, 2, None, None),
        (None, "Equal text here", "en", "a", 15, 2, None, None), (None, None, None, None, None, None, None, None),
        (9, "a" * 1000, "xx", "c", 1000, 2, None, None), (10, "é" * 600, "fr", "c", 600, 2, None, None), (11, "<|endoftext|> <|ENDOFTEXT|>x", "en", "c", 20, 2, None, None),
        (12, "equal TEXT here", "en", "a", 15, 2, None, None), (13, "12 34 !!", "en", "a", 8, 2, None, None),
    ]
    return spark.createDataFrame(rows, DOC)


def naive_simhash(text, k=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(fp, bits=4):
    """fp: {row: fingerprint}; row -> set of rows that can be reached."""
    distinct = sorted(set(fp.values()))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    groups = collections.defaultdict(list)
    for row, x in fp.items():
        groups[find(x)].append(row)
    return {row: group for group in groups.values() for row in group}


def test_simhash_whole_table(spark, documents):
    got = {r.doc_id: r for r in queries.op4_simhash(spark, SF01).collect()}
    fp = {i: naive_simhash(r.text) for i, r in documents.items()}
    groups = naive_components(fp)
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{x:016x}" for i, x in fp.items()}
    assert {i: r.component_id for i, r in got.items()} == {i: min(groups[i]) for i in fp}


def test_simhash_odd_rows(odd, spark):
    rows = odd.collect()
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(rows)
    groups = naive_components({k: naive_simhash(r.text) for k, r in enumerate(rows)})
    want = collections.Counter()
    for k, r in enumerate(rows):
        ids = [rows[x].doc_id for x in groups[k] if rows[x].doc_id is not None]
        want[(r.doc_id, naive_simhash(r.text), min(ids, default=None))] += 1
    assert collections.Counter((r.doc_id, r.fp % 2 ** 64, r.component_id) for r in got) == want
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_simhash_keep_one_by_group(spark):
    """Ids shared by different texts, and rows without an id, lose nothing."""
    text = lambda seed: " ".join(random.Random(seed).choice("abcdefghij") * 3 + str(k) for k in range(60))
    a, b, c, d = map(text, range(4))
    rows = [(7, a), (7, b), (None, c), (None, c), (None, d), (8, a), (9, d + " more"), (3, None), (None, "")]
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    groups = {frozenset(map(rows.__getitem__, g)) for g in naive_components({k: naive_simhash(t) for k, (_, t) in enumerate(rows)}).values()}
    assert len(kept) == len(groups) and all(sum(k in g for k in kept) == 1 for g in groups)
    assert {(7, a), (7, b), (None, c), (3, None)} <= set(kept)


def test_simhash_bucket_index_finds_every_component():
    import numpy as np

    rng = np.random.default_rng(5)
    for size in (2, 40, 900):
        centre = rng.integers(0, 2 ** 63, 6, dtype=np.uint64)
        fp = np.unique([int(centre[rng.integers(6)]) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 9)))) for _ in range(size)]).astype(np.uint64)
        src, dst = simhash.bucket_links(fp, 4)
        pairs = {int(a): int(b) for a, b in zip(src, dst)}
        want = naive_components({int(x): int(x) for x in fp})
        root = lambda x: root(pairs[x]) if x in pairs else x
        assert {x: root(x) for x in want} == {x: root(min(g, key=lambda y: (y in pairs, y))) for x, g in want.items()}
        assert len({root(x) for x in want}) == len({tuple(g) for g in want.values()})


def test_simhash_large_buckets_are_cut(spark, documents):
    """Buckets beyond the limit give the same groups by pairs of chunks."""
    rng = random.Random(7)
    centre = [rng.getrandbits(64) for _ in range(3)]
    near = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(12))) for c in centre for _ in range(150)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    distinct = spark.createDataFrame([(signed(x),) for x in near], "fp long")
    dealt = simhash.buckets(distinct, 4, 20)
    assert dealt.where("part > 0").count() > 0
    assert dealt.groupBy("mask", "value", "part").count().agg({"count": "max"}).first()[0] <= 60
    root = {r.node: r.root for r in components(simhash.links(distinct, 4, bucket_rows=20)).collect()}
    found = collections.defaultdict(set)
    for x in near:
        found[root.get(signed(x), signed(x))].add(x)
    assert {frozenset(g) for g in found.values()} == {frozenset(g) for g in naive_components({x: x for x in near}).values()}
    table = spark.read.parquet(f"{SF01}/documents.parquet").where("doc_id < 1500")
    few, many = ({r.doc_id: r.component_id for r in simhash.near_duplicates(table, bucket_rows=n).collect()} for n in (2, 1 << 16))
    assert few == many


def test_simhash_blocks_for_more_fingerprints():
    rng = random.Random(3)
    assert [simhash.agreeing_blocks(n, 4, 1 << 16) for n in (0, 10**8, 10**10, 10**12)] == [1, 1, 2, 3]
    for agree in (1, 2, 3):
        masks = simhash.block_masks(4, agree)
        for _ in range(200):
            differ = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(differ & m % 2**64 == 0 for m in masks)


def naive_repeats(texts, length):
    where = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if where[t[i:i + length]] > 1:
                mark[i:i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(t, mark) if not m)
        out.append((len(t), sum(mark), len(re.findall(rb"\x01+", bytes(mark))), kept))
    return out


def naive_passages(texts, length=240, min_words=50):
    """Texts without the stretches of ``min_words`` whole words whose every
    ``length`` bytes also stand in another text."""
    where = collections.defaultdict(set)
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            where[t[i:i + length]].add(t)
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if len(where[t[i:i + length]]) > 1:
                mark[i:i + length] = b"\1" * length
        words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        for m in re.finditer(rb"\x01+", bytes(mark)):
            if sum(m.start() <= a and b <= m.end() for a, b in words) < min_words:
                mark[m.start():m.end()] = bytes(m.end() - m.start())
        out.append(bytes(b for b, m in zip(t, mark) if not m))
    return out


def test_passages_of_fifty_words(spark, monkeypatch):
    """Planted passages of 51 words, across documents and inside one, shorter ones, and copies in one document of what others hold."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(51) for _ in range(4)]
    short, own, periodic = prose(46), prose(70), "ab " * 400
    rows = [(i, f"{prose(rng.randint(5, 90))}\n{shared[i % 4]}\n{prose(rng.randint(5, 90))}") for i in range(40)]
    rows += [(100 + i, f"{prose(20)}\n{own}\n{prose(20)}\n{own}\n{shared[0]}\n{prose(9)}\n{shared[0]}") for i in range(1)]
    rows += [(200 + i, f"{prose(60)}\n{short}\n{prose(60)}") for i in range(3)]
    rows += [(300, periodic), (301, prose(30) + periodic + prose(3)), (302, "x" * 5000), (303, prose(80))]
    for limit in (4096, 3):
        monkeypatch.setattr(suffixes, "SHARD_RUNS", limit)
        got = {r.doc_id: r.text for r in suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert [got[i].encode() for i, _ in rows] == naive_passages([t.encode() for _, t in rows])
    for i, t in rows:
        if i < 40:
            assert shared[i % 4] not in got[i] and len(got[i]) > len(t) - len(shared[i % 4]) - 20
        elif i >= 200 and i not in (300, 301):
            assert got[i] == t
    assert got[100].count(own) == 2 and shared[0] not in got[100]


def test_periodic_text_has_few_runs():
    import numpy as np

    data = np.frombuffer(b"a" * 100_000 + b"xy" * 50_000, np.uint8)
    anchor, first, last, folds = suffixes.runs_of(data, 400, 100, suffixes._powers(suffixes.PIECE + 400))
    assert len(first) < 700 and folds.any() and first[0] == 0 and last[-1] == len(data) - 400
    assert (first[1:] == last[:-1] + 1).all() and (last - first < 400).all()


def test_suffix_dedup_whole_table(spark):
    got = {r.doc_id: r for r in queries.op8_suffix_dedup(spark, SF001).collect()}
    rows = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    for r, (n, removed, spans, kept) in zip(rows, naive_repeats([(r.text or "").encode() for r in rows], suffixes.LENGTH)):
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())
        assert (g.text, g.n_kept) == (kept.decode("utf-8", "ignore"), len(kept))


def test_suffix_dedup_odd_rows(odd):
    rows = odd.collect()
    want = collections.Counter((r.doc_id, *w) for r, w in zip(rows, naive_repeats([(r.text or "").encode() for r in rows], 400)))
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(odd).collect())
    assert got == want
    out = suffixes.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(rows)
    assert suffixes.remove_repeats(odd.limit(0)).count() == 0


def test_suffix_dedup_cuts_no_character_in_two(spark):
    # the shared bytes begin inside a character: é and ĩ end in the same byte
    tail = "é" + "x" * 500
    docs = spark.createDataFrame([(1, "a" + tail), (2, "bĩ" + "x" * 500)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in suffixes.without_repeats(docs, min_words=0).collect()}
    assert out == {1: "a", 2: "b"}


def test_suffix_dedup_many_shards(spark, monkeypatch):
    """One passage in very many contexts: its anchors are spread over shards and merged."""
    import random

    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(700)
    rows = [(i, text(rng.randint(0, 300)) + passage[rng.randint(0, 200):rng.randint(500, 700)] + text(rng.randint(0, 300))) for i in range(120)]
    monkeypatch.setattr(suffixes, "SHARD_RUNS", 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect()}
    assert [got[i] for i, _ in rows] == naive_repeats([t.encode() for _, t in rows], 400)


def check_packing(rows, got, capacity=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    want = collections.Counter()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for p, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a:a + capacity]
            want[(i, p, a, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = collections.defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    gaps, best = [], 0
    for length in sorted((r.length for r in got), reverse=True):  # best-fit decreasing, one by one
        k = bisect.bisect_left(gaps, length)
        rest = gaps.pop(k) - length if k < len(gaps) else capacity - length
        best += rest == capacity - length
        bisect.insort(gaps, rest)
    best = len(gaps)
    assert len(held) == best


def test_packing_whole_table(spark, documents):
    check_packing([(i, r.text) for i, r in documents.items()], queries.op5_packing(spark, SF01).collect())


def test_packing_odd_rows(odd):
    check_packing([(r.doc_id, r.text) for r in odd.collect()], packing.pack_documents(odd).collect())
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_packing_capitals_before_combining_marks(spark):
    """NFC comes before lower case: a mark may compose with the lower-case letter only."""
    texts = [f"Plain {c}{m} {c.lower()}{m} X{c}{m}y" for c, m in zip("HTWYJ", "\u0331\u0308\u030a\u030a\u030c")]
    rows = list(enumerate([*texts, "J\u030c" * 3000, "\u00c9COLE \u00c9cole E\u0301 <|ENDOFTEXT|>\u00c9"]))
    check_packing(rows, packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def naive_targets(sizes):
    names = sorted((x for x in sizes if x is not None)) + [None] * (None in sizes)
    w = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}
    total, open_, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        t = (total - sum(target.values())) / sum(w[x] for x in open_)
        above = {x for x in open_ if w[x] * t > 2 * sizes[x]}
        if not above:
            return target | {x: w[x] * t for x in open_}
        target |= {x: 2.0 * sizes[x] for x in above}
        open_ -= above
    return target


def test_mixing_whole_table(spark, documents):
    got = queries.op7_mixing(spark, SF01).collect()
    size = {i: len(WORD.findall(r.text or "")) for i, r in documents.items()}
    sizes = collections.Counter()
    for i, r in documents.items():
        sizes[r.source] += size[i]
    aims = naive_targets(sizes)
    taken = collections.Counter()
    for r in got:
        source = documents[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[source])
        assert r.target == pytest.approx(aims[source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source] += r.taken
    assert len(got) == len(size)
    for source, aim in aims.items():
        assert taken[source] == pytest.approx(aim, rel=0.005, abs=20)
    again = queries.op7_mixing(spark, SF01).collect()
    assert sorted(again) == sorted(got)


def test_mixing_goes_on_behind_a_document_that_does_not_fit(spark):
    """Long documents at the threshold: the small ones behind them fill the gap."""
    rng = random.Random(3)
    long = [(i, "w " * n, "a") for i, n in enumerate((60_000, 30_000, 9_000, 9_000, 9_000))]
    small = [(100 + i, "w " * rng.randint(3, 40), "a") for i in range(3000)]
    docs = spark.createDataFrame([*long, *small, (9000, "w " * 100_000, "b")], "doc_id long, text string, source string")
    for seed in (1, 2, 3):
        got = [r for r in mixing.mix(docs, weights=(1.0, 2.0), seed=seed, edge=0).collect() if r.doc_id < 9000]
        lacking = got[0].target - sum(r.taken for r in got)
        assert -1e-6 <= lacking < min(r.size for r in got if r.copies == int(got[0].target / got[0].source_size))


def test_mixing_odd_rows(odd):
    got = mixing.mix(odd).collect()
    rows = odd.collect()
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in rows)
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.where("doc_id = 4").count() in (1, 2)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mixing_samples_with_unequal_probability(spark):
    """Importance shifts the extra copies, and not the words."""
    rows = [(i, "w " * 20, "a", 1.0 + 3.0 * (i % 2)) for i in range(4000)] + [(9000, "w " * 160_000, "b", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, pull double")
    got = [r for r in mixing.mix(docs, importance_col="pull", weights=(1.0, 2.0)).collect() if r.doc_id < 9000]
    assert sum(r.taken for r in got) == pytest.approx(got[0].target, abs=20)
    extra = collections.Counter(r.doc_id % 2 for r in got if r.copies > int(got[0].target / got[0].source_size))
    assert not extra or extra[1] >= extra[0]


def test_language_id_whole_table(spark, documents):
    got = {r.doc_id: r for r in queries.op3_language_id(spark, SF01).collect()}
    assert got.keys() == documents.keys()
    right = sum(got[i].language == r.lang for i, r in documents.items())
    assert right >= 0.98 * len(documents)
    assert sum(not r.accepted for r in got.values()) <= 0.005 * len(documents)


def test_language_id_text_overrules_wrong_declarations(spark, documents):
    """Held out: the model is fitted and counted with a share of wrong and missing declarations."""
    rows = [(i, r.text, (None if i % 7 == 0 else "en" if i % 5 == 0 else r.lang), f"http://h{i % 9}.{r.lang}.example.{r.lang}/x") for i, r in documents.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = langid.identify(docs).collect()
    assert sum(r.language == documents[r.doc_id].lang for r in got) >= 0.97 * len(rows)


def test_language_id_knows_every_declared_language(spark):
    """More than 32 languages, some with a few documents only."""
    rng = random.Random(5)
    rows = []
    for k in range(60):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(60)]
        tag = chr(97 + k // 26) + chr(97 + k % 26)
        rows += [(tag, " ".join(rng.choice(words) for _ in range(150))) for _ in range(2 if k % 6 == 0 else 8)]
    docs = spark.createDataFrame([(i, text, tag, f"http://h{i % 5}.example.org/") for i, (tag, text) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[i].language == tag and got[i].accepted for i, (tag, _) in enumerate(rows))
    assert langid.keep_known(docs).count() == len(rows)


def test_language_id_odd_rows(odd, spark):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    assert not any(r.accepted for r in got if r.doc_id in (1, 2, 3))
    assert langid.keep_known(odd).columns == odd.columns
    assert langid.identify(odd.limit(0)).count() == 0
    assert langid.host is not None
    urls = spark.createDataFrame([("https://u@Www.Example.co.uk:80/a?b",), ("src4",), (None,)], "u string")
    h = langid.host(urls.u)
    assert [tuple(r) for r in urls.select(h, langid.domain(h), langid.suffix(h)).collect()] == [
        ("www.example.co.uk", "co.uk", "uk"), ("src4", "src4", None), (None, None, None)]


def test_mixing_odds_fall_with_the_size(spark):
    """Without a column of importance, realised shares per size follow the documented odds."""
    rng = random.Random(9)
    sizes = {k: (8, 32, 128)[k % 3] for k in range(3000)}
    rows = [(k, " ".join(f"w{rng.randrange(50)}" for _ in range(n)), "a") for k, n in sizes.items()] + [(9000, "x " * 120_000, "b")]
    got = [r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0, 9.0)).collect() if r.doc_id < 9000]
    target, total = got[0].target, got[0].source_size
    base = int(target // total)
    pull = sum(n * n ** -mixing.TILT for n in sizes.values())
    for n in (8, 32, 128):
        intended = (target - base * total) * n ** -mixing.TILT / pull
        realised = sum(r.copies - base for r in got if r.size == n) / 1000
        assert 0.05 < intended < 0.95 and abs(realised - intended) < 0.06, (n, intended, realised)
    assert abs(sum(r.taken for r in got) - target) < 8


def test_packing_full_pieces_and_hot_lengths(spark):
    """Full pieces are sequences of their own without a rank; a length that most pieces share is ranked in several buckets."""
    sizes = [8] * 40 + [3] * 200 + [5] * 30 + [1] * 7
    parts = spark.createDataFrame([(k % 9, k, 0, 0, n, k) for k, n in enumerate(sizes)], "doc_id long, row long, piece long, start long, length long, ids_crc32 long")
    for bucket_pieces in (7, 1000):
        rows = packing.pack(parts, 8, bucket_pieces).collect()
        held = {}
        for r in rows:
            held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert sorted(r.length for r in rows) == sorted(sizes)
        for places in held.values():
            places.sort()
            assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 8
        assert len(held) == 40 + 30 + 85 and all((i < 0) == (places == [(0, 8)]) for i, places in held.items())
    assert packing.pack(parts.where("length = 8"), 8).count() == 40 and packing.pack(parts.limit(0), 8).count() == 0
