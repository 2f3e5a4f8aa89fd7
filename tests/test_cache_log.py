"""The cache as a transactional log."""

import threading

import pytest

from ledgerlens.sources import cache, files

SCHEMA = "merchant string, parsed_description string, category string"


@pytest.fixture
def pairs(spark):
    return lambda *rows: spark.createDataFrame([(m, "d", c) for m, c in rows], SCHEMA)


def labels(spark, root):
    return {r.merchant: r.category for r in cache.load_cache(spark, root).collect()}


def test_compaction_keeps_what_it_cannot_read(spark, tmp_path, pairs):
    """A version that is away for a moment while an upsert would compact is not forgotten."""
    root = str(tmp_path / "cache")
    for k in range(3):
        cache.upsert_cache(spark, root, pairs((f"m{k}", "Travel")), compact_every=4)
    (tmp_path / "cache" / "v=2").rename(tmp_path / "away")
    with pytest.warns(UserWarning):
        cache.upsert_cache(spark, root, pairs(("m3", "Travel")), compact_every=4)
    assert cache.numbered_folders(spark, root, "full") == []
    (tmp_path / "away").rename(tmp_path / "cache" / "v=2")
    assert set(labels(spark, root)) == {"m0", "m1", "m2", "m3"}
    cache.upsert_cache(spark, root, pairs(("m0", "Health")), compact_every=4)
    assert cache.numbered_folders(spark, root, "full") == [5] and labels(spark, root)["m0"] == "Health" and len(labels(spark, root)) == 4


def test_compaction_holds_rows_against_the_manifest(spark, tmp_path, pairs):
    """A file of the right size and other rows stops a compaction and a vacuum."""
    root = str(tmp_path / "cache")
    cache.upsert_cache(spark, root, pairs(("ma", "Travel")), compact_every=9)
    cache.upsert_cache(spark, root, pairs(("mb", "Travel")), compact_every=9)
    one, two = (next((tmp_path / "cache" / f"v={n}").glob("*.parquet")) for n in (1, 2))
    kept = two.read_bytes()
    two.write_bytes(one.read_bytes())
    for crc in (tmp_path / "cache" / "v=2").glob(".*.crc"):
        crc.unlink()
    assert one.stat().st_size == len(kept)
    with pytest.warns(UserWarning, match="not compacted"):
        assert cache.compact_cache(spark, root) is None
    two.write_bytes(kept)
    assert cache.compact_cache(spark, root) == 2 and set(labels(spark, root)) == {"ma", "mb"}


def test_two_writers_at_once_both_stay(spark, tmp_path, pairs):
    root = str(tmp_path / "cache")
    frames = [pairs((f"w{k}", "Travel"), ("both", f"c{k}")) for k in range(4)]
    got, gate = {}, threading.Barrier(4)

    def write(k):
        gate.wait()
        got[k] = cache.upsert_cache(spark, root, frames[k], compact_every=100)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got.values()) == [1, 2, 3, 4]
    found = labels(spark, root)
    assert {f"w{k}" for k in range(4)} <= set(found) and found["both"] == f"c{max(got, key=got.get)}"


def test_late_commit_is_not_covered_by_a_full_copy(spark, tmp_path, pairs):
    """A writer that claimed its number before a compaction and commits after it: its pairs count, older than newer versions."""
    root = str(tmp_path / "cache")
    cache.upsert_cache(spark, root, pairs(("a", "one"), ("b", "one")))
    late = cache._claim(spark, root)
    cache.upsert_cache(spark, root, pairs(("a", "three")))
    assert cache.compact_cache(spark, root) == 3
    pairs(("a", "two"), ("b", "two"), ("c", "two")).write.parquet(f"{root}/v={late}")
    assert labels(spark, root) == {"a": "three", "b": "one"}  # written, not committed
    cache._commit(spark, root, cache.Layer(late, "upsert", None, frozenset()))
    assert labels(spark, root) == {"a": "three", "b": "two", "c": "two"}


def test_vacuum_deletes_what_a_full_copy_covers(spark, tmp_path, pairs):
    root = str(tmp_path / "cache")
    for k in range(7):
        cache.upsert_cache(spark, root, pairs((f"m{k}", "Travel"), ("x", f"c{k}")), compact_every=3)
    before = labels(spark, root)
    assert sorted(cache.vacuum_cache(spark, root)) == ["full=3", "v=1", "v=2", "v=3", "v=4", "v=5", "v=6"]
    assert labels(spark, root) == before and before["x"] == "c6" and len(before) == 8
    assert cache.vacuum_cache(spark, str(tmp_path / "none")) == []


def test_a_missing_full_copy_falls_back_to_its_versions(spark, tmp_path, pairs):
    root = str(tmp_path / "cache")
    for k in range(3):
        cache.upsert_cache(spark, root, pairs((f"m{k}", "Travel")), compact_every=3)
    files.remove(spark, f"{root}/full=3")
    with pytest.warns(UserWarning):
        assert set(labels(spark, root)) == {"m0", "m1", "m2"}


def test_folders_of_earlier_releases_are_read(spark, tmp_path, pairs):
    root = str(tmp_path / "cache")
    pairs(("a", "one")).write.parquet(f"{root}/v=1")
    pairs(("a", "one"), ("b", "one")).write.parquet(f"{root}/full=2")
    pairs(("b", "three")).write.parquet(f"{root}/v=3")
    assert labels(spark, root) == {"a": "one", "b": "three"}
    assert cache.upsert_cache(spark, root, pairs(("c", "four"))) == 4
    assert labels(spark, root) == {"a": "one", "b": "three", "c": "four"}
