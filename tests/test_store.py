"""Keyed tables in buckets: equal to a full outer join, untouched files stay, lost and competing writers change nothing."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from caregap.streaming.store import StaleVersion, TableStore

SCHEMA = "k string, a int, b string"


def newest_wins(stored, changes):
    columns = changes.columns
    old, new = (t.select("k", F.struct(*columns).alias(n)) for t, n in ((stored, "old"), (changes, "new")))
    return old.join(new, F.col("old.k").eqNullSafe(F.col("new.k")), "full_outer").select(F.coalesce("new", "old").alias("r")).select("r.*")


def rows(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA)


def content(store):
    return {r.k: (r.a, r.b) for r in store.snapshot("t").collect()}


def folders(store, version):
    return json.loads(Path(store.root, "t/versions", f"v={version}").read_text())["folders"]


def test_three_batches_touch_only_their_buckets(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    assert store.snapshot("t") is None and store.latest_version("t") == 0
    first = {f"k{i}": (i, "one") for i in range(60)} | {None: (1, None)}
    assert store.upsert(rows(spark, *[(k, *v) for k, v in first.items()]), "t", "k", newest_wins, buckets=16) == 1
    second = {"k3": (-3, "two"), "new": (7, None)}
    store.upsert(rows(spark, *[(k, *v) for k, v in second.items()]), "t", "k", newest_wins)
    third = {"k3": (None, "three"), None: (2, "null key")}
    assert store.upsert(rows(spark, *[(k, *v) for k, v in third.items()]), "t", "k", newest_wins) == 3
    assert content(store) == first | second | third
    one, two = folders(store, 1), folders(store, 2)
    moved = {b for b in one | two if one.get(b) != two.get(b)}
    assert 1 <= len(moved) <= 2 and len(one) > 10
    assert not any(name.startswith(".draft") for name in [p.name for p in Path(store.root, "t/versions").iterdir() if p.suffix != ".crc"])


def test_no_changes_make_no_version(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    empty = rows(spark, ("x", 1, "y")).limit(0)
    assert store.upsert(empty, "t", "k", newest_wins) == 1 and store.snapshot("t").count() == 0
    store.upsert(rows(spark, ("x", 1, "y")), "t", "k", newest_wins)
    assert store.upsert(empty, "t", "k", newest_wins) == 2
    assert content(store) == {"x": (1, "y")}


def test_a_bucket_may_become_empty(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.upsert(rows(spark, ("x", 1, "y")), "t", "k", buckets=4)
    store.upsert(rows(spark, ("x", 1, "y")), "t", "k", lambda stored, gone: stored.join(gone, "k", "left_anti"))
    assert store.snapshot("t").columns == ["k", "a", "b"] and store.snapshot("t").count() == 0


def test_a_run_lost_before_it_is_published(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path))
    store.upsert(rows(spark, ("x", 1, "y")), "t", "k", newest_wins)
    monkeypatch.setattr(TableStore, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.upsert(rows(spark, ("x", 2, "z"), ("w", 3, "z")), "t", "k", newest_wins)
    assert content(store) == {"x": (1, "y")}
    monkeypatch.undo()
    assert store.upsert(rows(spark, ("x", 2, "z")), "t", "k", newest_wins) == 2
    assert content(store) == {"x": (2, "z")}


def test_two_writers_cannot_take_the_same_version(spark, tmp_path):
    store, other = TableStore(spark, str(tmp_path)), TableStore(spark, str(tmp_path))
    store.upsert(rows(spark, ("x", 1, "y")), "t", "k", newest_wins)

    def slow(stored, changes):
        other.upsert(rows(spark, ("x", 5, "other")), "t", "k", newest_wins)
        return newest_wins(stored, changes)

    with pytest.raises(StaleVersion):
        store.upsert(rows(spark, ("x", 9, "slow")), "t", "k", slow)
    assert content(store) == {"x": (5, "other")} and store.latest_version("t") == 2


def test_a_merge_that_moves_keys_is_refused(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.upsert(rows(spark, ("x", 1, "y")), "t", "k", newest_wins)
    with pytest.raises(ValueError, match="not read"):
        store.upsert(rows(spark, ("x", 1, "y")), "t", "k", lambda stored, _: stored.unionByName(stored.withColumn("k", F.lit("far away"))))
    assert content(store) == {"x": (1, "y")}
