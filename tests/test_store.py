"""The chunk store on disk, and index statistics that follow it."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import sparse, versions
from tessera.sources import folder
from tessera.sources.scratch import shared_path
from tessera.streaming import upkeep

ROW = "doc_id long, lang string, n int, version int"


def batch(spark, ids, version, lang="en"):
    return spark.createDataFrame([(i, lang, k, version) for i in ids for k in range(2)], ROW)


def current(spark, path):
    return sorted((r.doc_id, r.n, r.version) for r in versions.read_current(spark, path).collect())


def written(spark, path, gen):
    return [b for b in folder.names(spark, f"{path}/data/gen={gen}") if b.startswith("bucket=")]


def test_emptied_buckets_vanish(spark):
    path = shared_path(spark, "store")
    first = batch(spark, [1], 1, "fr").union(batch(spark, [2], 1))
    versions.write_batch(first, first, path, 0)
    versions.write_batch(batch(spark, [1], 2), first.limit(0), path, 1)  # superseded by nothing
    assert current(spark, path) == [(2, 0, 1), (2, 1, 1)]
    assert sorted((r.doc_id, r.is_current) for r in versions.read_all(spark, path).collect()) == [(1, False), (1, False), (2, True), (2, True)]
    versions.write_batch(batch(spark, [2], 2), first.limit(0), path, 2)
    assert current(spark, path) == []


def test_only_touched_buckets_are_written(spark):
    path = shared_path(spark, "store")
    many = batch(spark, range(300), 1)
    versions.write_batch(many, many, path, 0, buckets=16)
    assert len(written(spark, path, "batch-0")) == 16
    one = batch(spark, [7], 2)
    state = versions.write_batch(one, one, path, 1)
    assert len(written(spark, path, "batch-1")) == 1
    assert sum(g == "batch-1" for g in state["current"].values()) == 1
    old = [f for f in versions.read_current(spark, path).inputFiles() if "gen=batch-1" not in f]
    assert len(old) == 15 and not any("is_current=false" in f for f in old)
    assert current(spark, path) == sorted((i, k, 2 if i == 7 else 1) for i in range(300) for k in range(2))


def test_batches_come_again_and_fail_half_way(spark):
    path = shared_path(spark, "store")
    first, second = batch(spark, range(20), 1), batch(spark, range(5), 2)
    versions.write_batch(first, first, path, 0, buckets=4)

    def stop(old, state):
        raise OSError("lost")

    with pytest.raises(OSError):
        versions.write_batch(second, second, path, 1, before_commit=stop)
    assert current(spark, path) == sorted((i, k, 1) for i in range(20) for k in range(2))
    want = sorted((i, k, 2 if i < 5 else 1) for i in range(20) for k in range(2))
    for _ in range(2):
        versions.write_batch(second, second, path, 1)
        assert current(spark, path) == want
    other = versions.write_batch(second, second, path, 0, source="other")
    assert other["done"] == {"batch": 1, "other": 0}
    with pytest.raises(RuntimeError):
        folder.commit_json(spark, f"{path}/manifest/{other['number']:012d}.json", {})
    before = sorted((r.doc_id, r.n, r.version, r.is_current) for r in versions.read_all(spark, path).collect())
    versions.vacuum(spark, path, keep=1)
    assert current(spark, path) == want
    assert sorted((r.doc_id, r.n, r.version, r.is_current) for r in versions.read_all(spark, path).collect()) == before


def test_null_keys_and_languages(spark):
    path = shared_path(spark, "store")
    rows = spark.createDataFrame([(None, None, 1, 1), (3, None, 1, 1)], ROW)
    versions.write_batch(rows, rows, path, 0)
    assert versions.read_current(spark, path).count() == 2
    with pytest.raises(ValueError):
        versions.read_current(spark, shared_path(spark, "none"))


def test_statistics_follow_every_batch(spark, monkeypatch):
    monkeypatch.setattr(upkeep, "FOLD_EVERY", 2)
    rng = random.Random(6)
    stop = {"en": ["the"], "de": ["und"]}
    words = ["red", "fox", "the", "haustür", "und", "sea", "sand", "x"]
    path, now = shared_path(spark, "index"), {}
    for number in range(6):
        rows = []
        for _ in range(8):
            doc = rng.randint(0, 14)
            text = None if rng.random() < 0.2 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))
            rows.append((doc, rng.choice(["de", "en", "fr"]), text, rng.randint(1, 3)))
        df = spark.createDataFrame(rows, "doc_id long, lang string, text string, version int")
        best = {r.doc_id: r for r in upkeep.newest(df).collect()}
        now.update(best)
        for _ in range(2):  # a batch that comes again changes nothing
            upkeep.apply_batch(df, path, number, stop)
        live = spark.createDataFrame([(d, r.lang, r.text) for d, r in now.items() if r.text is not None], "doc_id long, lang string, text string")
        sizes = live.where(F.col("lang").isin("de", "en")).groupBy("lang").agg(F.count("*").alias("n"))
        want = sparse.inverse_frequencies(sparse.term_counts(live, stop), sizes).collect()
        row = lambda r: (r.lang, r.term, r.df, round(r.idf, 9))
        assert sorted(map(row, upkeep.current_idf(spark, path).collect())) == sorted(map(row, want))
    assert len(versions.manifest(spark, path)["changes"]) <= 3
