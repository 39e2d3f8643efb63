"""The versioned cache: two writers, a killed one, readers of one version."""

import threading

import pytest
from pyspark.sql import functions as F

from locusframe.sources.cache import CacheConflict, VersionedCache


def asked(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "k long")


def named(by):
    return lambda keys: keys.withColumn("by", F.lit(by))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_fills_once_and_keeps_versions(spark, tmp_path):
    cache = VersionedCache(spark, str(tmp_path / "c"), ["k"])
    assert cache.read() is None and cache.version() == 0
    assert rows(cache.fill(asked(spark, 1, 2, 2), named("a"))) == [(1, "a"), (2, "a")]
    assert rows(cache.fill(asked(spark, 2, 3), named("b"))) == [(1, "a"), (2, "a"), (3, "b")]
    assert rows(cache.fill(asked(spark, 1), named("c"))) == rows(cache.read()) and cache.version() == 2
    assert rows(cache.read(1)) == [(1, "a"), (2, "a")]


def test_the_second_of_two_writers_takes_what_the_first_built(spark, tmp_path):
    path = str(tmp_path / "c")
    first, second = (VersionedCache(spark, path, ["k"]) for _ in range(2))

    def slow(keys):
        """While the second writer builds, the first commits overlapping keys."""
        built = named("second")(keys)
        first.fill(asked(spark, 1, 2), named("first"))
        return built

    assert rows(second.fill(asked(spark, 2, 3), slow)) == [(1, "first"), (2, "first"), (3, "second")]
    assert second.version() == 2
    same = VersionedCache(spark, path, ["k"])
    assert rows(same.fill(asked(spark, 9), lambda keys: (first.fill(asked(spark, 9), named("first")), named("third")(keys))[1])) == rows(first.read())
    assert rows(first.read().where("k = 9")) == [(9, "first")]


def test_many_writers_at_once(spark, tmp_path):
    path, failed = str(tmp_path / "c"), []

    def work(i):
        try:
            VersionedCache(spark, path, ["k"]).fill(asked(spark, 0, i, i + 1), named(str(i)))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(1, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    assert [k for k, _ in rows(VersionedCache(spark, path, ["k"]).read())] == [0, 1, 2, 3, 4, 5]


def test_a_killed_writer_leaves_no_rows(spark, tmp_path):
    cache = VersionedCache(spark, str(tmp_path / "c"), ["k"])
    cache.fill(asked(spark, 1), named("a"))
    broken = lambda keys: keys.withColumn("by", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        cache.fill(asked(spark, 2), broken)
    assert rows(cache.read()) == [(1, "a")] and rows(cache.fill(asked(spark, 2), named("b"))) == [(1, "a"), (2, "b")]


def test_gives_up_after_lost_races(spark, tmp_path, monkeypatch):
    cache = VersionedCache(spark, str(tmp_path / "c"), ["k"])
    cache.fill(asked(spark, 1), named("a"))
    other = VersionedCache(spark, str(tmp_path / "c"), ["k"])
    count = iter(range(100, 200))
    whole = VersionedCache._commit
    monkeypatch.setattr(cache, "_commit", lambda v, f: (other.fill(asked(spark, next(count)), named("o")), whole(cache, v, f))[1])
    with pytest.raises(CacheConflict):
        cache.fill(asked(spark, 2), named("b"), attempts=2)
    assert 2 not in [k for k, _ in rows(other.read())] and cache.unlisted()
