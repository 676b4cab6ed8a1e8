"""Saving in versions, and caches that follow them."""

import sqlite3
import threading

import pytest

from procera.operators import research
from procera.sources import loading, shared
from procera.sources.versions import SaveConflict, VersionedTable
from procera.streaming.refresh import TimedCache, file_state, table_state


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_readers_never_find_a_gap(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(10).write.parquet(path)
    seen, failed, over = [], [], threading.Event()

    def reader():
        while not over.is_set():
            try:
                seen.append(loading.load_parquet(spark, path).count())
            except Exception as e:  # whatever it is, it is what must not happen
                failed.append(e)

    thread = threading.Thread(target=reader)
    thread.start()
    try:
        for k in range(1, 6):
            research.save_over(spark.range(10 + k), path)
    finally:
        over.set()
        thread.join()
    assert not failed and set(seen) <= set(range(10, 16)) and seen == sorted(seen)
    assert loading.load_parquet(spark, path).count() == 15


def test_save_over_what_is_read_and_places_stay_out(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(10).coalesce(1).write.parquet(path)
    first = loading.load_parquet(spark, path, order="_row")
    saved = research.save_over(first.where("id > 6"), path)
    assert saved.number == 1 and ids(loading.load_parquet(spark, path)) == [7, 8, 9]
    assert spark.read.parquet(saved.folder).columns == ["id"]
    research.save_over(loading.load_parquet(spark, path).limit(0), path)  # a table may become empty, and keeps its columns
    assert loading.load_parquet(spark, path).columns == ["registro_id", "id"] and ids(loading.load_parquet(spark, path)) == []
    assert ids(first) == list(range(10))  # a frame that was read before keeps its rows


def test_second_writer_is_told(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    assert table.current() is None
    one = table.save(spark.range(1))
    table.save(spark.range(2), base=one)
    with pytest.raises(SaveConflict):
        table.save(spark.range(3), base=one)
    assert ids(table.read()) == [0, 1]
    assert table.save(spark.range(4)).number == 3 and ids(table.read()) == [0, 1, 2, 3]


def test_half_written_versions_are_not_read(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    table.save(spark.range(2))
    (tmp_path / "t/_versions/2").write_text("abc")  # no end mark yet
    assert table.current().number == 1 and ids(table.read()) == [0, 1]
    assert table.save(spark.range(3)).number == 3


def test_vacuum_keeps_what_readers_hold(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    for k in range(4):
        table.save(spark.range(k))
    table.vacuum(keep=2)
    assert table.versions() == [1, 2, 3, 4]  # all younger than an hour
    table.vacuum(keep=2, seconds=-1)
    assert table.versions() == [3, 4] and len(list((tmp_path / "t/_data").iterdir())) == 2
    assert ids(table.read()) == [0, 1, 2]


def test_a_save_drops_only_its_own_frames(spark, tmp_path):
    a, b, base = f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/x.db"
    for path in (a, b):
        spark.range(3).write.parquet(path)
    with sqlite3.connect(base) as db:
        db.execute("CREATE TABLE t (n INTEGER)")
    loads = []
    caches = [TimedCache(), TimedCache()]  # two sessions

    def get(cache, path):
        return cache.get(path, lambda: (loads.append(path), loading.load_parquet(spark, path))[1], table_state(spark, path))

    for cache in caches:
        for path in (a, b, a, b):
            get(cache, path)
    assert loads == [a, b, a, b]
    research.save_over(spark.range(5), a)
    for cache in caches:
        assert (get(cache, a).count(), get(cache, b).count()) == (5, 3)
    assert loads[4:] == [a, a]
    state = file_state(base)
    before = state()
    with sqlite3.connect(base) as db:
        db.executemany("INSERT INTO t VALUES (?)", [(i,) for i in range(5000)])
    assert state() != before and file_state(f"{base}.none")() == (None, None)
    for cache in caches:
        cache.clear()


def test_shared_tables_are_released(spark):
    from pathlib import Path

    kept = shared.written(spark.range(3).limit(0), "kept")
    folder = Path(kept.inputFiles()[0].removeprefix("file://")).parent
    assert kept.isEmpty() and kept.columns == ["id"] and folder.exists()
    shared.release(spark)
    assert not folder.exists()
    shared.release(spark)  # nothing is left to delete
