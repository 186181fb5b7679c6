"""Tables with many writers: no lost row, no gap for readers."""

import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest

from stemloom.sources import versioned


def rows(spark, values, schema="k long, who long, v long"):
    return spark.createDataFrame(values, schema)


def test_twenty_writers_lose_no_row_and_readers_see_no_gap(spark, tmp_path):
    path, n = f"{tmp_path}/t", 20
    versioned.upsert(spark, path, rows(spark, [(k, -1, 0) for k in range(100)]))
    done, seen, problems = threading.Event(), [], []

    def write(w):
        versioned.upsert(spark, path, rows(spark, [(1000 + w, w, 1), (w, w, 1), (50, w, 1), (50, w, 2)]))

    def look():
        while not done.is_set():
            try:
                got = versioned.read(spark, path, ["k"]).select("k").collect()
                seen.append(len({r.k for r in got}))
            except Exception as e:
                problems.append(e)

    reader = threading.Thread(target=look)
    reader.start()
    with ThreadPoolExecutor(n) as pool:
        list(pool.map(write, range(n)))
    done.set()
    reader.join()
    assert not problems and seen and min(seen) >= 100 and seen == sorted(seen)
    got = versioned.read(spark, path, ["k"]).collect()
    assert {r.k for r in got} == {*range(100), *range(1000, 1000 + n)}
    assert all(r.who == r.k % 1000 for r in got if r.k < n or r.k >= 1000)
    last = [r for r in got if r.k == 50]
    assert len(last) == 2 and len({r.who for r in last}) == 1  # all rows of the last batch with the key, of no other
    assert versioned.versions(spark, path) == list(range(1, n + 2))


def test_versions_compaction_and_vacuum(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        versioned.read(spark, path, ["k"])
    assert versioned.upsert(spark, path, rows(spark, [(1, 1, 1), (2, 1, 1), (None, 1, 1)])) == 1
    assert versioned.upsert(spark, path, rows(spark, [(2, "x"), (3, "y"), (None, "z")], "k long, more string")) == 2
    want = {(1, 1, 1, None), (2, None, None, "x"), (3, None, None, "y"), (None, None, None, "z")}
    assert {tuple(r) for r in versioned.read(spark, path, ["k"]).select("k", "who", "v", "more").collect()} == want
    assert {r.k for r in versioned.read(spark, path, ["k"], version=1).collect()} == {1, 2, None}
    assert versioned.compact(spark, path, ["k"]) == 3 and len(versioned.batches(spark, path)[1]) == 1
    assert {tuple(r) for r in versioned.read(spark, path, ["k"]).select("k", "who", "v", "more").collect()} == want
    assert versioned.compact(spark, path, ["k"]) == 3  # nothing to do
    assert versioned.vacuum(spark, path, keep=1) == 0  # too young
    assert versioned.vacuum(spark, path, keep=1, older_than=-1) == 2
    assert versioned.versions(spark, path) == [3] and versioned.read(spark, path, ["k"]).count() == 4


def test_compaction_keeps_what_is_published_meanwhile(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    for k in range(3):
        versioned.upsert(spark, path, rows(spark, [(k, 0, k), (9, 0, k)]))
    real = versioned._merged

    def slow(spark, path, listed, keys):
        out = real(spark, path, listed, keys)
        versioned.upsert(spark, path, rows(spark, [(9, 5, 5), (7, 5, 5)]))
        return out

    monkeypatch.setattr(versioned, "_merged", slow)
    versioned.compact(spark, path, ["k"])
    monkeypatch.undo()
    assert {tuple(r) for r in versioned.read(spark, path, ["k"]).collect()} == {(0, 0, 0), (1, 0, 1), (2, 0, 2), (7, 5, 5), (9, 5, 5)}


def test_a_writer_that_always_loses_says_so(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    versioned.upsert(spark, path, rows(spark, [(1, 1, 1)]))
    monkeypatch.setattr(versioned, "_published", lambda *a: False)
    monkeypatch.setattr(versioned, "PAUSE", 0.0)
    with pytest.raises(versioned.ConflictError):
        versioned.upsert(spark, path, rows(spark, [(2, 2, 2)]), tries=3)
    monkeypatch.undo()
    assert [r.k for r in versioned.read(spark, path, ["k"]).collect()] == [1]  # its batch is in no version


def test_a_name_is_published_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    versioned.upsert(spark, path, rows(spark, [(1, 1, 1)]))
    began = time.time()
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda w: versioned._published(spark, path, 2, [str(w)]), range(8)))
    assert sum(won) == 1 and versioned.batches(spark, path)[1] == [str(won.index(True))] and time.time() - began < 30
