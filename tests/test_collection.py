"""The song table's subsets and folders, and the saved index of files."""

import os
import time

import pytest

from stemloom.sources import collection

SONGS = """path,mid,tracks,genre,metadata,subset:all_valid,subset:rated_deduplicated
./data/a/1,./mid/a/1.mid,0-40,pop,{wide},True,True
./data/b/2,./mid/b/2.mid,73,,x,True,False
./data/c/3,./mid/c/3.mid,,jazz,x,False,True
"""


@pytest.fixture
def songs(tmp_path):
    (tmp_path / "songs.csv").write_text(SONGS)
    return f"{tmp_path}/songs.csv"


def test_subsets_of_columns(spark, songs):
    read = lambda subset: [r.mid for r in collection.read_songs(spark, songs, ["mid"], subset).collect()]
    assert read("all") == ["./mid/a/1.mid", "./mid/b/2.mid", "./mid/c/3.mid"] and read("all_valid") == ["./mid/a/1.mid", "./mid/b/2.mid"] and read("rated_deduplicated") == ["./mid/a/1.mid"]
    with pytest.raises(ValueError, match="unknown subset"):
        read("some")
    x = collection.read_songs(spark, songs, ["mid", "tracks"], "all")
    got = x.select(collection.mid_path(x["mid"], "/root/").alias("m"), collection.track_programs(x["tracks"]).alias("p")).collect()
    assert [(r.m, r.p) for r in got] == [("/root/mid/a/1.mid", [0, 40]), ("/root/mid/b/2.mid", [73]), ("/root/mid/c/3.mid", [])]


def test_render_rows(spark, songs):
    rows = spark.read.option("header", True).csv(songs)
    got = collection.render_rows(rows, "/pdmx", "/out/", "basic")
    assert got.columns == ["path", "mid", "tracks", "genre", "path_output", "mid_pdmx"]
    assert {tuple(r[c] for c in ("path", "mid", "path_output")) for r in got.collect()} == {("/pdmx/data/a/1", "/pdmx/mid/a/1.mid", "/out/basic/a/1"), ("/pdmx/data/b/2", "/pdmx/mid/b/2.mid", "/out/basic/b/2")}
    sample = spark.createDataFrame([("2", 0)], "song_id string, place int")
    assert [(r.song_id, r.place) for r in collection.render_rows(rows, "/pdmx", "/out", "basic", sample).collect()] == [("2", 0)]


def test_saved_index_is_built_when_a_source_is_newer(spark, tmp_path):
    stems = spark.createDataFrame([("s1", 0, 0, False, "Piano"), ("s1", 1, 40, False, "Violin"), ("s2", 0, 0, True, "Drums")], "song_id string, track int, program int, is_drum boolean, name string")
    spec = spark.createDataFrame([("piano", "midi-ddsp", "slakh"), ("strings", "midi-ddsp", "slakh"), ("drums", "basic", "basic")], "category string, method string, fallback string")
    source, path, built = tmp_path / "stems.csv", f"{tmp_path}/index", []
    source.write_text("x")

    def build():
        built.append(1)
        return collection.midi_index(stems, spec, "/m/")

    load = lambda: {tuple(r) for r in collection.saved_index(spark, path, [str(source), f"{tmp_path}/none"], build).collect()}
    want = {("s1", "/m/s1.mid", 2, 0, 1, 1), ("s2", "/m/s2.mid", 1, 1, 0, 0)}
    assert load() == want and load() == want and len(built) == 1
    later = time.time() + 60
    os.utime(source, (later, later))
    assert load() == want and len(built) == 2
