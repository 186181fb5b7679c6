"""File sources, sinks and streams on small files."""

import struct

from pyspark.sql import functions as F

from stemloom.sources import files
from stemloom.streaming import upsert as streams


def test_csv_drift(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("path, track,extra\nx,1,q\n\ny\nz,3,r,more\n")
    got = files.read_csv_flexible(spark, str(p), ["path", "track", "newer"]).collect()
    assert sorted(tuple(r) for r in got) == [("x", "1", ""), ("y", "", ""), ("z", "3", "")]
    assert files.read_csv_flexible(spark, str(tmp_path / "none.csv"), ["a", "b"]).count() == 0


def test_cells(spark):
    df = spark.createDataFrame([("a", None, "No"), ("", "b", None), ("c", "d", "yes")], "x string, y string, z string")
    assert [tuple(r) for r in files.cells(df, ["z"]).collect()] == [("a", "NA", "False"), ("NA", "b", "False"), ("c", "d", "True")]


def test_upsert_replaces_by_key_and_keeps_batch_repeats(spark, tmp_path):
    p = str(tmp_path / "t")
    schema = "path string, track int, method string"
    files.upsert(spark, p, spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], schema), ["path", "track"])
    files.upsert(spark, p, spark.createDataFrame([("a", 0, "n"), ("a", 0, "m")], schema), ["path", "track"])
    assert sorted(tuple(r) for r in spark.read.parquet(p).collect()) == [("a", 0, "m"), ("a", 0, "n"), ("a", 1, "y")]


def test_append_with_new_columns(spark, tmp_path):
    p = str(tmp_path / "t")
    files.append(spark.createDataFrame([("1",)], "a string"), p, ["a"])
    files.append(spark.createDataFrame([("2", "b")], "a string, b string"), p, ["a", "b"])
    assert sorted((r.a, r.b) for r in files.read_appended(spark, p).collect()) == [("1", None), ("2", "b")]


def test_nested_responses(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"listener_id":"l","complete":true,"ratings":[{"trial_id":"t","stem_id":"s","category":"c","samples":[{"variant_id":"v","content":5,"realism":4},{"variant_id":"w","content":null,"realism":1}]}]}\n'
        '{"listener_id":"m","complete":false,"ratings":[]}\n'
    )
    got = files.ratings_rows(files.read_jsonl(spark, [str(tmp_path / "r.json"), str(tmp_path / "no.json")], files.RATINGS)).collect()
    assert sorted((r.listener_id, r.variant_id, r.content, r.realism) for r in got) == [("l", "v", 5.0, 4.0), ("l", "w", None, 1.0)]


def test_rank_merge(spark):
    df = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 1, 0, float("nan")), ("b", 0, 2, 3.0)], "id string, file int, line int, f double")
    assert sorted((r.id, r.f) for r in files.merge_ranks(df, "id", ["f"]).collect()) == [("a", None), ("b", 3.0)]


def _midi(*tracks: bytes) -> bytes:
    return b"MThd" + struct.pack(">IHHH", 6, 1, len(tracks), 480) + b"".join(b"MTrk" + struct.pack(">I", len(t)) + t for t in tracks)


def test_midi(spark, tmp_path):
    piano = b"\x00\xff\x03\x05Piano" + b"\x00\xc0\x05" + b"\x00\x90\x3c\x40" + b"\x60\x3c\x00" + b"\x00\xff\x2f\x00"
    drums = b"\x00\x99\x24\x40" + b"\x81\x00\x89\x24\x00" + b"\x00\xff\x2f\x00"
    (tmp_path / "a.mid").write_bytes(_midi(piano, drums, b"\x00\xff\x2f\x00"))
    (tmp_path / "bad.mid").write_bytes(b"nonsense")
    got = files.read_midi(spark, str(tmp_path)).drop("path").collect()
    assert sorted(tuple(r) for r in got if r.ok) == [(True, 0, "Piano", 5, False, 1), (True, 1, None, 0, True, 1), (True, 2, None, 0, False, 0)]
    assert sum(not r.ok for r in got) == 1


def test_flac(spark):
    info = (44100 << 44 | 1 << 41 | 15 << 36 | 88200).to_bytes(8, "big")
    good = b"fLaC\x00\x00\x00\x22" + bytes(10) + info + bytes(16)
    df = spark.createDataFrame([(bytearray(good),), (bytearray(b"no"),)], "content binary")
    assert [r[0] for r in df.select(files.flac_seconds(F.col("content"))).collect()] == [2.0, None]


def test_song_index_round_trip(spark):
    songs = spark.createDataFrame([("a",), ("b",)], "song_id string")
    stems = spark.createDataFrame([("a", 1, 5, False), ("a", 0, 0, True)], "song_id string, track int, program int, is_drum boolean")
    assert sorted(tuple(r) for r in files.flattened(files.song_index(songs, stems)).collect()) == [("a", 0, 0, True), ("a", 1, 5, False)]


def test_first_existing(spark):
    listing = spark.createDataFrame([("y",), ("z",)], "path string")
    rows = spark.createDataFrame([(1, "x", "y"), (2, "z", "y"), (3, "p", "q")], "k int, a string, b string")
    assert {r.k: r.resolved for r in files.first_existing(rows, ["a", "b"], listing).collect()} == {1: "y", 2: "z", 3: None}


def test_stream_keep_last(spark, tmp_path):
    schema, src, out, ck = "k string, at int, v string", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    for part in ([("a", 1, "x"), ("b", 1, "y")], [("a", 3, "new"), ("a", 2, "old")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        streams.keep_last_into(streams.stream_parquet(spark, src, schema), out, ["k"], ["at"], ck).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [("a", "new"), ("b", "y")]


def test_stream_windows(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("select timestamp'2024-01-01 00:05:00' ts, 'a' event_type, 1.0D value, 1L user_id union all select timestamp'2024-01-01 00:50:00', 'a', 2.0D, 1L union all select timestamp'2024-01-01 05:00:00', 'a', 4.0D, 1L").write.parquet(src)
    schema = spark.read.parquet(src).schema
    for f, name, want in ((streams.windowed_counts, "w", {(2, 3.0), (1, 4.0)}),):
        q = f(streams.stream_parquet(spark, src, schema)).writeStream.format("memory").outputMode("complete").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        assert {(r.n, r.total) for r in spark.sql(f"select * from {name}").collect()} == want
    q = streams.sessions(streams.stream_parquet(spark, src, schema)).writeStream.format("memory").outputMode("append").queryName("s").trigger(availableNow=True).start()
    q.awaitTermination()
    assert all(r.n == 1 for r in spark.sql("select * from s").collect())
