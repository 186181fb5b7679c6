"""MIDI files: events, facts of tracks, routing by notes, corrected files and the file sink."""

import pytest
from pyspark.sql import functions as F

from stemloom.sources import midi

ON, OFF, PROGRAM = 0x90, 0x80, 0xC0


def meta(kind, data=b"", wait=0):
    return (wait, 0xFF, bytes([kind]) + data)


def note(n, velocity=80, wait=0, channel=0):
    return (wait, ON | channel, bytes([n, velocity]))


def off(n, wait=0, channel=0):
    return (wait, OFF | channel, bytes([n, 0]))


def program(p, channel=0):
    return (0, PROGRAM | channel, bytes([p]))


def control(channel=0):
    return (0, 0xB0 | channel, bytes([7, 100]))


def song(*tracks):
    return midi.file_of((480).to_bytes(2, "big"), tracks)


@pytest.fixture
def read(spark):
    def of(**files):
        return midi.read_events(spark.createDataFrame([(f"{k}.mid", bytearray(v)) for k, v in files.items()], "path string, content binary"))

    return of


MONO = [program(40), note(60), off(60, 480), note(62), off(62, 480)]
POLY = [program(40), note(60), note(64), off(60, 480), off(64)]
# name of the case: (messages, program that the row must have, route)
CASES = {
    "empty": ([meta(3, b"Marimba (Grand Staff)"), meta(0x2F, wait=1)], ("soundfont", None, "empty")),
    "zero": ([meta(3, b"Violin"), program(40), note(60), off(60), note(62, wait=480), note(62, 0)], ("soundfont", None, "zero_duration")),
    "mono": (MONO, ("midi_ddsp", "violin", "midi_ddsp")),
    "poly": (POLY, ("soundfont", "violin", "polyphonic")),
    "piano": ([meta(3, b"Piano"), *POLY[1:]], ("ddsp_piano", "piano", "piano")),
    "drums": ([control(0), program(0), note(36, channel=9), off(36, 100, 9)], ("soundfont", None, "drum")),
    "first_drums": ([control(9), note(36), off(36, 100)], ("soundfont", None, "drum")),
    "choir": ([meta(3, b"Choir"), program(52), *POLY[1:]], ("soundfont", None, "vocal")),
    "lute": ([meta(3, b"Lute"), program(24), *MONO[1:]], ("soundfont", None, "guitar")),
    "bass": ([program(33), *MONO[1:]], ("soundfont", None, "bass_guitar")),
    "double_bass": ([program(43), *MONO[1:]], ("midi_ddsp", "double bass", "midi_ddsp")),
    "unsupported": ([program(104), *MONO[1:]], ("soundfont", None, "unsupported")),
    "alto_sax": ([meta(3, b"Alto Sax"), program(65), *MONO[1:]], ("midi_ddsp", "saxophone", "midi_ddsp")),
    "overlap_at_a_tick": ([program(73), note(60), note(62, wait=480), off(60), off(62, 480)], ("soundfont", "flute", "polyphonic")),
    "off_first": ([program(73), note(60), off(60, 480), note(62), off(62, 480)], ("midi_ddsp", "flute", "midi_ddsp")),
    "velocity_zero_ends": ([program(73), note(60), note(60, 0, 480), note(62), note(62, 0, 480)], ("midi_ddsp", "flute", "midi_ddsp")),
}


def test_routes_with_notes(read):
    rows = midi.routed(midi.track_rows(read(**{k: song(v[0]) for k, v in CASES.items()}))).collect()
    assert {r.path: tuple(r.route) for r in rows} == {f"{k}.mid": v[1] for k, v in CASES.items()}


def test_track_rows_and_files(read, spark):
    one = song([meta(3, b"Empty")], [meta(3, b" Harp,si\0chord "), program(0), program(6), note(60), off(60, 480)], [control(9), program(3, 9)])
    running = bytearray(song([note(60), off(60, 10)]))
    at = running.index(bytes([0x0A, 0x80]))
    running[at : at + 4] = bytes([0x0A, 60, 0])  # the same, as running status with velocity 0
    running[18:22] = (len(running) - 22).to_bytes(4, "big")
    x = read(a=one, running=bytes(running), bad=b"MThd", worse=b"no", cut=one[:-9])
    got = {(r.path, r.track): r for r in midi.track_rows(x).collect()}
    assert set(got) == {("a.mid", 0), ("a.mid", 1), ("a.mid", 2), ("running.mid", 0)}
    assert [(r.name, r.program, r.is_drum, r.notes) for r in (got["a.mid", k] for k in range(3))] == [("Empty", 0, False, 0), ("Harp sichord", 6, False, 1), (None, 3, True, 0)]
    assert got["running.mid", 0].lasting and got["running.mid", 0].monophonic
    two = song([note(60), off(60, 100)], [note(64, wait=50), off(64, 100)])
    assert {r.path: r.monophonic for r in midi.file_is_monophonic(read(one=one, two=two, none=song([]))).collect()} == {"one.mid": True, "two.mid": False, "none.mid": True}


def test_many_open_notes_of_a_pitch(spark):
    n = 20_000
    rows = [(1, k, k, 60, True) for k in range(n)] + [(2, k, 5, 60, k < n // 2) for k in range(n)] + [(3, 0, 0, 60, False), (3, 1, 4, 60, True), (3, 2, 9, 61, False)]
    from stemloom.operators import planning

    got = planning.lasting_notes(spark.createDataFrame(rows, "k long, place long, tick long, note long, is_on boolean"), "k")
    assert {r.k: r.lasting for r in got.collect()} == {1: False, 2: False, 3: False}


TEMPO, METER = meta(0x51, b"\7\xa1\x20"), meta(0x58, b"\4\2\x18\x08")


def test_corrected_files_keep_time_and_take_programs(spark, read):
    data = song([TEMPO, METER, (960, 0xFF, b"\x51\0\0\1")], [meta(3, b"Violin I"), program(40), note(60), off(60, 480)], [note(36, channel=9), off(36, 10, 9)], [meta(3, b"stub")])
    content, rows = midi.corrected(data, {1: 41, 2: 0, 3: 5})
    assert rows == [(0, 1, 41, False, "Violin I"), (1, 2, 0, True, None)]
    division, tracks = midi.messages(content)
    assert division == (480).to_bytes(2, "big") and len(tracks) == 2
    assert tracks[0][:2] == [TEMPO, METER] and (0, PROGRAM, bytes([41])) in tracks[0]
    assert tracks[1][0] == (0, PROGRAM | 9, b"\0") and tracks[1][1:3] == [TEMPO, METER]  # it had no program
    assert all(sum(t[0] for t in x) == e for x, e in zip(tracks, (480, 10), strict=True))
    assert midi.corrected(song([TEMPO]), {}) == (None, [])
    same, _ = midi.corrected(data, {})
    assert midi.corrected(same, {})[0] is not None and [r[2] for r in midi.corrected(same, {})[1]] == [40, 0]


def test_register_to_files_and_back(spark, read, tmp_path):
    files = spark.createDataFrame([("a/x.mid", bytearray(song(MONO))), ("b.mid", bytearray(song([TEMPO]))), ("c.mid", bytearray(b"?")), ("d.mid", bytearray(song(MONO)))], "path string, content binary")
    register = spark.createDataFrame([("a/x.mid", 0, 71), ("b.mid", 0, 1), ("c.mid", 0, 1), ("gone.mid", 0, 1)], "path string, track int, program_corrected int")
    out = midi.corrected_midis(files, register)
    assert {r.path: (r.ok, r.content is None, len(r.tracks)) for r in out.collect()} == {"a/x.mid": (True, False, 1), "b.mid": (True, True, 0), "c.mid": (False, True, 0)}
    midi.write_files(out, f"{tmp_path}/out")
    again = midi.track_rows(midi.read_events(midi.midi_files(spark, f"{tmp_path}/out"))).collect()
    assert [(r.path.endswith("/out/a/x.mid"), r.program, r.notes) for r in again] == [(True, 71, 2)]
    assert not list((tmp_path / "out").glob(".staging*"))


def test_only_committed_attempts_leave_files(spark, tmp_path):
    from pyspark.sql import Row

    writer = midi._FilesWriter(f"{tmp_path}/out")
    rows = [Row(path=f"{k}.mid", content=bytearray(b"x" * k)) for k in range(5)]

    def broken():
        yield from rows[:3]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    first = writer.write(iter(rows))  # two attempts of one task; one counts
    writer.write(iter([Row(path="0.mid", content=bytearray(b"other")), Row(path="9.mid", content=bytearray(b"9"))]))
    assert not list((tmp_path / "out").glob("*.mid"))
    writer.commit([first, None])
    assert sorted((f.name, f.stat().st_size) for f in (tmp_path / "out").glob("**/*") if f.is_file()) == [(f"{k}.mid", k) for k in range(5)]
    lost = midi._FilesWriter(f"{tmp_path}/out")
    lost.write(iter(rows))
    lost.abort([])
    assert not list((tmp_path / "out").glob(".staging*"))
    for path in ("/etc/x", "../x", "a//b", "a/../../b"):
        with pytest.raises(ValueError):
            lost.write(iter([Row(path=path, content=bytearray(b"x"))]))


def test_written_events_come_back(read, spark):
    x = read(a=song(MONO, [meta(3, "Flöte".encode()), *POLY]))
    again = midi.read_events(midi.written_midis(x))
    plain = lambda y: {tuple(r) for r in y.filter(F.col("kind") != "end").drop("place", "velocity").collect()}
    assert plain(again) == plain(x)


def test_files_are_read_once_for_their_tracks(spark, read):
    x = midi.track_rows(read(**{k: song(v[0]) for k, v in CASES.items()}))
    assert x._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert x.count() == len(CASES)


def test_note_facts_of_random_tracks(spark):
    """The facts of a track's rows are those of the rules on notes alone."""
    import random

    from stemloom.operators import planning

    rng = random.Random(3)
    files = {}
    for k in range(40):
        messages = [rng.choice((note, off))(rng.choice((60, 61)), wait=rng.randrange(2)) for _ in range(rng.randrange(1, 9))]
        files[f"f{k}.mid"] = bytearray(song(messages))
    x = midi.read_events(spark.createDataFrame(list(files.items()), "path string, content binary")).cache()
    notes = x.filter("kind in ('on', 'off')").select("path", "place", "tick", "note", (F.col("kind") == "on").alias("is_on"))
    mono = {r.path: r.monophonic for r in planning.note_faults(notes, "path").collect()}
    lasting = {r.path: r.lasting for r in planning.lasting_notes(notes, "path").collect()}
    got = midi.track_rows(x).collect()
    assert {r.path: (r.monophonic, r.lasting) for r in got} == {p: (mono[p], lasting[p]) for p in files}
    assert len({(r.monophonic, r.lasting) for r in got}) == 4
