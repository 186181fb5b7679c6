"""MIDI files as event rows, facts of their tracks, and corrected files written back."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from stemloom.functions import exprs as X
from stemloom.operators import planning

#: Events of files: kind is on, off, program (its number in note), name (in text), channel (the track's first channel message) or end.
EVENTS = "path string, track int, place int, tick long, kind string, channel int, note int, velocity int, text string"
_COLUMNS = [c.split()[0] for c in EVENTS.split(", ")]
#: Meta events that tell a file's time and key, in the order in which they are written.
CONDUCTOR = {0x51: "set_tempo", 0x58: "time_signature", 0x59: "key_signature", 0x54: "smpte_offset"}
DRUMS = 9
#: About how many events go into one batch: small files share one.
ROWS = 20_000
#: A corrected file's tracks, in their order.
TRACKS = "array<struct<track:int,original_track:int,program:int,is_drum:boolean,name:string>>"


def _number(data: bytes, at: int) -> tuple[int, int]:
    n = 0
    while True:
        b = data[at]
        n, at = n << 7 | b & 0x7F, at + 1
        if b < 0x80:
            return n, at


def _varied(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def messages(data: bytes) -> tuple[bytes, list[list[tuple[int, int, bytes]]]]:
    """(time division, tracks of (ticks since the last message, status, data)) of a standard MIDI file.

    Running status is written out; a meta message's data begins with its type. ValueError for what is no
    such file, or ends too early.
    """
    if data[:4] != b"MThd" or len(data) < 14:
        raise ValueError("no MIDI file")
    at, tracks = 8 + int.from_bytes(data[4:8], "big"), []
    try:
        while at + 8 <= len(data):
            kind, pos, size = data[at : at + 4], at + 8, int.from_bytes(data[at + 4 : at + 8], "big")
            at = end = pos + size
            if kind != b"MTrk":
                continue
            if end > len(data):
                raise ValueError("a track ends too early")
            track, status = [], 0
            while pos < end:
                wait, pos = _number(data, pos)
                if data[pos] >= 0x80:
                    status, pos = data[pos], pos + 1
                if status in (0xF0, 0xF7, 0xFF):
                    first = pos
                    pos += status == 0xFF
                    n, pos = _number(data, pos)
                    track.append((wait, status, data[first : first + 1] * (status == 0xFF) + data[pos : pos + n]))
                    pos += n
                elif status >= 0x80:
                    n = 1 if status >> 4 in (12, 13) else 2
                    track.append((wait, status, data[pos : pos + n]))
                    pos += n
                else:
                    raise ValueError("a message without a status")
            tracks.append(track)
    except IndexError:
        raise ValueError("a message ends too early") from None
    return data[12:14], tracks


def events(data: bytes) -> Iterator[tuple]:
    """(track, place, tick, kind, channel, note, velocity, text) of a file's notes, programs, names and ends."""
    for k, track in enumerate(messages(data)[1]):
        tick, channel, place = 0, None, 0
        for place, (wait, status, x) in enumerate(track):
            tick += wait
            if status == 0xFF:
                if x[:1] == b"\3":
                    yield k, place, tick, "name", None, None, None, x[1:].decode("utf-8", "replace")
            elif status < 0xF0:
                if channel is None:
                    channel = status & 15
                    yield k, place, tick, "channel", channel, None, None, None
                op = status >> 4
                if op in (8, 9):
                    yield k, place, tick, "on" if op == 9 and x[1] else "off", status & 15, x[0], x[1], None
                elif op == 12:
                    yield k, place, tick, "program", status & 15, x[0], None, None
        yield k, place + 1, tick, "end", None, None, None, None


def midi_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the MIDI files under a path."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", "*.mid").option("recursiveFileLookup", True).load(path)
    return x.select("path", "content")


def read_events(files: DataFrame) -> DataFrame:
    """The events of files (path, content), a row each, with absolute ticks; a file that is none has no rows."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_COLUMNS).astype({"channel": "Int32", "note": "Int32", "velocity": "Int32"})

    def parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(p, *e) for e in events(bytes(data))]
                except (ValueError, TypeError):
                    continue
                if len(rows) >= ROWS:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)

    return files.select("path", "content").mapInPandas(parse, EVENTS)


def track_rows(events: DataFrame) -> DataFrame:
    """A row for each track, empty ones too: the last name and program, drums by the first channel message.

    `sounds_drums` is true where any sounding note is on the drum channel, whatever came first; notes
    that sound, whether any lasts, and whether never two sound at a time come from the notes themselves.
    """
    kind = F.col("kind")
    last = lambda k, c: F.max_by(F.when(kind == k, F.col(c)), F.when(kind == k, F.col("place")))
    # files are read once, and a track's events meet once: windows and groups below need no other shuffle
    events = planning.with_note_facts(events.repartition("path", "track"), ["path", "track"], "place", kind == "on", kind.isin("on", "off"))
    x = events.groupBy("path", "track").agg(
        X.sanitize_name(last("name", "text")).alias("name"),
        F.coalesce(last("program", "note"), F.lit(0)).alias("program"),
        F.coalesce(F.max(F.when(kind == "channel", F.col("channel") == DRUMS)), F.lit(False)).alias("is_drum"),
        F.coalesce(F.max(F.when(kind == "on", F.col("channel") == DRUMS)), F.lit(False)).alias("sounds_drums"),
        F.sum((kind == "on").cast("int")).cast("long").alias("notes"),
        F.max("tick").alias("ticks"),
        F.max("_lasts").alias("lasting"),
        (~F.max("_fault")).alias("monophonic"),
    )
    return x


def file_is_monophonic(events: DataFrame) -> DataFrame:
    """(path, monophonic): all tracks of a file on one time line, in the order of ticks, then tracks."""
    kind = F.col("kind")
    notes = events.filter(kind.isin("on", "off")).select("path", F.struct("tick", "track", "place").alias("place"), "note", (kind == "on").alias("is_on"))
    found = planning.note_faults(notes, "path")
    return events.select("path").distinct().join(found, "path", "left").select("path", F.coalesce("monophonic", F.lit(True)).alias("monophonic"))


def routed(tracks: DataFrame) -> DataFrame:
    """Track rows with route (backend, instrument, reason), the notes taken into account."""
    notes = {c: F.col(c) for c in ("notes", "lasting", "monophonic")}
    return tracks.withColumn("route", X.route(F.col("program"), F.col("is_drum") | F.col("sounds_drums"), F.col("name"), **notes))


def _chunk(track: Sequence[tuple[int, int, bytes]]) -> bytes:
    out = bytearray()
    for wait, status, x in track:
        out += _varied(wait)
        out.append(status)
        if status == 0xFF:
            out += x[:1] + _varied(len(x) - 1) + x[1:]
        else:
            out += (_varied(len(x)) if status >= 0xF0 else b"") + x
    return b"MTrk" + len(out).to_bytes(4, "big") + bytes(out)


def file_of(division: bytes, tracks: Sequence[Sequence[tuple[int, int, bytes]]]) -> bytes:
    """A standard MIDI file of tracks of messages; each track gets an end if it has none."""
    chunks = []
    for t in tracks:
        body = [m for m in t if not (m[1] == 0xFF and m[2][:1] == b"\x2f")]
        wait = sum(m[0] for m in t) - sum(m[0] for m in body)
        chunks.append(_chunk([*body, (wait, 0xFF, b"\x2f")]))
    return b"MThd" + (6).to_bytes(4, "big") + (1).to_bytes(2, "big") + len(chunks).to_bytes(2, "big") + division + b"".join(chunks)


def corrected(data: bytes, programs: dict[int, int]) -> tuple[bytes | None, list[tuple[int, int, int, bool, str | None]]]:
    """(file, rows): the tracks that have notes, with their programs corrected, and where each was.

    `programs` is by original track. Time and key events of the first track that has them stand at the
    beginning of each track, so each can be played alone. A track without a program change gets one. A
    file without a note gives None.
    """
    division, tracks = messages(data)
    first: dict[int, tuple[int, int, bytes]] = {}
    for t in tracks:
        for _, status, x in t:
            if status == 0xFF and x and x[0] in CONDUCTOR:
                first.setdefault(x[0], (0, status, x))
        if len(first) == len(CONDUCTOR):
            break
    prefix = [first[k] for k in CONDUCTOR if k in first]
    out, rows = [], []
    for k, t in enumerate(tracks):
        sounding = [s & 15 for _, s, x in t if s >> 4 == 9 and x[1]]
        if not sounding:
            continue
        drums = DRUMS in sounding
        own = [x[0] for _, s, x in t if s >> 4 == 12]
        program = programs.get(k, own[-1] if own else 0)
        track = [*prefix, *[(w, s, bytes([program]) if s >> 4 == 12 else x) for w, s, x in t]]
        if not own:
            channels = [s & 15 for _, s, _ in t if s < 0xF0]
            track.insert(0, (0, 0xC0 | channels[-1], bytes([program])))
        name = next((x[1:].decode("utf-8", "replace") for _, s, x in t if s == 0xFF and x[:1] == b"\3"), None)
        rows.append((len(out), k, program, drums, " ".join(name.replace("\0", "").replace(",", " ").split()) or None if name else None))
        out.append(track)
    return (file_of(division, out) if out else None), rows


def corrected_midis(files: DataFrame, register: DataFrame) -> DataFrame:
    """(path, content, tracks, ok) of each file (path, content) that the register (path, track, program_corrected) names.

    A file without notes has no content; one that can't be read isn't ok.
    """
    by_file = register.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("track", "program_corrected"))).alias("programs"))

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("track", "original_track", "program", "is_drum", "name")
        for b in batches:
            rows = []
            for p, data, programs in zip(b["path"], b["content"], b["programs"], strict=True):
                try:
                    content, tracks = corrected(bytes(data), {int(t): int(v) for t, v in programs.items() if v is not None})
                    rows.append((p, content, [dict(zip(names, t, strict=True)) for t in tracks], True))
                except (ValueError, TypeError):
                    rows.append((p, None, [], False))
            yield pd.DataFrame(rows, columns=["path", "content", "tracks", "ok"])

    x = files.select("path", "content").join(by_file, "path")
    return x.mapInPandas(write, f"path string, content binary, tracks {TRACKS}, ok boolean")


def written_midis(events: DataFrame, ticks_per_beat: int = 480) -> DataFrame:
    """(path, content): MIDI files of event rows, a group a file; names and programs stand before the notes of their tick."""

    make = {
        "on": lambda channel, note, velocity, text: (0x90 | channel, bytes([note, velocity])),
        "off": lambda channel, note, velocity, text: (0x80 | channel, bytes([note, 0])),
        "program": lambda channel, note, velocity, text: (0xC0 | channel, bytes([note])),
        "name": lambda channel, note, velocity, text: (0xFF, b"\3" + text.encode()),
        "end": lambda channel, note, velocity, text: (0xFF, b"\x2f"),
    }

    def write(t: pa.Table) -> pa.Table:
        tracks: dict[int, list] = {}
        now: dict[int, int] = {}
        for k, _, tick, kind, *x in sorted(zip(*[t[c].to_pylist() for c in _COLUMNS[1:]], strict=True), key=itemgetter(0, 1)):
            track = tracks.setdefault(k, [])
            if kind in make:
                track.append((tick - now.get(k, 0), *make[kind](*x)))
                now[k] = tick
        content = file_of(ticks_per_beat.to_bytes(2, "big"), list(tracks.values()))
        return pa.table({"path": t["path"].slice(0, 1), "content": pa.array([content], pa.binary())})

    return events.groupBy("path").applyInArrow(write, "path string, content binary")


class _Staged(WriterCommitMessage):
    """A task's folder of finished files."""

    def __init__(self, folder: str):
        self.folder = folder


class _FilesWriter(DataSourceWriter):
    """Each attempt of a task writes to a folder of its own; the commit moves those of the attempts that count."""

    def __init__(self, base: str):
        self.base, self.staging = base, f"{base.rstrip('/')}/.staging-{uuid.uuid4().hex}"

    @staticmethod
    def _store(path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        store, root = self._store(folder)
        for r in iterator:
            parts = r["path"].split("/")
            if r["path"].startswith("/") or ".." in parts or "" in parts:
                raise ValueError(f"not a path below the folder: {r['path']}")
            if r["content"] is None:
                continue
            store.create_dir("/".join([root, *parts[:-1]]), recursive=True)
            with store.open_output_stream("/".join([root, *parts])) as out:
                out.write(bytes(r["content"]))
        return _Staged(folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, base = self._store(self.base)
        store.create_dir(base, recursive=True)
        for m in messages:
            if m is None:
                continue
            root = self._store(m.folder)[1]
            for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
                if f.type == fs.FileType.File:
                    to = f"{base}/{f.path[len(root) + 1 :]}"
                    store.create_dir(to.rpartition("/")[0], recursive=True)
                    store.move(f.path, to)  # whole files appear one after another; none is ever half written
        self._clear(store)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(self._store(self.base)[0])

    def _clear(self, store) -> None:
        root = self._store(self.staging)[1]
        from pyarrow import fs

        if store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir(root)


class FileSink(DataSource):
    """Rows (path, content) as files below a folder that driver and executors share: format("stem_files").

    Paths are relative; rows without content write nothing; a file of the same name is replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "stem_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not {"path", "content"} <= set(schema.names):
            raise ValueError("stem_files takes rows (path, content)")
        return _FilesWriter(self.options["path"])


def write_files(df: DataFrame, folder: str) -> None:
    df.sparkSession.dataSource.register(FileSink)
    df.select("path", "content").write.format(FileSink.name()).mode("append").save(folder)
