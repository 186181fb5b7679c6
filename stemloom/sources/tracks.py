"""A source of track folders below splits: a partition for each few folders, and a saved result that spares the scan."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stemloom.sources import files

# The splits of a corpus, and the one that only some counts take.
SPLITS, OMITTED = ("train", "validation", "test"), "omitted"
TRACKS = "track string, split string, n_stems int, duration_sec double"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def stem_count(text: str) -> int:
    """Stems of a track's metadata that were rendered; all of them if none says so.

    Reads the entries under `stems:` and, of each, the line `audio_rendered:`; nothing else of the file.
    """
    rendered: list[bool] = []
    inside, entry = False, None
    for line in text.splitlines():
        bare = line.split("#", 1)[0].rstrip()
        if not bare.strip():
            continue
        depth = len(bare) - len(bare.lstrip())
        if depth == 0:
            inside, entry = bare.startswith("stems:"), None
        elif inside:
            entry = depth if entry is None else entry
            if depth == entry:
                rendered.append(True)
            elif bare.strip().replace(" ", "").lower() in ("audio_rendered:false", "audio_rendered:no"):
                rendered[-1] = False
    return sum(rendered) or len(rendered)


def flac_duration(head: bytes) -> float | None:
    """Seconds by a FLAC file's first 26 bytes."""
    if head[:4] != b"fLaC" or len(head) < 26:
        return None
    rate, frames = int.from_bytes(head[18:21], "big") >> 4, int.from_bytes(head[21:26], "big") & (1 << 36) - 1
    return frames / rate if rate and frames else None


class _Folders(InputPartition):
    def __init__(self, split: str, names: list[str]):
        super().__init__(split)
        self.split, self.names = split, names


class _TrackReader(DataSourceReader):
    def __init__(self, path: str, omitted: bool, folders: int):
        self.path, self.omitted, self.folders = path, omitted, folders

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _store(self.path)
        out: list[InputPartition] = []
        for split in (*SPLITS, *([OMITTED] if self.omitted else [])):
            found = store.get_file_info(fs.FileSelector(f"{root}/{split}", allow_not_found=True))
            names = sorted(f.base_name for f in found if f.type == fs.FileType.Directory)
            out += [_Folders(split, names[k : k + self.folders]) for k in range(0, len(names), self.folders)]
        return out or [_Folders("", [])]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        from pyarrow import fs

        store, root = _store(self.path)
        for name in partition.names:
            meta, mix = (f"{root}/{partition.split}/{name}/{f}" for f in ("metadata.yaml", "mix.flac"))
            if any(f.type != fs.FileType.File for f in store.get_file_info([meta, mix])):
                continue
            with store.open_input_stream(meta) as f:
                count = stem_count(f.read().decode("utf-8", "replace"))
            with store.open_input_stream(mix) as f:
                seconds = flac_duration(f.read(26))
            if seconds is not None:
                yield name, partition.split, count, seconds


class TrackFolders(DataSource):
    """Tracks below `path`/split, a row for each folder with metadata and a mix: format("track_folders")."""

    @classmethod
    def name(cls) -> str:
        return "track_folders"

    def schema(self) -> str:
        return TRACKS

    def reader(self, schema) -> DataSourceReader:
        return _TrackReader(self.options["path"], self.options.get("omitted", "true").lower() == "true", int(self.options.get("folders", "64")))


def read_tracks(spark: SparkSession, path: str, omitted: bool = True, saved: str | None = None) -> DataFrame:
    """Track rows of a corpus; `saved` names a table that is read if it is there, else written.

    A saved table holds for one setting of `omitted`; the folders aren't looked at while it is there.
    """
    if saved and files.exists(spark, saved):
        return spark.read.schema(TRACKS).json(saved)
    spark.dataSource.register(TrackFolders)
    x = spark.read.format(TrackFolders.name()).option("omitted", str(omitted).lower()).load(path)
    if not saved:
        return x
    files.write_json(x, saved)
    return spark.read.schema(TRACKS).json(saved)
