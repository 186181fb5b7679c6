"""Token-id files with a minimal perfect hash index from document keys to their ids."""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text as T

END_ID = 2
#: Ids of a shard at least, unless the task's documents end; a document is never cut. A shard is what a
#: lookup reads, some 64 KB of ids and its index, and so it is a page of its own in the file.
SHARD_IDS = 1 << 15
PAGES = {"parquet.page.row.count.limit": "1", "parquet.page.size": "65536", "parquet.page.size.row.check.min": "1"}
#: Pre-tokens whose ids a worker remembers.
KNOWN = 800_000
#: Room for each key in the bit array of a level.
GAMMA = 1.5
#: One row a shard. Payload and arrays are little-endian; `words`, `ranks` and the rest are the index.
SCHEMA = (
    "part long, seq long, null_keys boolean, first_key long, last_key long, n_docs long, n_ids long, width int, payload binary, "
    "offsets binary, keys binary, levels array<int>, words binary, ranks binary, prints binary, ordinals binary, times binary"
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Characters that normalising to NFC leaves alone and whose lower case doesn't hang on their place.
_PLAIN = r"^[\x09-\x0d\x20-\x7e\x{a1}-\x{ff}]*$"


def _pretokens(spec: dict) -> str | None:
    """The vocabulary's own pattern of pre-tokens, if nothing but NFC and lower case goes before it."""
    steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in parts] != ["Split", "ByteLevel"]:
        return None
    split, by_byte = parts
    if split["behavior"] != "Removed" or not split["invert"] or by_byte["add_prefix_space"] or by_byte["use_regex"]:
        return None
    return split["pattern"]["Regex"]


#: Byte-level models see each byte as a character: the printable ones of Latin-1 as themselves, the others from 256 on.
_ODD_BYTES = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BY_BYTE = {b: 256 + k for k, b in enumerate(_ODD_BYTES)}


def _bools(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


class Encoder:
    """The ids of words. White space never joins pieces here, so words are encoded apart.

    Distinct plain words are cut into pre-tokens by the vocabulary's own pattern; the vocabulary's
    model encodes each distinct pre-token without the steps before it. Other words, and those that may
    hold special strings, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task for each core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        self.width = 2 if t.get_vocab_size() <= 1 << 16 else 4
        code = "H" if self.width == 2 else "I"
        self.pattern = _pretokens(json.loads(t.to_str()))
        #: a run of letters is one pre-token
        self.letters = self.pattern is not None and regex.findall(self.pattern, "a\xe0b\xdfc") == ["a\xe0b\xdfc"]
        self.special = [x.content.lower() for x in t.get_added_tokens_decoder().values()]
        cut = t.model.tokenize

        def pieces(units: list[str]) -> Iterator[bytes]:
            for u in units:
                by_byte = u if u.isascii() and u.isprintable() else u.encode().decode("latin-1").translate(_BY_BYTE)
                yield array(code, [x.id for x in cut(by_byte)]).tobytes()

        self.pieces = T.Memo(pieces, KNOWN)
        whole = lambda words: (array(code, e.ids).tobytes() for e in t.encode_batch_fast(words, add_special_tokens=False))
        self.whole = T.Memo(whole, KNOWN, self.pieces)

    def __call__(self, texts: T.Coded) -> tuple[np.ndarray, np.ndarray]:
        """(ids, starts): the ids of all words, and where each text's begin."""
        dtype, n = f"<u{self.width}", len(texts.words)
        lower = pc.utf8_lower(texts.words)
        plain = np.zeros(n, bool)
        if self.pattern:
            plain = _bools(pc.string_is_ascii(texts.words)).copy()
            rest = np.flatnonzero(~plain)
            plain[rest] = _bools(pc.match_substring_regex(texts.words.take(pa.array(rest)), _PLAIN))
            for s in self.special:
                plain &= ~_bools(pc.match_substring(lower, s))
        odd, cut = texts.words.filter(pa.array(~plain)), lower.filter(pa.array(plain))
        if len(cut):
            mixed = pa.array(~_bools(pc.utf8_is_alpha(cut)) if self.letters else np.ones(len(cut), bool))
            cut = pc.replace_with_mask(cut, mixed, pc.replace_substring_regex(cut.filter(mixed), f"({self.pattern})", r"\1 "))
        units = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(cut))
        found = units.flatten().dictionary_encode()
        whole = self.whole.of(odd.to_pylist())  # first: it may empty the other memo
        self.pieces.add([names := found.dictionary.to_pylist()])
        parts = [self.pieces.known[w] for w in names] + whole
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.width
        # each word as a row of codes of parts: its pre-tokens', or its own
        times = np.ones(n, np.int64)
        times[plain] = pc.list_value_length(units).to_numpy(zero_copy_only=False)
        codes = np.empty(int(times.sum()), np.int64)
        own = np.repeat(plain, times)
        codes[own], codes[~own] = found.indices.to_numpy(), np.arange(len(whole)) + len(names)
        ids, each = T.spread(codes, size, np.frombuffer(b"".join(parts), dtype))
        ends = np.append(0, np.cumsum(each))[np.append(0, np.cumsum(times))]
        return texts.spread(np.diff(ends), ids)


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys, as levels of bit arrays with ranks.

    At each level keys that hash to a bit of their own set it; the others go to the next. A key's
    number is the rank of its bit, so numbers run from 0 without a gap.
    """

    def __init__(self, levels: list[int], words: np.ndarray, ranks: np.ndarray):
        self.levels, self.words, self.ranks = levels, words, ranks

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, bits, left = [], [], keys
        while len(left):
            size = -(-max(64, int(GAMMA * len(left))) // 64) * 64
            at = _hash(left, len(levels) + 1) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(size)
            bits.append(alone)
            left = left[~alone[at.astype(np.int64)]]
            if len(levels) > 200:
                raise ValueError("the keys are not distinct")
        all_bits = np.concatenate([*bits, np.zeros(0, bool)])
        words = np.packbits(all_bits, bitorder="little").view("<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1].astype("<u4") if len(words) else np.empty(0, "<u4")
        return cls(levels, words, ranks)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys; -1 for some keys that are not in the set, any number for others."""
        out = np.full(len(keys), -1, np.int64)
        todo, base = np.arange(len(keys)), 0
        for k, size in enumerate(self.levels):
            if not len(todo):
                break
            at = base + (_hash(keys[todo], k + 1) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[here]] = (self.ranks[at >> 6].astype(np.int64) + below)[here]
            todo, base = todo[~here], base + size
        return out


def _print(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 0) >> np.uint64(32)).astype("<u4")


def _shard(part: int, seq: int, keys: list[int | None], payload: list[bytes], width: int) -> dict:
    """One shard's row of documents in key order; equal keys stand together and share an entry."""
    null = keys[0] is None
    k = np.zeros(len(keys), np.int64) if null else np.asarray(keys, np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(p) // width for p in payload])]).astype("<u8")
    distinct, first, times = np.unique(k, return_index=True, return_counts=True)
    mph = PerfectHash.build(distinct.view(np.uint64))
    at = mph(distinct.view(np.uint64))
    prints, ordinals, many = np.empty(len(at), "<u4"), np.empty(len(at), "<u4"), np.empty(len(at), "<u4")
    prints[at], ordinals[at], many[at] = _print(distinct.view(np.uint64)), first, times
    return {
        "part": part, "seq": seq, "null_keys": null, "first_key": None if null else int(k[0]), "last_key": None if null else int(k[-1]),
        "n_docs": len(keys), "n_ids": int(offsets[-1]), "width": width, "payload": b"".join(payload), "offsets": offsets.tobytes(),
        "keys": k.astype("<i8").tobytes(), "levels": mph.levels, "words": mph.words.tobytes(), "ranks": mph.ranks.tobytes(),
        "prints": prints.tobytes(), "ordinals": ordinals.tobytes(), "times": many.tobytes(),
    }


class Reader:
    """One shard, opened: keyed access to its documents' ids."""

    def __init__(self, row: dict):
        self.null, self.ids = row["null_keys"], np.frombuffer(row["payload"], f"<u{row['width']}")
        self.offsets, self.keys = np.frombuffer(row["offsets"], "<u8").astype(np.int64), np.frombuffer(row["keys"], "<i8")
        self.mph = PerfectHash(list(row["levels"]), np.frombuffer(row["words"], "<u8"), np.frombuffer(row["ranks"], "<u4"))
        self.prints, self.ordinals, self.times = (np.frombuffer(row[c], "<u4") for c in ("prints", "ordinals", "times"))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first document, number of documents) of each key; number 0 where the fingerprint says it isn't here."""
        k = keys.view(np.uint64)
        at = self.mph(k)
        known = at >= 0
        known[known] = self.prints[at[known]] == _print(k[known])
        safe = np.where(known, at, 0)
        return self.ordinals[safe].astype(np.int64), np.where(known, self.times[safe].astype(np.int64), 0)

    def document(self, ordinal: int) -> np.ndarray:
        return self.ids[self.offsets[ordinal] : self.offsets[ordinal + 1]]


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of `docs` (doc_id, text) in ascending doc_id order, in shards with an index.

    Null texts count as empty, and so hold the end id alone; null doc_ids come first, in shards of
    their own; repeated doc_ids are documents of their own under one index entry, in the order of
    their text's hash. An empty table writes no shard. Every shard is one row of a Parquet table, so
    any store that Spark writes to will do, and lost tasks are simply run again.
    """
    vocabulary = vocabulary or default_vocabulary()
    end = np.uint32(end_id)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        width = encoder.width
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        payload: list[bytes] = []
        tail = end.astype(f"<u{width}").tobytes()
        schema = pa.schema(
            [("part", pa.int64()), ("seq", pa.int64()), ("null_keys", pa.bool_()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("payload", pa.binary()), ("offsets", pa.binary()), ("keys", pa.binary()), ("levels", pa.list_(pa.int32()))]
            + [(c, pa.binary()) for c in ("words", "ranks", "prints", "ordinals", "times")]
        )
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for portion, texts in T.coded(b.column("text"), 12_000_000):
                values, starts = encoder(texts)
                for key, a, z in zip(ids[portion], starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    if keys and (held >= SHARD_IDS or (keys[-1] is None) != (key is None)):
                        yield pa.RecordBatch.from_pylist([_shard(part, seq, keys, payload, width)], schema)
                        keys, payload, held, seq = [], [], 0, seq + 1
                    keys.append(key)
                    payload.append(values[a:z].tobytes() + tail)
                    held += z - a + 1
        if keys:
            yield pa.RecordBatch.from_pylist([_shard(part, seq, keys, payload, width)], schema)

    x = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text")).withColumn("th", F.xxhash64("text"))
    x = x.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    x.mapInArrow(pack, SCHEMA).write.options(compression="zstd", **PAGES).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, by way of the index and the raw payload."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                r = Reader(row)
                first, times = r.find(np.unique(r.keys))
                at = np.concatenate([np.arange(a, a + n) for a, n in zip(first, times, strict=True)])
                crc = [zlib.crc32(r.document(k).astype("<u4").tobytes()) for k in at]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([row["part"]] * len(at), pa.int64()),
                        "seq": pa.array([row["seq"]] * len(at), pa.int64()),
                        "doc_id": pa.array([None] * len(at) if r.null else r.keys[at], pa.int64()),
                        "within": r.offsets[at],
                        "n_tokens": r.offsets[at + 1] - r.offsets[at],
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    shards = spark.read.schema(SCHEMA).parquet(path)
    sizes = shards.select("part", "seq", "n_ids")
    up = W.unboundedPreceding
    in_part = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(up, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each task that wrote
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(up, -1)), F.lit(0)).alias("before"))
    base = sizes.select("part", "seq", in_part.alias("in_part")).join(parts, "part").select("part", "seq", (F.col("before") + F.col("in_part")).alias("base"))
    rows = shards.mapInArrow(scan, "part long, seq long, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents with one of a few keys.

    The first and last keys of shards, two numbers each, tell which shards can hold one; of these alone,
    a page of the file each, the index and the ids are read. Up to ten such shards are found by the file's
    own page index.
    """
    wanted = np.asarray(sorted({int(k) for k in keys}), np.int64)
    if not len(wanted):
        return spark.createDataFrame([], "doc_id long, ids array<long>")

    def holding(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, last = b.column("first_key").to_numpy(), b.column("last_key").to_numpy()
            some = np.searchsorted(wanted, first, "left") < np.searchsorted(wanted, last, "right")
            yield b.select(["first_key"]).filter(pa.array(some))

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                r = Reader(row)
                first, times = r.find(wanted)
                found = [(int(key), r.document(a + i).astype(np.int64)) for key, a, n in zip(wanted, first, times, strict=True) for i in range(n)]
                found = [(key, ids) for key, ids in found if row["first_key"] <= key <= row["last_key"]]
                if found:
                    yield pa.RecordBatch.from_pydict({"doc_id": [f[0] for f in found], "ids": [f[1] for f in found]}, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    shards = spark.read.schema(SCHEMA).parquet(path).filter("not null_keys")
    heads = shards.filter((F.col("first_key") <= int(wanted[-1])) & (F.col("last_key") >= int(wanted[0]))).select("first_key", "last_key")
    at = [r.first_key for r in heads.mapInArrow(holding, "first_key long").distinct().collect()]  # no more than the keys
    return shards.filter(F.col("first_key").isin(at)).mapInArrow(fetch, "doc_id long, ids array<long>")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = T.shared_folder(spark, "token-index")
    write(T.documents(spark, sf_dir), path)
    return read(spark, path)
