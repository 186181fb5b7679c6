"""Token counts from pieces of distinct pre-tokens, without any ids."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

LIMIT = 512
#: The most frequent pre-tokens, whose pieces every task knows; the rest are joined.
HEAD = 500_000
#: Distinct pre-tokens that a task counts before it passes its counts on.
FLUSH = 300_000
#: Fixed value: the public pattern of byte-level BPE pre-tokens, with Unicode's white space spelt out.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _tokenizer(path: str):
    """The tokenizer, and a pattern of its special strings, which are one token each in a text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    return t, re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None


def pretokens(text: str | None, special: re.Pattern | None) -> tuple[list[str], int]:
    """The pre-tokens of a text, and the number of special strings in it."""
    if not text:
        return [], 0
    if special is None or not special.search(text):
        return PATTERN.findall(text), 0
    parts = special.split(text)
    return [p for x in parts for p in PATTERN.findall(x)], len(parts) - 1


def portions(texts: list[str], most_chars: int = 1_000_000) -> Iterator[slice]:
    """Slices of a batch that hold about so many characters, so that very long texts don't add up."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= most_chars:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """(pretoken, n, pieces): each distinct pre-token of all texts, counted once into pieces."""
    schema = pa.schema([("pretoken", pa.string()), ("n", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, total = _tokenizer(path)[1], Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                total.update(pretokens(text, special)[0])
                if len(total) >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], schema=schema)
                    total = Counter()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], schema=schema)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)[0]
        for b in batches:
            found = t.encode_batch(b.column("pretoken").to_pylist(), add_special_tokens=False)
            yield b.append_column("pieces", pa.array([len(e.ids) for e in found], pa.int32()))

    counts = docs.select("text").mapInArrow(count, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return counts.mapInArrow(encode, "pretoken string, n long, pieces int")


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of docs (doc_id, text).

    Pieces are counted once for each distinct pre-token of the table. Per-document frequencies of the
    `head` most frequent pre-tokens are summed where the text is read, against a table whose size that
    number bounds; the frequencies of all others are joined with their pieces. Rare pre-tokens have no
    hot keys, and frequent ones are not shuffled.

    Null texts count as empty; special strings in a text are one token each, as the library has it;
    rows with an equal doc_id and text each get a row; an empty table gives an empty result.
    """
    path = path or default_vocabulary()
    docs = docs.select(F.col("`doc_id`").alias("doc_id"), F.coalesce(F.col("`text`"), F.lit("")).alias("text"))
    words = T.checkpointed(vocabulary(docs, path))
    top = words.orderBy(F.desc("n"), "pretoken").limit(head).select("pretoken", "pieces").toArrow()
    known = docs.sparkSession.sparkContext.broadcast((top.column("pretoken").to_pylist(), top.column("pieces").to_pylist()))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, pieces = _tokenizer(path)[1], dict(zip(*known.value, strict=True))
        for b in batches:
            texts, places = b.column("text").to_pylist(), []
            for part in portions(texts):
                at, tokens, times, known_sums = [], [], [], []
                for k in range(part.start, part.stop):
                    found, total = pretokens(texts[k], special)
                    for p, n in Counter(found).items():
                        own = pieces.get(p)
                        if own is None:
                            at.append(k)
                            tokens.append(p)
                            times.append(n)
                        else:
                            total += own * n
                    known_sums.append(total)
                rows = part.stop - part.start
                places = pa.array([*range(part.start, part.stop), *at])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(places), b.column("th").take(places), pa.array([None] * rows + tokens, pa.string()), pa.array([1] * rows + times, pa.int64()), pa.array(known_sums + [0] * len(at), pa.int64())],
                    names=["doc_id", "th", "pretoken", "times", "known"],
                )

    keyed = docs.withColumn("th", F.xxhash64("text"))
    rows = keyed.select("doc_id", "th", "text").mapInArrow(frequencies, f"doc_id {id_type}, th long, pretoken string, times long, known long")
    # rows without a pre-token have no key in common, or all would meet in one task
    salt = F.when(F.col("pretoken").isNull(), F.xxhash64("doc_id", "th")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("salt", salt).join(words.select("pretoken", "pieces", F.lit(0).cast("long").alias("salt")), ["pretoken", "salt"], "left")
    one = F.when(F.col("pretoken").isNull(), 1).otherwise(0)
    sums = rows.groupBy("doc_id", "th").agg(F.sum(F.col("known") + F.coalesce(F.col("times") * F.col("pieces"), F.lit(0))).alias("all"), F.sum(one).alias("rows"))
    sizes = keyed.select("doc_id", "th", F.octet_length("text").cast("long").alias("n_bytes"))
    sums = sums.select(F.col("doc_id").alias("id"), F.col("th").alias("h"), (F.col("all") / F.col("rows")).cast("long").alias("n_tokens"))
    x = sizes.join(sums, sizes["doc_id"].eqNullSafe(sums["id"]) & (sizes["th"] == sums["h"]))
    return x.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(T.documents(spark, sf_dir).select("doc_id", "text"))
