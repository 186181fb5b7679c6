"""Language-model scores by deleted interpolation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import text as T

FOLDS, SCORED_FOLD, HELD_FOLD = 5, 1, 2
#: Words among which every task counts and knows all pairs, the most frequent ones. Other pairs are dealt out.
VOCABULARY = 2_048
#: Words whose counts every task knows; the counts of the others are joined.
HEAD = 500_000
#: Tokens that one piece of the dealt pairs has on average, and tokens after which a task deals.
PIECE, DEALT = 3_000_000, 2_000_000
#: Context counts from a power of two on share their mixture weights.
BUCKETS = 48
EM_ROUNDS = 12
#: Names in the tables: no word is empty.
END = ""


def _code(word: str) -> int:
    """As Spark's xxhash64."""
    return xxhash.xxh64_intdigest(word.encode(), 42)


def _fold(doc_id: Column) -> Column:
    """The remainder that decides: of crc32 of the id's text; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _coded(column: pa.Array) -> Iterator[tuple[slice, T.Coded]]:
    T.Memo.clear()
    return T.coded(pc.ascii_lower(column.cast(pa.string())), 12_000_000)  # A-Z only


def unigrams(train: DataFrame) -> DataFrame:
    """(word, c, held): counts of training tokens, and of those in the held-out part of them."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column("held").to_numpy(zero_copy_only=False)
            for part, x in _coded(b.column("text")):
                own = held[part]
                c = np.bincount(x.codes, minlength=len(x.words))
                h = np.bincount(x.codes, np.repeat(own, np.diff(x.starts)), len(x.words)).astype(np.int64)
                words = pa.concat_arrays([x.words, pa.array([END])])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.append(c, len(own))), pa.array(np.append(h, own.sum()))], names=["word", "c", "held"])

    x = train.select("text", "held").mapInArrow(count, "word string, c long, held long")
    return x.groupBy("word").agg(F.sum("c").alias("c"), F.sum("held").alias("held"))


class Lexicon:
    """Numbers of the head's words, the end and then by frequency, with counts in all training tokens and in the rest.

    Numbers start with 1; 0 is the start of a text, which as a context is as frequent as the end. The
    first numbers are the vocabulary's. Words beyond the head have no number, here -1.
    """

    def __init__(self, words: list[str], counts: list[int], held: list[int], vocabulary: int, tokens: int, kinds: int):
        start = 0 if words and words[0] == END else None
        self.words = words
        self.counts = np.array([0 if start is None else counts[0], *counts], np.int64)
        self.rest = self.counts - np.array([0 if start is None else held[0], *held], np.int64)
        self.vocabulary, self.tokens, self.kinds = min(vocabulary, len(words)), tokens, kinds
        #: A pair is one number: context times this plus word.
        self.width = len(words) + 1
        self.key_bytes = max(1, ((self.width**2 - 1).bit_length() + 7) // 8)

    def open(self) -> None:
        if not hasattr(self, "number"):
            self.number = {w: k for k, w in enumerate(self.words, 1)}

    def dense(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (h >= 0) & (h <= self.vocabulary) & (w >= 0) & (w <= self.vocabulary)


def _zip(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True)


def _unzip(b: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def encoded(docs: DataFrame, lexicon: Broadcast) -> DataFrame:
    """(uid, doc_id, fold, n, ids, rare) of each row: numbers of the words and the end, hashes of those without."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        lex.open()
        get, end = lex.number.get, lex.number.get(END, -1)
        for b in batches:
            for part, x in _coded(b.column("text")):
                words = x.words.to_pylist()
                number = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
                code = np.zeros(len(words), np.uint64)
                for k in np.flatnonzero(number < 0):
                    code[k] = _code(words[k])
                ids, rare = [], []
                for u, v in pairwise(x.starts.tolist()):
                    own = x.codes[u:v]
                    ids.append(_zip(np.append(number[own], np.int32(end))))
                    rare.append(code[own[number[own] < 0]].tobytes() + (b"" if end >= 0 else _code(END).to_bytes(8, "little")))
                own = b.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in ("uid", "doc_id", "fold")], pa.array((np.diff(x.starts) + 1).astype(np.int32)), pa.array(ids, pa.binary()), pa.array(rare, pa.binary())], names=["uid", "doc_id", "fold", "n", "ids", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("uid", "doc_id", "fold", "text").mapInArrow(encode, f"uid long, doc_id {kind}, fold int, n int, ids binary, rare binary")


def _portions(batches: Iterable[pa.RecordBatch], most: int = 500_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, place of each token's row among them, context, word)."""
    for b in batches:
        n = b.column("n").to_numpy()
        cut = np.cumsum(n) // most
        for k in np.unique(cut):
            own = b.filter(pa.array(cut == k))
            size = own.column("n").to_numpy().astype(np.int64)
            w = np.concatenate([_unzip(x, m, np.int32) for x, m in zip(own.column("ids").to_pylist(), size, strict=True)]).astype(np.int64)
            h = np.append(0, w[:-1])
            h[np.cumsum(size) - size] = 0
            yield own, np.repeat(np.arange(len(size)), size), h, w


def bigrams(train: DataFrame, lexicon: Broadcast) -> DataFrame:
    """(h, w, c, held): counts of pairs within the vocabulary; no more rows than its square."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        found: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            key, c = np.unique(np.concatenate(found), return_counts=True)
            pair, held = key // 2, key % 2
            return pa.RecordBatch.from_pydict({"h": pa.array(pair // lex.width, pa.int32()), "w": pa.array(pair % lex.width, pa.int32()), "c": pa.array(c, pa.int64()), "held": pa.array(c * held, pa.int64())})

        for own, row, h, w in _portions(batches):
            held = (own.column("fold").to_numpy() == HELD_FOLD)[row]
            on = lex.dense(h, w)
            found.append((h[on] * lex.width + w[on]) * 2 + held[on])
            size += len(found[-1])
            if size >= 8_000_000:
                yield out()
                found, size = [], 0
        if found:
            yield out()

    x = train.select("fold", "n", "ids").mapInArrow(count, "h int, w int, c long, held long")
    return x.groupBy("h", "w").agg(F.sum("c").alias("c"), F.sum("held").alias("held"))


def dealt(docs: DataFrame, lexicon: Broadcast, pieces: int, n_rest: int) -> DataFrame:
    """(piece, base, tokens, runs, keys, places, counts, held): pairs of the head beyond the vocabulary, and their training counts.

    All tokens of a pair come to one piece. One of a pair's words is beyond the vocabulary, so no pair
    has more than one of VOCABULARY parts of the tokens. Tokens travel as packed arrays with the run lengths
    of their rows: uid - base, times 4, plus 0 for the rest, 1 for scored and 2 for held-out rows. One line
    of each piece has in `held` what the piece's held-out tokens get, as `_held` has it.
    """
    lex = lexicon.value
    size, width = lex.key_bytes, lex.width

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, base, total = [], [], None, 0

        def out() -> pa.RecordBatch:
            key, row = np.concatenate(keys), np.concatenate(rows)
            piece = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(pieces)).astype(np.int64)
            order = np.argsort(piece, kind="stable")
            key, row = key[order], row[order]
            found, first = np.unique(piece[order], return_index=True)
            lines = []
            for p, a, b in zip(found.tolist(), first, np.append(first[1:], len(key)), strict=True):
                at = np.flatnonzero(np.diff(row[a:b], prepend=-1))
                places = np.stack([np.diff(row[a:b][at], prepend=0), np.diff(at, append=b - a)])
                lines.append((p, base, b - a, len(at), np.ascontiguousarray(key[a:b].view(np.uint8).reshape(-1, 8)[:, :size]).tobytes(), _zip(places)))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*lines, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["piece", "base", "tokens", "runs", "keys", "places"])

        for own, row, h, w in _portions(batches):
            uid, fold = own.column("uid").to_numpy(), own.column("fold").to_numpy()
            base = int(uid[0]) if base is None else base
            part = np.where(fold == SCORED_FOLD, 1, np.where(fold == HELD_FOLD, 2, 0))
            on = (h >= 0) & (w >= 0) & ~lex.dense(h, w)
            keys.append(h[on] * lex.width + w[on])
            rows.append(((uid - base) * 4 + part)[row[on]])
            total += len(keys[-1])
            if total >= DEALT:
                yield out()
                keys, rows, base, total = [], [], None, 0
        if total:
            yield out()

    def meet(t: pa.Table) -> pa.Table:
        key = _keys(t, size)
        _, at = np.unique(key, return_inverse=True)
        part = np.concatenate([np.repeat(row & 3, n) for row, n in _places(t)])
        c = np.bincount(at, part != 1).astype(np.int64)[at]
        ends = np.cumsum(t.column("tokens").to_numpy())
        u, first, n = np.unique(key[part == 2], return_index=True, return_counts=True)
        m, h, w, rest = lexicon.value, u // width, u % width, c[part == 2][first] - n
        held = _held(_buckets(m.counts[h]), rest / np.maximum(m.rest[h], 1), m.rest[w] / max(n_rest, 1), n).tobytes()
        t = t.append_column("counts", pa.array([_zip(x) for x in np.split(c, ends[:-1])], pa.binary()))
        return t.append_column("held", pa.array([held] + [None] * (len(t) - 1), pa.binary()))

    x = docs.select("uid", "fold", "n", "ids").mapInArrow(deal, "piece int, base long, tokens int, runs int, keys binary, places binary")
    return x.groupBy("piece").applyInArrow(meet, "piece int, base long, tokens int, runs int, keys binary, places binary, counts binary, held binary")


def _keys(t: pa.Table, size: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.uint8).reshape(-1, size)
    out = np.zeros((len(packed), 8), np.uint8)
    out[:, :size] = packed
    return out.view(np.int64).ravel()


def _places(t: pa.Table | pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, tokens) of the runs of each line."""
    for x, n in zip(t.column("places").to_pylist(), t.column("runs").to_pylist(), strict=True):
        row, times = _unzip(x, 2 * n, np.int64).reshape(2, n)
        yield np.cumsum(row), times


def _line(t: pa.RecordBatch, k: int, lex: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, tokens in it, pair, its context's number, its count) of one line of dealt()."""
    t = t.slice(k, 1)
    row, times = next(_places(t))
    key = _keys(t, lex.key_bytes)
    return row, times, key, key // lex.width, _unzip(t.column("counts")[0].as_py(), len(key), np.int64)


def rare(docs: DataFrame, words: DataFrame, lexicon: Broadcast) -> DataFrame:
    """(uid, kind, h, w, c, held, ac, ar, hc, hr): tokens that are beyond the head, or that follow such a word.

    h, w: the context and the word by number, 0 beyond the head. kind: 4 times the fold, plus
    2 where the context and 1 where the word is beyond the head. c, held: counts of the pair; ac, ar: of
    the word or else the context that is beyond the head, in all training tokens and in the rest; hc, hr:
    of the context, where both are. Counts of the other words are at hand. All tokens that a word beyond
    the head is part of meet at that word, which is no hot key as the head has all words that are more
    frequent; few tokens have two such words, and the counts of their contexts are joined.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row, h, w in _portions(batches):
            at = np.flatnonzero((h < 0) | (w < 0))
            code = w.copy()
            code[w < 0] = np.frombuffer(b"".join(b.column("rare").to_pylist()), np.int64)
            before = np.where(h < 0, np.append(0, code[:-1]), h)
            kind = b.column("fold").to_numpy()[row[at]] * 4 + (h[at] < 0) * 2 + (w[at] < 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (b.column("uid").to_numpy()[row[at]], kind.astype(np.int32), before[at], code[at])], names=["uid", "kind", "h", "w"])

    x = docs.select("uid", "fold", "n", "ids", "rare").mapInArrow(read, "uid long, kind int, h long, w long")
    own, fold = F.col("kind") % 2 == 1, F.floor(F.col("kind") / 4)
    x = x.withColumn("a", F.when(own, F.col("w")).otherwise(F.col("h"))).repartition("a")
    pair, anchor = W.partitionBy("a", "h", "w"), W.partitionBy("a")
    one = lambda on: F.when(on, 1).otherwise(0)
    x = x.withColumn("c", F.sum(one(fold != SCORED_FOLD)).over(pair)).withColumn("held", F.sum(one(fold == HELD_FOLD)).over(pair))
    x = x.withColumn("ac", F.sum(one(own & (fold != SCORED_FOLD))).over(anchor))
    x = x.withColumn("ar", F.col("ac") - F.sum(one(own & (fold == HELD_FOLD))).over(anchor)).drop("a")
    none = F.lit(None).cast("long")
    two = x.filter("kind % 4 = 3")
    counts = words.select(F.xxhash64("word").alias("code"), F.col("c").alias("hc"), (F.col("c") - F.col("held")).alias("hr"))
    two = two.join(counts, two["h"] == counts["code"], "left").drop("code")
    x = x.filter("kind % 4 < 3").withColumns({"hc": none, "hr": none}).unionByName(two)
    number = lambda c, bit: F.when(F.col("kind").bitwiseAND(bit) > 0, 0).otherwise(F.col(c)).cast("int").alias(c)
    return x.select("uid", "kind", number("h", 2), number("w", 1), "c", "held", "ac", "ar", "hc", "hr")


def _counts(b: pa.RecordBatch, lex: Lexicon) -> tuple[np.ndarray, ...]:
    """(fold, own, c, held, hc, hr, wc, wr) of each token of rare(); own: the token itself is beyond the head."""
    kind, h, w, c, held, ac, ar = (b.column(k).to_numpy() for k in ("kind", "h", "w", "c", "held", "ac", "ar"))
    hc, hr = (pc.fill_null(b.column(k), 0).to_numpy() for k in ("hc", "hr"))
    rare_h, own = kind & 2 > 0, kind & 1 > 0
    return (
        kind >> 2, own, c, held,
        np.where(rare_h, np.where(own, hc, ac), lex.counts[h]), np.where(rare_h, np.where(own, hr, ar), lex.rest[h]),
        np.where(own, ac, lex.counts[w]), np.where(own, ar, lex.rest[w]),
    )


def _buckets(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(counts + 1)).astype(int), BUCKETS - 1)


def _held(bucket: np.ndarray, p2: np.ndarray, p1: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows (bucket, p2, p1, n): what held-out tokens get from the bigram and the unigram, equal ones together."""
    x = np.stack([bucket.astype(float), p2, p1], 1)
    x, at = np.unique(x.view("f8,f8,f8").ravel(), return_inverse=True)
    return np.column_stack([x.view(float).reshape(-1, 3), np.bincount(at, n)])


def _explained(x: np.ndarray, weights: np.ndarray, p0: float) -> np.ndarray:
    """[bucket, component]: how many of the held-out tokens each component explains, then how many there are."""
    bucket, part = x[:, 0].astype(int), weights[x[:, 0].astype(int)] * np.column_stack([x[:, 1], x[:, 2], np.full(len(x), p0)])
    part *= (x[:, 3] / part.sum(1))[:, None]
    return np.stack([np.bincount(bucket, p, BUCKETS) for p in (*part.T, x[:, 3])], 1)


def mixture_weights(dense: np.ndarray, pairs: DataFrame, loose: DataFrame, lexicon: Broadcast, n_rest: int, v_rest: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """[bucket, (bigram, unigram, uniform)]: weights that make the held-out tokens likeliest.

    Estimates come from the rest of the training tokens; each round counts what share of each held-out
    pair every component explains, of the vocabulary's pairs (h, w, c, held) here and of all others in Spark.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    if not n_rest:
        return weights

    def held_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, c, held, hc, hr, _, wr = _counts(b, lexicon.value)
            yield blob(_held(_buckets(hc), (c - held) / np.maximum(hr, 1), wr / n_rest, np.ones(len(c))))

    def blob(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"x": pa.array([x.tobytes()], pa.binary())})

    whole = pairs.filter("held is not null").select(F.col("held").alias("x"))
    few = loose.filter(F.floor(F.col("kind") / 4) == HELD_FOLD).drop("uid").mapInArrow(held_rows, "x binary")
    x = whole.unionByName(T.written(few, "held-out"))
    lex = lexicon.value
    h, w, c, held = (y[dense[3] > 0] for y in dense)
    own = _held(_buckets(lex.counts[h]), (c - held) / np.maximum(lex.rest[h], 1), lex.rest[w] / n_rest, held)
    p0 = 1 / (v_rest + 1)
    for _ in range(rounds):
        now = weights.copy()

        def expect(batches: Iterable[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((BUCKETS, 4))
            for b in batches:
                for y in b.column("x").to_pylist():
                    total += _explained(np.frombuffer(y).reshape(-1, 4), now, p0)
            yield blob(total)

        e = _explained(own, now, p0) + sum(np.frombuffer(r.x).reshape(BUCKETS, 4) for r in x.mapInArrow(expect, "x binary").collect())  # a row a task
        seen = e[:, 3] > 0
        part = e[:, :3] + 1e-3  # a hint of a prior keeps every weight above 0
        weights[seen] = (part / part.sum(1, keepdims=True))[seen]
    for k in range(1, BUCKETS):  # a bucket without held-out tokens takes the weights of the next lower one
        if not seen[k]:
            weights[k] = weights[k - 1]
    return weights


def score_corpus(docs: DataFrame, vocabulary: int = VOCABULARY, head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document.

    The model is a mixture of the bigram, unigram and uniform estimates of a token; weights belong to
    powers of two of the context's count and come from expectation-maximisation on one fold of the
    training documents against the others. Counts are of all training tokens, pairs are those of all words:
    `vocabulary` and `head` say only which counts each task holds and which are joined. The
    probabilities of all known words and one unknown word sum to 1 after any context.

    Null texts count as empty: the end alone; a null doc_id counts as an empty text for its fold;
    rows with an equal doc_id and text each get a row; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    x = docs.select(F.col("`doc_id`").alias("doc_id"), F.coalesce(F.col("`text`"), F.lit("")).alias("text"))
    x = x.withColumn("fold", _fold(F.col("doc_id")).cast("int")).withColumn("uid", F.monotonically_increasing_id())
    in_training = F.col("fold") != SCORED_FOLD
    words = T.checkpointed(unigrams(x.filter(in_training).select("text", (F.col("fold") == HELD_FOLD).alias("held"))))
    top = words.orderBy(F.desc(F.col("word") == END), F.desc("c"), "word").limit(head).select("word", "c", "held").toArrow()  # `head` rows at most
    rest = F.col("c") - F.col("held")
    n, kinds, n_rest, v_rest = words.agg(*[F.coalesce(y, F.lit(0)) for y in (F.sum("c"), F.count(F.lit(1)), F.sum(rest), F.sum(F.when(rest > 0, 1).otherwise(0)))]).first()
    lexicon = spark.sparkContext.broadcast(Lexicon(*[top.column(c).to_pylist() for c in ("word", "c", "held")], vocabulary, n, kinds))
    lex = lexicon.value
    x = T.checkpointed(encoded(x, lexicon))
    got = bigrams(x.filter(in_training), lexicon).toArrow()  # the vocabulary squared at most
    dense = np.stack([got.column(k).to_numpy().astype(np.int64) for k in ("h", "w", "c", "held")])
    tokens = x.agg(F.sum("n")).first()[0] or 0
    pairs = T.written(dealt(x, lexicon, -(-tokens // PIECE) or 1, n_rest), "pairs")
    loose = T.written(rare(x, words, lexicon), "rare-tokens")
    weights = mixture_weights(dense, pairs, loose, lexicon, n_rest, v_rest)
    key = dense[0] * lex.width + dense[1]
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((key[order], dense[2][order].astype(np.int32)))
    unseen = np.array([0.0, *(weights[0, 1:] / weights[0, 1:].sum())])  # after a context without a count

    def estimate(h_count: np.ndarray, c: np.ndarray, w_count: np.ndarray) -> np.ndarray:
        a = np.where((h_count > 0)[:, None], weights[_buckets(h_count)], unseen)
        return a[:, 0] * c / np.maximum(h_count, 1) + a[:, 1] * w_count / max(n, 1) + a[:, 2] / (kinds + 1)

    def base_of(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (n + 0.5 * (kinds + 1)))

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lexicon.value
        keys, counts = shared.value
        for own, row, h, w in _portions(batches):
            known, on = w >= 0, m.dense(h, w)
            pair = h[on] * m.width + w[on]
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            c = np.where(keys[at] == pair, counts[at], 0) if len(keys) else np.zeros(len(pair))
            p = np.log10(estimate(m.counts[h[on]], c, m.counts[w[on]]))
            sums = [np.bincount(row[known], minlength=len(own)).astype(np.int64), *[np.bincount(row[k], y, len(own)).astype(float) for k, y in ((known, base_of(m.counts[w[known]])), (on, p))]]
            yield pa.RecordBatch.from_arrays([own.column("uid"), own.column("doc_id"), own.column("fold"), own.column("n"), *[pa.array(y, k) for y, k in zip(sums, (pa.int64(), pa.float64(), pa.float64()), strict=True)]], names=["uid", "doc_id", "fold", "n", "known", "base", "score"])

    def apart(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lexicon.value
        for b in batches:
            for k in range(len(b)):
                row, times, key, h, c = _line(b, k, m)
                p = np.log10(estimate(m.counts[h], c, m.counts[key % m.width]))
                sums = np.add.reduceat(p, np.cumsum(times) - times)
                yield pa.RecordBatch.from_arrays([b.column("base").slice(k, 1), pa.array([len(row)], pa.int32()), pa.array([_zip(row >> 2)], pa.binary()), pa.array([sums.tobytes()], pa.binary())], names=["base", "runs", "rows", "sums"])

    def together(t: pa.Table) -> pa.Table:
        row = np.concatenate([_unzip(x, k, np.int64) for x, k in zip(t.column("rows").to_pylist(), t.column("runs").to_pylist(), strict=True)])
        found, at = np.unique(row, return_inverse=True)
        return pa.table({"uid": found + t.column("base")[0].as_py(), "full": np.bincount(at, np.frombuffer(b"".join(t.column("sums").to_pylist())))})

    def alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, own, c, _, hc, _, wc, _ = _counts(b, lexicon.value)
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array((own & (wc > 0)).astype(np.int64)), pa.array(np.where(own, base_of(wc), 0.0)), pa.array(np.log10(estimate(hc, c, wc)))], names=["uid", "known", "base", "score"])

    kind = x.schema["doc_id"].dataType.simpleString()
    y = x.select("uid", "doc_id", "fold", "n", "ids").mapInArrow(whole, f"uid long, doc_id {kind}, fold int, n int, known long, base double, score double")
    tail = pairs.drop("held").mapInArrow(apart, "base long, runs int, rows binary, sums binary").groupBy("base").applyInArrow(together, "uid long, full double")
    few = loose.mapInArrow(alone, "uid long, known long, base double, score double")
    parts = tail.select("uid", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), F.col("full").alias("score")).unionByName(few)
    parts = parts.groupBy("uid").agg(F.sum("known").alias("k"), F.sum("base").alias("b"), F.sum("score").alias("s"))
    y = y.join(parts, "uid", "left")
    more = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return y.select("doc_id", (F.col("fold") == SCORED_FOLD).alias("held_out"), F.col("n").cast("long").alias("n_tokens"), more("known", "k").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), more("base", "b").alias("base_score"), more("score", "s").alias("score"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(T.documents(spark, sf_dir).select("doc_id", "text"))
