"""N-gram Jaccard self-join with Bayesian candidate pruning."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .graph import components

WORDS = 5
THRESHOLD = 0.8
#: 30 bands of 5 values miss a pair at the threshold with probability 7e-6.
BANDS, ROWS = 30, 5
HASHES = BANDS * ROWS
#: Pairs are dropped when the posterior probability of reaching the threshold is below this.
TOLERANCE = 1e-6
#: MinHash values compared between two looks at the posterior.
STEP = 30
#: Texts on each side of a tile. Larger groups are cut into tiles, and all pairs of tiles compared.
TILE = 256
#: A component of more texts than a tile, with no more candidate pairs a text than this, is verified pair by pair.
SPARSE = 32
_MASK = (1 << 64) - 1


@cache
def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The distinct hashes of the runs of n words, sorted; a shorter text is one run, an empty one none."""
    if not len(words):
        return np.empty(0, np.uint64)
    c = _constants(n, 1)
    if len(words) < n:
        h = (words * c[: len(words)]).sum(dtype=np.uint64, keepdims=True) + c[-1:] * np.uint64(len(words))
    else:
        h = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            h += words[k : len(words) - n + 1 + k] * c[k]
    return np.unique(_mixed(h))


def text_shingles(texts: pa.Array, n: int = WORDS) -> Iterator[tuple[slice, list[np.ndarray]]]:
    T.Memo.clear()
    for part, x in T.coded(texts):
        own = x.words.to_pylist()
        words = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))[x.codes]
        yield part, [shingles(words[a:z], n) for a, z in pairwise(x.starts.tolist())]


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """MinHash of non-empty sets: 16 bits of each value, and a key for each band."""
    n = len(sets)
    flat = np.concatenate(sets)
    h = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    a, b = _constants(HASHES, 2).astype(np.uint32), (_constants(HASHES, 3) >> np.uint64(7)).astype(np.uint32)
    sig = np.empty((n, HASHES), np.uint16)
    keys = np.zeros((n, BANDS), np.uint64)
    mix = _constants(ROWS, 4)
    for k in range(HASHES):
        x = (h ^ b[k]) * a[k]
        x ^= x >> np.uint32(15)
        least = np.minimum.reduceat(x * np.uint32(0x2C1B3C6D), starts)
        sig[:, k] = (least ^ (least >> np.uint32(16))).astype(np.uint16)
        keys[:, k // ROWS] += (least.astype(np.uint64) + np.uint64(1)) * mix[k % ROWS]
    return sig, _mixed(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values seen, fewest matches to go on): where P(similarity >= threshold | matches) >= tolerance.

    With a uniform prior the posterior is a Beta distribution, and its upper tail at the threshold
    is the probability of at most that many successes in one more trial than values seen.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def pruned(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) stay candidates, comparing more values only while they do."""
    alive, matches, seen = np.arange(len(i)), np.zeros(len(i), np.int32), 0
    for n, least in least_matches():
        if not len(alive):
            break
        matches = matches + (sig[i[alive], seen:n] == sig[j[alive], seen:n]).sum(1, dtype=np.int32)
        ok = matches >= least
        alive, matches, seen = alive[ok], matches[ok], n
    return alive


def _earlier(sig: np.ndarray, i: np.ndarray, j: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Which pairs agree in a band before their own; they are compared there."""
    found = np.zeros(len(i), bool)
    for k in range(BANDS):
        todo = np.flatnonzero((band > k) & ~found)
        if len(todo):
            s = slice(k * ROWS, (k + 1) * ROWS)
            found[todo] = (sig[i[todo], s] == sig[j[todo], s]).all(1)
    return found


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that it is linked with, directly or not."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        if (root[i] == low).all() and (root[j] == low).all():
            break
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
    return root


def _pairs(gid: np.ndarray, side: np.ndarray, most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Pairs of rows of one group: (i, j, first row, end row) of some whole groups at a time.

    side 0: all pairs; 1 and 2: those between the sides.
    """
    cuts = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]])) if len(gid) else np.empty(0, int)
    ends = np.append(cuts[1:], len(gid))
    sizes = ends - cuts
    start = 0
    while start < len(cuts):
        total = np.cumsum(sizes[start:] * (sizes[start:] - 1) // 2)
        stop = start + max(1, int(np.searchsorted(total, most, "right")))
        lo, hi = cuts[start], ends[stop - 1]
        rows = np.arange(lo, hi)
        left = np.repeat(ends[start:stop], sizes[start:stop]) - rows - 1  # partners after each row
        i = np.repeat(rows, left)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(left) - left, left)
        ok = (side[i] == 0) | (side[i] != side[j])
        yield i[ok], j[ok], lo, hi
        start = stop


def _whole_groups(batches: Iterable[pa.RecordBatch], least: int = 4096) -> Iterator[pa.Table]:
    """Tables that end where a group ends, of batches sorted by gid."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held)
        gid = t.column("gid").to_numpy()
        cut = int(np.searchsorted(gid, gid[-1], "left"))
        if cut:
            yield t.slice(0, cut)
            held, rows = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint16).reshape(-1, HASHES)


def _tiled(df: DataFrame, group: str, size: str) -> DataFrame:
    """Rows of groups dealt to tiles: gid and side are added, rows of groups over TILE repeated."""
    tiles = F.ceil(F.col(size) / TILE).cast("int")
    mine = F.pmod(F.xxhash64("tid", F.lit(5)), tiles).cast("int")
    x = df.withColumn("tiles", tiles).withColumn("mine", mine)
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    gid = F.xxhash64(group, F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    x = x.withColumn("gid", gid).withColumn("side", side.cast("int")).drop("tiles", "mine", "other")
    return x.repartition("gid").sortWithinPartitions("gid")


def _signed(docs: DataFrame) -> DataFrame:
    """(tid, n, copies, first_id, keys, sig) of each distinct text with words."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = np.sort(np.unique(b.column("tid").to_numpy(), return_index=True)[1])
            if len(first) < b.num_rows:
                b = b.take(pa.array(first))  # of copies that come together one is signed
            tids = b.column("tid").to_numpy()
            for part, sets in text_shingles(b.column("text")):
                full = [k for k, s in enumerate(sets) if len(s)]
                if full:
                    sig, keys = signatures([sets[k] for k in full])
                    yield pa.RecordBatch.from_pydict(
                        {"tid": tids[part][full], "keys": list(keys.view(np.int64)), "sig": [r.tobytes() for r in sig]},
                        schema=pa.schema([("tid", pa.int64()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary())]),
                    )

    x = docs.select("tid", "text").mapInArrow(sign, "tid long, keys array<long>, sig binary")
    return x.groupBy("tid").agg(F.first("keys").alias("keys"), F.first("sig").alias("sig"))


def _buckets(signed: DataFrame) -> DataFrame:
    """(gid, side, tid, band, sig): the texts of each bucket of two or more, dealt to tiles."""
    slim = signed.select("tid", F.posexplode("keys").alias("band", "key"))
    full = slim.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = slim.join(full, "key").join(signed.select("tid", "sig"), "tid")
    return _tiled(members, "key", "size").select("gid", "side", "tid", "band", "sig")


def _left(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Pairs of rows of some whole buckets that the pruning leaves, each in the first band that it shares."""
    band, sig = t.column("band").to_numpy(), _matrix(t.column("sig"))
    for i, j, lo, hi in _pairs(t.column("gid").to_numpy(), t.column("side").to_numpy()):
        new = ~_earlier(sig, i, j, band[i])
        i, j = i[new], j[new]
        stay = pruned(sig, i, j)
        yield i[stay], j[stay], lo, hi


def _candidates(signed: DataFrame) -> DataFrame:
    """(u, v, pairs): a spanning forest, in each bucket tile, of the pairs that the pruning leaves.

    The sum of `pairs` over the rows of a component is the number of its pairs.
    """

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            tid = t.column("tid").to_numpy()
            for i, j, lo, hi in _left(t):
                root = _forest(hi - lo, i - lo, j - lo)
                linked = np.flatnonzero(root != np.arange(hi - lo))
                if len(linked):
                    trees, first = np.unique(root[linked], return_index=True)
                    pairs = np.zeros(len(linked), np.int64)
                    pairs[first] = np.bincount(root[i - lo], minlength=hi - lo)[trees]
                    yield pa.RecordBatch.from_pydict({"u": tid[lo + root[linked]], "v": tid[lo + linked], "pairs": pairs})

    return _buckets(signed).mapInArrow(compare, "u long, v long, pairs long")


def _listed(signed: DataFrame) -> DataFrame:
    """(u, v): all pairs that the pruning leaves, each once; of texts that have few."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            tid = t.column("tid").to_numpy()
            for i, j, _, _ in _left(t):
                if len(i):
                    yield pa.RecordBatch.from_pydict({"u": tid[i], "v": tid[j]})

    return _buckets(signed).mapInArrow(compare, "u long, v long")


def _linked(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have a Jaccard similarity of the threshold or more, exactly."""
    size = np.array([len(s) for s in sets])
    ok = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
    i, j = i[ok], j[ok]
    kept = np.flatnonzero(ok)
    if len(i) > 2000:
        rows = np.unique(np.concatenate([i, j]))
        at = np.full(len(sets), -1)
        at[rows] = np.arange(len(rows))
        flat = np.concatenate([sets[r] for r in rows])
        owner = np.repeat(np.arange(len(rows)), size[rows])
        values, code, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times > 1
        number = np.cumsum(shared) - 1
        keep = shared[code]
        owner, code = owner[keep], number[code[keep]]
        common = np.zeros((len(rows), len(rows)), np.float32)
        width = max(1, 2_000_000 // len(rows))
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        for start in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(code, [start, start + width])
            m = np.zeros((len(rows), width), np.float32)
            m[owner[a:b], code[a:b] - start] = 1
            common += m @ m.T
        both = common[at[i], at[j]].astype(np.int64)
    else:
        both = np.fromiter((len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(i, j, strict=True)), np.int64, len(i))
    return kept[both >= threshold * (size[i] + size[j] - both)]


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the shingles of their text in place of it."""
    for b in batches:
        rest = b.drop_columns(["text"])
        for part, some in text_shingles(b.column("text")):
            sets = pa.array([s.tobytes() for s in some], pa.binary())
            yield rest.slice(part.start, len(some)).append_column("set", sets)


def _pair_links(members: DataFrame, threshold: float) -> DataFrame:
    """(tid, root, links) as _links has it, of members of sparse components: each candidate pair by itself.

    A pair's two texts meet as their sets of shingles; a text in very many pairs meets them in pieces. So
    the work grows with the pairs, however long a chain of texts is.
    """
    pairs = T.checkpointed(_listed(members.select("tid", "keys", "sig")))
    sets = T.written(members.select("tid", "copies", "text").mapInArrow(_sets, "tid long, copies long, set binary"), "sets")
    rows = pairs.count()
    for side in ("u", "v"):
        known = sets.select(F.col("tid").alias(side), F.col("copies").alias(f"{side}_copies"), F.col("set").alias(f"{side}_set"))
        pairs = T.hub_join(pairs, known, side, T.hubs_of(pairs.select(side), side, rows))

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = ([np.frombuffer(x, np.uint64) for x in b.column(f"{side}_set").to_pylist()] for side in ("u", "v"))
            both = np.fromiter((len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(u, v, strict=True)), np.int64, len(u))
            size = np.fromiter(map(len, u), np.int64, len(u)) + np.fromiter(map(len, v), np.int64, len(v))
            yes = pa.array(both >= threshold * (size - both))
            yield b.drop_columns(["u_set", "v_set"]).filter(yes)

    found = pairs.select("u", "v", "u_copies", "v_copies", "u_set", "v_set").mapInArrow(verify, "u long, v long, u_copies long, v_copies long")
    each = F.array(F.struct(F.col("u").alias("tid"), F.col("v_copies").alias("links")), F.struct(F.col("v").alias("tid"), F.col("u_copies").alias("links")))
    return found.select(F.least("u", "v").alias("root"), F.inline(each)).select("tid", "root", "links")


def _links(members: DataFrame, threshold: float) -> DataFrame:
    """(tid, root, links): in each tile of a component, exact links of a text and the least text linked.

    `members` has (tid, comp, size, copies, text, sig). links counts the documents, copies of other
    texts included.
    """

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, 512):
            tid, copies, sig = t.column("tid").to_numpy(), t.column("copies").to_numpy(), _matrix(t.column("sig"))
            for i, j, lo, hi in _pairs(t.column("gid").to_numpy(), t.column("side").to_numpy()):
                stay = pruned(sig, i, j)
                i, j = i[stay], j[stay]
                own = [np.frombuffer(x, np.uint64) for x in t.column("set").slice(lo, hi - lo).to_pylist()]
                yes = _linked(own, i - lo, j - lo, threshold)
                i, j = i[yes] - lo, j[yes] - lo
                links = np.bincount(i, copies[lo + j], hi - lo) + np.bincount(j, copies[lo + i], hi - lo)
                root = _forest(hi - lo, i, j)
                some = np.flatnonzero(links > 0)
                if len(some):
                    yield pa.RecordBatch.from_pydict({"tid": tid[lo + some], "root": tid[lo + root[some]], "links": links[some].astype(np.int64)})

    schema = "tid long, comp long, size long, copies long, sig binary, set binary"
    x = members.select("tid", "comp", "size", "copies", "sig", "text").mapInArrow(_sets, schema)
    return _tiled(x, "comp", "size").select("gid", "side", "tid", "copies", "sig", "set").mapInArrow(verify, "tid long, root long, links long")


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, tid, root, class_id, n_links, copies) of each document; root names its class.

    Two documents are linked when the sets of their runs of five words have a Jaccard similarity of
    the threshold or more; equal texts are. n_links counts a document's links; class_id is the least
    doc_id that it reaches over links. A text under five words is one run; texts without words, null
    among them, are linked only with equal texts (null counts as empty). Rows that repeat a doc_id are
    rows of their own and link with each other when their texts do. An empty table gives an empty result.

    Equal texts are one text with a number of copies. MinHash bands give buckets of texts; in each
    bucket pairs are pruned by the posterior of their similarity; the components of what is left hold
    all candidates, and in each component pairs are pruned again and verified exactly. Large buckets
    and components are cut into tiles: pairs stay inside tasks, and only counts and spanning forests
    leave them. In a large component with few candidate pairs a text, such as a long chain, the pairs
    are listed and verified one by one instead. No bucket is capped. Where one text has very many copies,
    its rows meet the one row that is known of it in pieces.
    """
    x = docs.select(F.col("`doc_id`").alias("doc_id"), F.coalesce(F.col("`text`"), F.lit("")).alias("text"))
    x = x.withColumn("tid", F.xxhash64("text"))
    signed = T.checkpointed(_signed(x))
    forest = T.checkpointed(_candidates(signed))
    comp = components(forest.select("u", "v")).select(F.col("node").alias("tid"), F.col("root").alias("comp"))
    pairs = forest.groupBy(F.col("v").alias("tid")).agg(F.sum("pairs").alias("pairs"))
    size = T.checkpointed(comp.join(pairs, "tid", "left").groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.sum("pairs").alias("pairs")))
    copies = T.checkpointed(x.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")))
    rows = copies.agg(F.sum("copies")).first()[0] or 0
    hubs = [r.tid for r in copies.filter(F.col("copies") > max(rows / T.HUBS, T.HUB_LEAST)).select("tid").collect()]  # fewer than T.HUBS
    known = comp.join(size, "comp").join(signed, "tid").join(copies.select("tid", "copies"), "tid")
    texts = T.marked(x.select("tid", "text"), "tid", T.marks(comp, "tid"))
    texts = T.hub_join(texts, comp.select("tid"), "tid", hubs, "left_semi").dropDuplicates(["tid"])
    sparse = (F.col("size") > TILE) & (F.col("pairs") <= SPARSE * F.col("size"))
    if size.filter(sparse).isEmpty():
        found = T.checkpointed(_links(known.join(texts, "tid"), threshold))
    else:
        found = T.checkpointed(_links(known.filter(~sparse).join(texts, "tid"), threshold))
        thin = T.written(known.filter(sparse).join(texts, "tid"), "thin")
        found = found.unionByName(T.checkpointed(_pair_links(thin, threshold)))
    classes = components(found.select(F.col("tid").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("tid").agg(F.sum("links").alias("links"))
    info = copies.join(classes.select(F.col("node").alias("tid"), "root"), "tid", "left").join(links, "tid", "left")
    info = info.withColumn("root", F.coalesce("root", "tid"))
    least = info.groupBy("root").agg(F.min("first_id").alias("class_id"))
    info = info.join(least, "root").select("tid", "root", "class_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return T.hub_join(x.select("doc_id", "tid"), info, "tid", hubs).select("doc_id", "tid", "root", "class_id", "n_links", "copies")


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one of each class kept: its least doc_id (nulls last, repeats once).

    Of rows that share doc_id and text but differ elsewhere, the one with the least hash stays. Only rows
    that may go or repeat are shuffled; most stay where they are.
    """
    found = join(docs, threshold).filter("n_links > 0").select("root", F.struct("tid", "doc_id").alias("key"))
    found = T.checkpointed(found)
    last = F.coalesce(F.col("key.doc_id").cast("long"), F.lit((1 << 63) - 1))
    keep = found.groupBy("root").agg(F.min_by("key", F.struct(last, F.col("key.doc_id").isNull(), F.col("key.tid"))).alias("key"))
    keys = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(keep.select("key", F.lit(True).alias("stays")), "key", "left")
    keys = T.checkpointed(keys.filter("stays IS NULL OR n > 1"))
    table = T.marks(keys, "key")
    key = F.struct(F.xxhash64(F.coalesce(F.col("`text`"), F.lit(""))).alias("tid"), F.col("`doc_id`").alias("doc_id"))
    x = docs.select(T.packed(docs), T.row_hash(docs).alias("rh"), key.alias("key"))
    sure = T.marked(x, "key", table, "left_anti").select("row")
    some = T.marked(x, "key", table).join(keys.filter("stays IS NULL").select("key"), "key", "left_anti")
    some = some.groupBy("key").agg(F.min_by("row", "rh").alias("row")).select("row")
    return T.unpacked(sure.unionByName(some), docs.columns)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = join(T.documents(spark, sf_dir).select("doc_id", "text"))
    return x.select("doc_id", "class_id", "n_links", "copies")
