"""Quality rules from tokeniser fertility, with rejection bands per language."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Fixed value: the ASCII white space characters.
SPACE = " \t\n\v\f\r"
#: Fewest labelled documents of a band of its own.
FIT_LEAST = 40
#: How far a band goes beyond the outermost half percent of good documents, as a share of their
#: distance from the median.
SLACK = 0.6
#: Measures are counted in steps of one GRID-th where bands are fitted, so a group's counts are bounded however many documents it has.
GRID = 4096
MEASURES = ("chars_per_token", "byte_share", "entropy")
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@cache
def _pieces(path: str) -> tuple[T.Memo, int, int]:
    """A memo from words to ids of their pieces, and the range of the byte pieces' ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    bytes_ = [i for i in range(sp.get_piece_size()) if sp.is_byte(i)]

    def make(words: list[str]) -> list[bytes]:
        found = sp.encode(words, num_threads=1)
        flat = np.fromiter(chain.from_iterable(found), "<i4").tobytes()
        ends = [4 * n for n in accumulate(map(len, found), initial=0)]
        return [flat[a:b] for a, b in pairwise(ends)]

    return T.Memo(make), min(bytes_, default=0), max(bytes_, default=-1)


def base_counts(text: str | None, words: np.ndarray, chars: int) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text, whose words come as numbers."""
    if not text:
        return 0, 0, 0, 0, 0
    lines = [x for x in text.split("\n") if x.strip(SPACE)] if "\n" in text else []
    n = len(words)
    repeated = 0
    if n >= 3:
        w = words.astype(np.int64)
        pair = w[:-1] * (int(w.max()) + 1) + w[1:]  # 64 bits hold two numbers of words
        known, pair = np.unique(pair, return_inverse=True)
        if len(known) < n - 1:
            _, at, times = np.unique(pair[:-1] * (int(w.max()) + 1) + w[2:], return_inverse=True, return_counts=True)
            hit, marked = times[at] > 1, np.zeros(n, bool)
            for k in range(3):
                marked[k : n - 2 + k] |= hit
            repeated = int(marked.sum())
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def fertility(ids: np.ndarray, chars: int, low: int, high: int) -> tuple[int, float, float, float]:
    """(n_tokens, characters a token, share of byte pieces, entropy of the tokens in bits)."""
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0
    ids = np.sort(ids)
    times = np.diff(np.flatnonzero(ids[1:] != ids[:-1]), prepend=-1, append=n - 1)
    entropy = np.log2(n) - float((times * np.log2(times)).sum()) / n
    in_bytes = int(np.searchsorted(ids, high, "right") - np.searchsorted(ids, low, "left"))
    return n, chars / n, in_bytes / n, max(0.0, float(entropy))


def measures(text: Column, vocabulary: str | None = None, base: bool = True) -> Column:
    """A struct of the base counts, if asked for, and the fertility of whole texts; null texts count as empty."""
    path, counted = vocabulary or default_vocabulary(), f"{BASE}, " if base else ""
    names = [x.split()[0] for x in BASE.split(", ") if base] + ["n_tokens", *MEASURES]

    @F.pandas_udf(f"{counted}n_tokens long, chars_per_token double, byte_share double, entropy double")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo, low, high = _pieces(path)
        for batch in batches:
            rows = []
            for texts, (part, x) in ((t, y) for t in T.pieces(batch) for y in T.coded(t)):
                pieces, starts = x.values(memo, "<i4")
                chars = np.append(0, np.cumsum(pc.utf8_length(x.words).to_numpy()[x.codes], dtype=np.int64))[x.starts]
                for k, t in enumerate(texts[part].to_pylist() if base else [None] * (part.stop - part.start)):
                    size = int(chars[k + 1] - chars[k])
                    counts = base_counts(t, x.codes[x.starts[k] : x.starts[k + 1]], size) if base else ()
                    rows.append((*counts, *fertility(pieces[starts[k] : starts[k + 1]], size, low, high)))
            yield pd.DataFrame(rows, columns=names)

    # else the optimiser measures a text again for each filter and column that needs it
    return measured.asNondeterministic()(text)


def _octave(n_tokens: Column) -> Column:
    return F.floor(F.log2(n_tokens + 1)).cast("int")


def _lang(docs: DataFrame) -> Column:
    return F.coalesce(F.col("`lang`").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


def fit_bands(docs: DataFrame, labels: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(lang, octave, low_*, high_*): what good documents of a language and a length measure.

    The bands come from all documents labelled good; each measure's band reaches from its outermost
    half percent some way outward. Fertility of short texts scatters more, so each power of two of the
    token count has its own band. lang null stands for all languages together.
    """
    x = docs.select(F.col("`doc_id`").alias("id"), F.col("`text`").alias("text"), _lang(docs).alias("lang"))
    x = x.withColumn("m", measures(F.col("text"), vocabulary, False)).select("id", "lang", "m.*")
    return bands_of(T.checkpointed(x), labels)


def bands_of(x: DataFrame, labels: DataFrame) -> DataFrame:
    """The bands of fit_bands from measured documents: labels meet a few numbers a document, so no text is shuffled."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("id"))
    x = x.select("id", "lang", "n_tokens", *MEASURES).join(good, "id", "left_semi")
    x = x.filter("n_tokens > 0").withColumn("octave", _octave(F.col("n_tokens")))
    steps = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m) * GRID).cast("long").alias("step")) for m in MEASURES])
    x = x.select("lang", "octave", F.explode(steps).alias("s")).groupBy("lang", "octave", "s.measure", "s.step").agg(F.count(F.lit(1)).alias("k"))
    x = x.select(F.explode(F.array(F.col("lang"), F.lit(None).cast("string"))).alias("lang"), "octave", "measure", "step", "k")
    parts = []
    for m in MEASURES:
        q = F.percentile(F.when(F.col("measure") == m, F.col("step") / GRID), F.array(F.lit(0.005), F.lit(0.5), F.lit(0.995)), F.col("k"))
        parts += [(q[0] - (q[1] - q[0]) * SLACK).alias(f"low_{m}"), (q[2] + (q[2] - q[1]) * SLACK).alias(f"high_{m}")]
    n = F.sum(F.when(F.col("measure") == MEASURES[0], F.col("k"))).alias("n")
    return x.groupBy("octave", "lang").agg(n, *parts).filter(f"n >= {FIT_LEAST}").drop("n")


def judge(docs: DataFrame, labels: DataFrame, vocabulary: str | None = None, fit_docs: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """(row, base counts, measures, base_failed, kept) of each document.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept: not
    base_failed, and chars per token, byte share and entropy lie in the band of the document's
    language and length; without labelled documents of that language, in that of all languages. A
    length without any band takes the band of the next shorter length that has one, which is wider as
    measures of shorter texts scatter more; below all bands that of the next longer, without its bound
    of entropy, which grows with length. Only without any band at all, all documents pass. Byte share has an upper bound only, characters per token both,
    entropy a lower bound only: a text can't be too varied.

    Null texts count as empty and fail the base rule; null languages are one language; repeated rows
    are judged alike; an empty table gives an empty result; all columns travel in `row`, or those that
    `keep` names.

    The bands come from the labelled ones of `docs`, or of `fit_docs`. In the first case the rows that `keep`
    makes slim are written out with their measures, so that each text is encoded once. Whole rows are not written:
    their texts are encoded once for the bands, where only numbers are written, and once for the verdict.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in keep]) if keep else docs
    x = docs.select(T.packed(kept), F.col("`doc_id`").alias("id"), F.col("`text`").alias("text"), _lang(docs).alias("lang"))
    x = x.withColumn("m", measures(F.col("text"), vocabulary)).select("row", "id", "lang", "m.*")
    if keep and fit_docs is None:
        x = T.checkpointed(x)
        bands = bands_of(x, labels)
    else:
        bands = fit_bands(fit_docs or docs, labels, vocabulary)
    bands = T.checkpointed(bands)
    own, all_ = bands.filter("lang is not null"), bands.filter("lang is null").drop("lang")
    all_ = all_.select("octave", *[F.col(c).alias(f"any_{c}") for c in all_.columns if c != "octave"])
    x = x.withColumn("length", _octave(F.col("n_tokens")))
    have = F.array(*[F.lit(r.octave) for r in all_.select("octave").collect()]).cast("array<int>")  # powers of two
    x = x.withColumn("octave", F.coalesce(F.array_max(F.filter(have, lambda o: o <= F.col("length"))), F.array_min(have)))
    # a row for each language and power of two with FIT_LEAST good documents
    x = x.join(F.broadcast(own), ["lang", "octave"], "left").join(F.broadcast(all_), "octave", "left")

    def bound(side: str, m: str) -> Column:
        return F.coalesce(F.col(f"{side}_{m}"), F.col(f"any_{side}_{m}"))

    inside = (
        F.coalesce(F.col("chars_per_token").between(bound("low", "chars_per_token"), bound("high", "chars_per_token")), F.lit(True))
        & F.coalesce(F.col("byte_share") <= F.greatest(bound("high", "byte_share"), F.lit(0.05)), F.lit(True))
        & F.coalesce((F.col("entropy") >= bound("low", "entropy")) | (F.col("octave") > F.col("length")), F.lit(True))
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = [c.split()[0] for c in BASE.split(", ")]
    return x.select("row", *counts, "n_tokens", *MEASURES, failed.alias("base_failed"), (~failed & inside).alias("kept"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.documents(spark, sf_dir)
    x = judge(docs.select("doc_id", "text", "lang"), T.table(spark, sf_dir, "labels"), keep=["doc_id"])
    return x.select("row.doc_id", *[c for c in x.columns if c != "row"])
