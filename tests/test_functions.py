"""Scalar functions, array kernels and sampling on inline cases."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stemloom.functions import exprs as X
from stemloom.operators import sampling, songs
from stemloom.operators import signal as K
from stemloom.operators.dedupe import keep_last


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (X.sanitize_name, " a,b\0  c ", "a b c"), (X.sanitize_name, " , ", None), (X.normalize_name, None, "(unnamed)"), (X.parse_tracks, "1- 2--3", [1, 2, 3]), (X.parse_tracks, "1-x", None),
        (X.parse_tracks, "  ", None), (X.parse_pipe, "1|2,3", [1, 2, 3]), (X.chunk_id, "chunk_07", "7"), (X.song_id_from_mid, "./mid/a/b/Qm.mid", "a/b/Qm"), (X.song_id_from_meta, "./data/a/b/Qm.json", "a/b/Qm"),
        (X.song_id_from_recipe, "/x/raw/a/b/Q/", "a/b/Q"), (X.song_id_from_recipe, "q/w/e/r", "w/e/r"), (X.song_id_from_audio, "/x/audio/a/b", "a/b"), (X.song_id_from_audio, "x/y", "y"),
        (X.raw_to_audio, "./raw/a", "./audio/a"), (X.slugify, "My Font (v2).sf2", "my_font_v2"), (X.slugify, "!!.sf2", "soundfont"), (X.noise_level, "noise0.5", 0.5), (X.noise_level, "x", -math.inf),
        (X.category_from_trial, "stem_bass_guitar_3", "bass_guitar"), (X.is_rated, "101", False), (X.is_rated, "55", True), (X.parse_bool, " YES ", True), (X.parse_bool, None, False), (X.fold_accents, "Flöte", "flote"),
        (X.deletable_failure, "length mix=3", True), (X.deletable_failure, "missing", False),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, f, value) == want


@pytest.mark.parametrize(("score", "band"), [(-5.0, 0), (19.5, 1), (20.5, 1), (59.4, 2), (60.0, 3), (79.6, 4), (100.0, 4), (250.0, 4)])
def test_band(spark, score, band):
    assert one(spark, X.band, score, "double") == band


def test_tags_and_captions(spark):
    hints = (("piano", ("piano", "grand")), ("choir", ("choir",)))
    assert one(spark, lambda c: X.tags(c, hints), "Grand Choir") == ["piano", "choir"]
    assert one(spark, lambda c: X.tags(c, hints), "x") == ["general"]
    assert one(spark, lambda c: X.caption(F.split(c, ","), "A {} piece"), "b,a,b") == "A a, b piece"


def test_arrays(spark):
    x = [0.0] * 8 + [1.0] * 8 + [0.5] * 3
    assert one(spark, lambda c: K.active_samples(c, 8, 0.5), x, "array<double>") == 11
    assert one(spark, lambda c: K.active_samples(c, 32, 0.5), x, "array<double>") == 19
    assert one(spark, lambda c: K.best_window(c, 8, 4), x, "array<double>") == 8
    assert one(spark, lambda c: K.si_sdr(c, c), [1.0, -1.0, 2.0, 0.0], "array<double>") > 80
    assert [tuple(s) for s in one(spark, lambda c: K.spans(c, 10, 4), 21, "int")] == [(0, 10), (6, 16), (12, 21)]
    assert [tuple(s) for s in one(spark, lambda c: K.spans(c, 10, 4), 7, "int")] == [(0, 7)]


def test_stitch_is_the_inverse_of_cutting(spark):
    x = [float(v) for v in range(30)]
    df = spark.createDataFrame([(1, x)], "g int, x array<double>")
    cut = df.select("g", F.explode(K.spans(F.lit(30), 12, 4)).alias("s"), "x").select("g", F.col("s.start").alias("start"), F.slice("x", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("x"))
    got = K.stitched(cut, "g", "start", "x", 4).orderBy("pos").collect()
    assert [round(r.v, 9) for r in got] == x


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50)), min_size=1, max_size=30, unique=True))
def test_keep_last_is_idempotent(spark, rows):
    df = spark.createDataFrame(rows, "k int, at int")
    a = keep_last(df, ["k"], ["at"])
    want = {k: max(t for q, t in rows if q == k) for k, _ in rows}
    assert {r.k: r.at for r in keep_last(a, ["k"], ["at"]).collect()} == want


def test_shards_cover_and_do_not_overlap(spark):
    df = spark.range(101).select(F.col("id").cast("string").alias("k"))
    got = sampling.shard_slices(df, "k", 3, 7).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [14, 14, 14, 14, 15, 15, 15] and len(got) == 7


def test_unmatched_keys_raise(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("x",)], "k string")
    with pytest.raises(ValueError, match="y"):
        songs.matched_or_raise(a, b, "k", "chunks")


def test_a_name_is_cleaned_once(spark):
    """Plans of rules with many cues name the cleaned text once, not for each cue."""
    x = spark.range(1).select(F.lit(40).alias("program"), F.lit(False).alias("is_drum"), F.concat(F.lit("Violin "), F.col("id").cast("string")).alias("name"))
    args = (F.col("program"), F.col("is_drum"), F.col("name"))
    for rule in (X.probe_category(*args), X.route(*args)):
        y = x.select(rule.alias("r"))
        assert y._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    got = x.select(X.probe_category(*args).alias("c"), X.route(*args).alias("r")).first()
    assert (got.c, tuple(got.r)) == ("strings", ("midi_ddsp", "violin", "midi_ddsp"))


def test_keep_last_carries_no_column_twice(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, None, "x")], "k int, at int, v string")
    x = keep_last(df, ["k"], ["at"])
    assert "max_by" not in x._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, x.collect())) == [(1, 3, "c"), (2, None, "x")]
