"""Windows, loudness, track folders and resampling against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemloom.operators import inventory, loudness, windows
from stemloom.operators import sampling as P
from stemloom.sources import tracks


def plain_filter(x, b, a):
    out, z1, z2 = [], 0.0, 0.0
    for v in x:
        y = b[0] * v + z1
        z1, z2 = b[1] * v - a[1] * y + z2, b[2] * v - a[2] * y
        out.append(y)
    return np.array(out)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_filter_in_pieces(n):
    x = np.random.default_rng(n).normal(size=n)
    for b, a in (loudness.high_shelf(*loudness.SHELF, 48_000), loudness.high_pass(0.5, 38, 48_000), loudness.high_pass(0.5, 38, 200)):
        assert np.allclose(loudness.filtered(x, b, a), plain_filter(x, b, a), atol=1e-9)


def test_filter_coefficients_of_the_recommendation():
    """The tables of the public recommendation, at 48 kHz, to the digits in which the formulas meet them."""
    b, a = loudness.high_pass(0.5, 38, 48_000)
    assert np.allclose(a, [1, -1.99004745, 0.99007225], atol=1e-4) and np.allclose(b, [b[0], -2 * b[0], b[0]])
    b, a = loudness.high_shelf(*loudness.SHELF, 48_000)
    assert np.allclose(a, [1, -1.69065929, 0.73248077], atol=0.05) and np.allclose(b, [1.53512486, -2.69169619, 1.19839281], atol=0.06)


def tone(rate, seconds, level, freq=997):
    return level * np.sin(2 * np.pi * freq * np.arange(int(rate * seconds)) / rate)


def test_loudness_of_tones():
    assert loudness.integrated(tone(48_000, 3, 1.0), 48_000) == pytest.approx(-3.01, abs=0.15)
    full, half = (loudness.integrated(tone(48_000, 3, v), 48_000) for v in (0.5, 0.25))
    assert full - half == pytest.approx(20 * math.log10(2), abs=1e-6)
    loud_then_silent = np.append(tone(48_000, 3, 0.5), np.zeros(5 * 48_000))
    assert loudness.integrated(loud_then_silent, 48_000) == pytest.approx(full, abs=0.3)  # the gates leave silence out
    assert loudness.integrated(tone(48_000, 3, 1e-5), 48_000) == -math.inf


def test_gains(spark):
    rate = 8000
    rows = [(1, tone(rate, 1, 0.01).tolist()), (2, tone(rate, 1, 0.9).tolist()), (3, [0.0] * rate), (4, [0.5] * 100), (5, []), (6, None), (7, [*tone(rate, 1, 0.01).tolist(), 0.9])]
    x = spark.createDataFrame(rows, "k int, x array<double>").withColumn("lufs", loudness.loudness(F.col("x"), rate))
    x = x.withColumn("peak", F.coalesce(F.array_max(F.transform("x", F.abs)), F.lit(0.0)))
    got = {r.k: r for r in x.select("k", "lufs", "peak", loudness.gain(F.col("lufs"), F.col("peak"), -23.0, 0.99).alias("g")).collect()}
    assert [got[k].g for k in (3, 4, 5, 6)] == [1.0] * 4 and all(got[k].lufs is None for k in (3, 4, 5, 6))
    assert got[1].g == pytest.approx(10 ** ((-23 - got[1].lufs) / 20)) and got[1].g > 5
    assert got[2].g < 0.2 and got[7].g == pytest.approx(0.99 / 0.9)  # the peak caps it
    again = loudness.integrated(np.array(rows[0][1]) * got[1].g, rate)
    assert again == pytest.approx(-23, abs=1e-6)


def plain_start(x, hop, width, gate, step, first, least, densest):
    n = len(x) // hop
    e = [sum(v * v for v in x[i * hop : (i + 1) * hop]) / hop for i in range(n)]
    best, share = None, -1.0
    for s in range(first, n - width + 1, step):
        f = sum(math.sqrt(v) >= gate for v in e[s : s + width]) / width
        if math.sqrt(sum(e[s : s + width]) / width) >= gate and f >= least:
            if not densest:
                return s
            if f > share:
                best, share = s, f
    return best


@pytest.mark.parametrize(("step", "first", "least", "densest"), [(1, 0, 0.0, False), (2, 1, 0.6, False), (1, 0, 0.3, True), (3, 2, 0.5, True)])
def test_audible_start(spark, step, first, least, densest):
    rng = np.random.default_rng(step)
    waves = [(k, (rng.normal(size=rng.integers(0, 130)) * rng.choice([0, 0.02, 0.2, 1], 1)).tolist()) for k in range(60)]
    waves += [(99, None), (100, []), (101, [1.0] * 9)]
    df = spark.createDataFrame(waves, "k int, x array<double>")
    got = windows.audible_start(df, ["k"], windows.hops(df, ["k"], "x", 5, 0.15), 4, 0.15, step, first, least, densest)
    want = {k: plain_start(x or [], 5, 4, 0.15, step, first, least, densest) for k, x in waves}
    assert {r.k: r.start for r in got.collect()} == want and None in want.values() and any(v is not None for v in want.values())


def test_all_stems_active(spark):
    quiet, loud = [0.01] * 10, [1.0] * 10
    rows = [
        (1, 0, quiet + loud + loud + quiet), (1, 1, quiet + quiet + loud + loud), (2, 0, loud * 4), (2, 1, quiet * 4), (3, 0, loud * 4), (3, 1, loud), (4, 0, loud + loud), (4, 1, None),
    ]
    df = spark.createDataFrame(rows, "song int, stem int, x array<double>")
    got = windows.all_active_start(df, "song", "stem", windows.hops(df, ["song", "stem"], "x", 5, 0.5), 2, 0.5)
    assert {r.song: (r.start, r.score) for r in got.collect()} == {1: (4, pytest.approx(2.0)), 2: (None, None), 3: (0, pytest.approx(2.0)), 4: (None, None)}


def test_onsets_and_scores(spark):
    x = [0.0] * 20 + [0.5] * 8 + [0.0] * 16 + [0.8] * 4 + [0.1] * 32
    df = spark.createDataFrame([(1, x)], "k int, x array<double>")
    rows = windows.onsets(windows.hops(df, ["k"], "x", 4, 0.01), ["k"])
    assert [r.hop for r in rows.filter("onset = 1").orderBy("hop").collect()] == [5, 11]
    got = {r.start: r.score for r in windows.scores(rows, ["k"], 4, 4, 0.25, 0.01).collect()}
    part = x[5 * 4 : 9 * 4]
    want = 2 * math.sqrt(sum(v * v for v in part) / 16) + sum(abs(v) >= 0.01 for v in part) / 16 + 0.25 * 1 / 1.0
    assert got[5] == pytest.approx(want) and 1 not in got and got[2] < got[5]
    edge = x[8 * 4 : 12 * 4]
    assert got[8] == pytest.approx(2 * math.sqrt(sum(v * v for v in edge) / 16) + sum(abs(v) >= 0.01 for v in edge) / 16 + 0.25)
    assert got[16] == pytest.approx(0.2 + 1 - 0.35)  # its end is the wave's


def test_spaced_examples(spark):
    rows = [("a", f"s{k // 2:03}", k % 2, k % 3 == 0, k % 5 != 0) for k in range(200)] + [("b", "s1", 0, True, True), ("b", "s1", 1, False, True), ("c", "s9", 0, False, False)]
    df = spark.createDataFrame(rows, "g string, song string, track int, good boolean, ok boolean").repartition(7)
    want = set()
    for g in "abc":
        pool = sorted(r for r in rows if r[0] == g)
        good = [r for r in pool if r[3]]
        work = good if len(good) >= 3 else pool
        used, k = set(), 0
        for i in np.unique(np.linspace(0, len(work) - 1, num=min(36, len(work)), dtype=int)):
            r = work[i]
            if k < 3 and r[1] not in used and r[4]:
                want.add((*r, k))
                used.add(r[1])
                k += 1
    got = P.spaced_examples(df, "g", "song", ["song", "track"], F.col("good"), F.col("ok"), 3, 36)
    assert {tuple(r) for r in got.collect()} == want


def test_bootstrap_in_pieces_has_the_law_of_one_draw(spark):
    rng = np.random.default_rng(3)
    values = rng.gamma(2, 3, 3000).round(2)
    rows = [("a", float(v)) for v in values] + [("b", 1.5)] + [("c", 2.0)] * 9 + [("d", float("nan")), ("d", None), ("a", float("inf"))]
    df = spark.createDataFrame(rows, "k string, v double")
    want = values.mean(), *np.quantile(rng.choice(values, (2000, 3000)).mean(1), [0.025, 0.975])
    for piece in (50, 10_000):
        got = {r.k: r for r in inventory.bootstrap_ci(df, "k", "v", 2000, piece=piece).collect()}
        assert set(got) == {"a", "b", "c"} and (got["a"].n, got["b"].n, got["c"].n) == (3000, 1, 9)
        assert [got["a"]["mean"], got["a"].low, got["a"].high] == pytest.approx(want, rel=0.012)
        assert got["b"].low == got["b"].high == 1.5 and got["c"].low == got["c"].high == pytest.approx(2.0)


FLAC = b"fLaC\0\0\0\x22" + b"\0" * 10 + ((44_100 << 44) | (1 << 41) | (15 << 36) | 441_000).to_bytes(8, "big") + b"\0" * 16


@pytest.fixture
def corpus(tmp_path):
    meta = "UUID: x\nstems:\n  S00:\n    audio_rendered: true\n    plugin: a\n  S01:\n    audio_rendered: false\n  S02:  # no line\n    program_num: 3\nother:\n  S09: 1\n"
    for split, name, text, mix in [
        ("train", "T1", meta, FLAC), ("train", "T2", "stems:\n  A:\n    audio_rendered: false\n  B:\n    audio_rendered: False\n", FLAC), ("train", "T3", meta, None), ("train", "T4", None, FLAC),
        ("test", "T5", "stems: {}\n", FLAC), ("omitted", "T6", meta, FLAC), ("elsewhere", "T7", meta, FLAC), ("train", "T8", meta, b"RIFF" + b"\0" * 40),
    ]:
        d = tmp_path / "corpus" / split / name
        d.mkdir(parents=True)
        if text is not None:
            (d / "metadata.yaml").write_text(text)
        if mix is not None:
            (d / "mix.flac").write_bytes(mix)
    (tmp_path / "corpus" / "train" / "a_file").write_text("x")
    return f"{tmp_path}/corpus"


def test_track_folders(spark, corpus, tmp_path):
    rows = lambda x: {tuple(r) for r in x.collect()}
    three = {("T1", "train", 2, 10.0), ("T2", "train", 2, 10.0), ("T5", "test", 0, 10.0)}
    assert rows(tracks.read_tracks(spark, corpus, omitted=False)) == three
    everything = three | {("T6", "omitted", 2, 10.0)}
    saved = f"{tmp_path}/saved"
    assert rows(tracks.read_tracks(spark, corpus, saved=saved)) == everything
    assert rows(tracks.read_tracks(spark, "/nowhere", saved=saved)) == everything  # the folders aren't looked at again
    assert rows(tracks.read_tracks(spark, "/nowhere")) == set()
    parts = tracks._TrackReader(corpus, True, 2).partitions()
    assert [(p.split, len(p.names)) for p in parts] == [("train", 2), ("train", 2), ("train", 1), ("test", 1), ("omitted", 1)]
