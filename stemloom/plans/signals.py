"""Registered queries over waveforms: windows worth hearing, onsets, loudness, and examples of categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemloom.operators import loudness as N
from stemloom.operators import sampling as P
from stemloom.operators import windows as Z
from stemloom.plans.catalog import _GM_SQL, query
from stemloom.sources import adapters as A

HOP, RATE, GATE, LOUD = 4, 4000, 0.12, 0.1
_HOPS = f""", hp0 AS (SELECT vec_id, vec_id // 4 AS song, i AS hop, x[i * {HOP} + 1:i * {HOP} + {HOP}] AS p FROM waveforms, (SELECT unnest(range(16)) AS i)),
  hp AS (SELECT vec_id, song, hop, list_sum(list_transform(p, lambda v: v * v)) / {HOP} AS energy, list_sum(list_transform(p, lambda v: (abs(v) >= {LOUD})::INT)) AS loud FROM hp0),
  ha AS (SELECT *, (sqrt(energy) >= {GATE})::INT AS active FROM hp),
  win AS (SELECT *, sum(energy) OVER w AS e, sum(active) OVER w AS a, sum(loud) OVER w AS l, count(*) OVER w AS k FROM ha WINDOW w AS (PARTITION BY vec_id ORDER BY hop ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) QUALIFY k = 4)"""


def _waves(spark, d):
    return A.waveforms(spark, d).withColumn("song", F.floor(F.col("vec_id") / 4))


def _hops(spark, d, *keys):
    return Z.hops(_waves(spark, d), keys, "x", HOP, GATE, LOUD)


@query("audible_start", _HOPS + f""", ok AS (SELECT vec_id, hop, a / 4.0::DOUBLE AS share FROM win WHERE hop >= 1 AND (hop - 1) % 2 = 0 AND sqrt(e / 4) >= {GATE} AND a >= 2)
  SELECT w.vec_id, min(hop)::INT AS first_start, arg_max(hop, (share, -hop))::INT AS dense_start FROM waveforms w LEFT JOIN ok ON ok.vec_id = w.vec_id GROUP BY 1""")
def audible_start(spark, d):
    w, h = _waves(spark, d), _hops(spark, d, "vec_id")
    find = lambda densest: Z.audible_start(w, ["vec_id"], h, 4, GATE, 2, 1, 0.5, densest)
    return find(False).withColumnRenamed("start", "first_start").join(find(True).withColumnRenamed("start", "dense_start"), "vec_id")


@query("best_active_start", _HOPS + """, r AS (SELECT vec_id, hop, round(sqrt(e / 4), 9) AS rms FROM win WHERE hop % 2 = 0 AND round(sqrt(e / 4), 9) >= 0.13)
  SELECT w.vec_id, arg_max(hop, (rms, -hop))::INT AS start, max(rms) AS score FROM waveforms w LEFT JOIN r ON r.vec_id = w.vec_id GROUP BY 1""")
def best_active_start(spark, d):
    return Z.best_start(_waves(spark, d), ["vec_id"], _hops(spark, d, "vec_id"), 4, 0.13, 2, 1)


@query("all_active_start", _HOPS + """, r AS (SELECT song, hop, min(sqrt(e / 4 + 1e-12)) AS low, avg(sqrt(e / 4 + 1e-12)) AS mean FROM win WHERE hop % 2 = 0 GROUP BY 1, 2),
  s AS (SELECT song, hop, round(low * (1 + mean), 9) AS score FROM r WHERE low >= 0.1)
  SELECT g.song, arg_max(hop, (score, -hop))::INT AS start, max(score) AS score FROM (SELECT DISTINCT vec_id // 4 AS song FROM waveforms) g LEFT JOIN s ON s.song = g.song GROUP BY 1""")
def all_active_start(spark, d):
    return Z.all_active_start(_waves(spark, d), "song", "vec_id", _hops(spark, d, "song", "vec_id"), 4, 0.1, 2, 1)


_ONSETS = _HOPS + """, ri AS (SELECT *, round(greatest(0.0::DOUBLE, sqrt(energy) - coalesce(lag(sqrt(energy)) OVER (PARTITION BY vec_id ORDER BY hop), 0.0)), 12) AS rise FROM ha),
  rn AS (SELECT *, coalesce(max(rise) OVER (o ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), -1) AS before, coalesce(max(rise) OVER (o ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), -1) AS after, avg(rise) OVER (o ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS mean FROM ri WINDOW o AS (PARTITION BY vec_id ORDER BY hop)),
  ons AS (SELECT *, (rise > before AND rise >= after AND rise >= round(mean, 12) + 0.01)::INT AS onset FROM rn),
  sw AS (SELECT vec_id, hop, sum(energy) OVER w AS e, sum(loud) OVER w AS l, sum(onset) OVER w AS o, count(*) OVER w AS k FROM ons WINDOW w AS (PARTITION BY vec_id ORDER BY hop ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
  sc AS (SELECT vec_id, hop AS start, round(2 * sqrt(e / 4) + l / 16.0::DOUBLE + 0.25 * o / 1.0::DOUBLE - CASE WHEN hop < 4 THEN 0.35 * (1 - hop / 4.0::DOUBLE) ELSE 0 END - CASE WHEN 12 - hop < 4 THEN 0.35 * (1 - (12 - hop) / 4.0::DOUBLE) ELSE 0 END, 9) AS score
    FROM sw WHERE k = 4 AND sqrt(e / 4) >= 0.1)"""


def _scored(spark, d):
    return Z.scores(Z.onsets(_hops(spark, d, "vec_id"), ["vec_id"], 2, 5), ["vec_id"], 4, HOP, 0.25, 0.1)


@query("onset_hops", _ONSETS + "SELECT vec_id, hop FROM ons WHERE onset = 1")
def onset_hops(spark, d):
    return Z.onsets(_hops(spark, d, "vec_id"), ["vec_id"], 2, 5).filter("onset = 1").select("vec_id", "hop")


@query("window_scores", _ONSETS + "SELECT vec_id, start, score FROM sc")
def window_scores(spark, d):
    return _scored(spark, d)


@query("rich_clips", _ONSETS + """, one AS (SELECT vec_id, arg_max(start, (score, -start)) AS p FROM sc GROUP BY 1),
  two AS (SELECT sc.vec_id, any_value(p) AS p, arg_max(start, (score, -start)) AS q FROM sc JOIN one USING (vec_id) WHERE abs(start - p) >= 3 GROUP BY 1),
  three AS (SELECT sc.vec_id, arg_max(start, (score, -start)) AS r FROM sc JOIN two USING (vec_id) WHERE abs(start - p) >= 3 AND abs(start - q) >= 3 GROUP BY 1)
  SELECT vec_id, array_to_string(list_sort(list_filter([p, q, r], lambda v: v IS NOT NULL)), '|') AS starts FROM (SELECT one.vec_id, one.p, q, r FROM one LEFT JOIN two ON two.vec_id = one.vec_id LEFT JOIN three ON three.vec_id = one.vec_id)""")
def rich_clips(spark, d):
    x = Z.rich_clips(_scored(spark, d), ["vec_id"], 3, 3.0)
    return x.select("vec_id", F.array_join(F.transform("starts", lambda v: v.cast("int")), "|").alias("starts"))


@query("padded_waves", ", l AS (SELECT vec_id, vec_id // 4 AS song, x[1:64 - label] AS x FROM waveforms) SELECT vec_id, max(len(x)) OVER (PARTITION BY song) AS n, round(list_sum(x), 9) AS total FROM l")
def padded_waves(spark, d):
    x = Z.padded(_waves(spark, d).withColumn("x", F.slice("x", F.lit(1), 64 - F.col("label"))), "song", "x")
    return x.select("vec_id", F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 9).alias("total"))


@query("loudness_gains")
def loudness_gains(spark, d):
    """Loudness, and the gain towards a target that the peak caps, of each wave fading through 64 repeats."""
    fading = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.transform("x", lambda v: v * (1 - k / 64))))
    x = A.waveforms(spark, d).select("vec_id", F.when(F.col("label") > 0, fading).otherwise(F.col("x")).alias("y"))  # some too short to measure
    x = x.select("vec_id", F.array_max(F.transform("y", F.abs)).alias("peak"), N.loudness(F.col("y"), RATE).alias("lufs"))
    return x.select("vec_id", F.round("lufs", 6).alias("lufs"), F.round(N.gain(F.col("lufs"), F.col("peak")), 6).alias("gain"))


@query("category_examples", _GM_SQL + """, pool AS (SELECT r.song_id, r.track, r.category, r.backend, s.present FROM recipe r JOIN stems s ON s.song_id = r.song_id AND s.track = r.track),
  enough_of AS (SELECT category, count(*) FILTER (backend = 'midi_ddsp') >= 3 AS enough FROM pool GROUP BY 1),
  work AS (SELECT pool.*, row_number() OVER (PARTITION BY category ORDER BY song_id, track) - 1 AS place, count(*) OVER (PARTITION BY category) AS n FROM pool JOIN enough_of USING (category) WHERE NOT enough OR backend = 'midi_ddsp'),
  idx AS (SELECT DISTINCT category, CASE WHEN i = least(36, n) - 1 THEN n - 1 ELSE floor(i * ((n - 1)::DOUBLE / (least(36, n) - 1))) END::BIGINT AS place FROM (SELECT DISTINCT category, n FROM work), (SELECT unnest(range(36)) AS i) WHERE i < least(36, n)),
  cand AS (SELECT work.* FROM work JOIN idx USING (category, place) WHERE present), one AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY category, song_id ORDER BY place) = 1),
  pick AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY place) - 1 AS k FROM one)
  SELECT category, k::INT AS k, song_id, track, backend FROM pick WHERE k < 3""")
def category_examples(spark, d):
    stems = A.stems(spark, d).select("song_id", "track", "present")
    pool = A.recipe(spark, d).select("song_id", "track", "category", "backend").join(stems, ["song_id", "track"])
    return P.spaced_examples(pool, "category", "song_id", ["song_id", "track"], F.col("backend") == "midi_ddsp", F.col("present"), 3, 36).select("category", "k", "song_id", "track", "backend")
