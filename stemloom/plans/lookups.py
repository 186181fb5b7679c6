"""Registered queries of single rules: targets by class text, names that agree, seeded picks, inventories, catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemloom.functions import exprs as X
from stemloom.functions import picks
from stemloom.functions import values as V
from stemloom.operators import inventory as I
from stemloom.operators import merge as M
from stemloom.operators import planning as G
from stemloom.operators import register
from stemloom.operators import signal as K
from stemloom.plans.catalog import _GM_SQL, _REGISTER_SQL, _TARGET, _gm, _part_names, query
from stemloom.session import table
from stemloom.sources import adapters as A
from stemloom.sources import files


@query("class_targets", f""", ct AS (SELECT DISTINCT coalesce(name, {A.CLASS_SQL}) AS text, is_drum FROM stems), lt AS (SELECT *, lower(trim(text)) AS t FROM ct)
  SELECT text, is_drum, CASE WHEN is_drum THEN 'drums' WHEN t IN ('bass', 'guitar', 'piano', 'drums') THEN t WHEN t = 'drum' THEN 'drums' WHEN contains(t, 'bass') THEN 'bass' WHEN contains(t, 'drum') THEN 'drums' WHEN contains(t, 'guitar') THEN 'guitar' WHEN contains(t, 'piano') THEN 'piano' END AS target FROM lt""")
def class_targets(spark, d):
    """P06."""
    x = A.stems(spark, d).select(F.coalesce("name", X.gm_class(F.col("program"), F.col("is_drum"))).alias("text"), "is_drum").distinct()
    return x.select("text", "is_drum", X.class_text_target(F.col("text"), F.col("is_drum")).alias("target"))


@query("name_agreement", _REGISTER_SQL + "SELECT DISTINCT folded, program, folded IN (SELECT p_name FROM skips) OR regexp_matches(folded, '^((track|part|staff|channel)[\\s_\\-]*\\d+|\\d+)$') OR contains(folded, 'musicxml') AS generic FROM x WHERE folded <> ''")
def name_agreement(spark, d):
    """Names that tell no instrument."""
    skip = table(spark, d, "part").filter("p_name LIKE 'old %'").select(F.col("p_name").alias("folded"), F.lit(True).alias("_skip")).distinct()
    x = register.with_folded(_part_names(spark, d), "program").select("folded", "program").filter("folded <> ''").distinct()
    return x.join(skip, "folded", "left").select("folded", "program", (F.coalesce("_skip", F.lit(False)) | X.is_generic_name(F.col("folded"))).alias("generic"))


@query("agreeing_programs", _REGISTER_SQL + f"SELECT DISTINCT x.folded, x.program FROM x JOIN own ON own.program = x.program WHERE x.folded <> '' AND (contains(x.folded, gm) OR contains(gm, x.folded) OR coalesce((SELECT bool_or(CASE WHEN length(w) < 5 THEN regexp_matches(x.folded, '(^|[^a-z0-9])' || w || '([^a-z0-9]|$)') ELSE contains(x.folded, w) END) FROM (SELECT unnest(own.words) AS w)), false))")
def agreeing_programs(spark, d):
    """Names that look like their program already."""
    x = register.with_folded(_part_names(spark, d), "program").select("folded", "program").filter("folded <> ''").distinct()
    return x.filter(register.agrees_with_name(F.col("folded"), F.col("program")))


@query("picked_soundfonts")
def picked_soundfonts(spark, d):
    """A soundfont and an effect of each song's categories, as the same seeds chose them before."""
    fonts = table(spark, d, "part").groupBy(X.gm_class((F.col("p_partkey") % 128).cast("int"), F.lit(False)).alias("gm_class")).agg(F.array_sort(F.collect_set("p_brand")).alias("fonts"))
    x = _gm(A.stems(spark, d)).select("song_id", "category", "gm_class").distinct().join(fonts, "gm_class")
    x = x.groupBy("song_id", "category").agg(F.max_by("fonts", "gm_class").alias("fonts"))
    seed, key = F.lit(7), (F.col("song_id"), F.col("category"))
    effects = F.array(*map(F.lit, ("dry", "light", "warm")))
    return x.select(*key, picks.pick(F.col("fonts"), seed, *key).alias("soundfont_id"), picks.pick(effects, seed, *key, F.lit("fx")).alias("fx"))


@query("selected_patches")
def selected_patches(spark, d):
    """A program of the class's pool for each song and class; classes without a pool keep theirs."""
    pools = {c: tuple(range(8 * k, 8 * k + 1 + k % 5)) for k, c in enumerate(V.GM_CLASSES[:12])}
    x = _gm(A.stems(spark, d)).filter("not is_drum").select("song_id", "gm_class", "program").distinct()
    options = picks.candidates(pools, F.array("gm_class"))
    return x.select("song_id", "gm_class", "program", picks.select_patch(F.col("program"), options, F.lit(7), F.col("song_id"), F.col("gm_class")).alias("patch"))


@query("covered_songs", ", fi AS (SELECT DISTINCT song_id, track, bytes FROM raw_stems WHERE pass_no = 0), n AS (SELECT fi.song_id, bool_and(s.song_id IS NOT NULL) AS covered FROM fi LEFT JOIN (SELECT DISTINCT song_id, track, bytes FROM stems) s ON s.song_id = fi.song_id AND s.track = fi.track AND s.bytes = fi.bytes GROUP BY 1) SELECT song_id, covered FROM n")
def covered_songs(spark, d):
    """Songs whose first pass's files are all there still, with their sizes."""
    files_of = lambda x: x.select("song_id", "track", "bytes")
    return M.covers(files_of(A.raw_stems(spark, d).filter("pass_no = 0")), files_of(A.stems(spark, d)), "song_id", ["track", "bytes"])


@query("claimed_on_disk", """, c AS (SELECT DISTINCT pass, song_id, track FROM raw_stems WHERE pass = 'ddsp_piano' UNION SELECT DISTINCT pass, song_id, track FROM recipe_rows WHERE pass = 'midi_ddsp'), f AS (SELECT DISTINCT song_id, track FROM stems WHERE present AND bytes > 0)
  SELECT pass, count(*) AS claimed, count(f.song_id) AS on_disk FROM c LEFT JOIN f ON f.song_id = c.song_id AND f.track = c.track GROUP BY 1""")
def claimed_on_disk(spark, d):
    """What each neural pass claims; the second one's stem table is empty, so its recipe speaks for it."""
    raw, keys = A.raw_stems(spark, d), ["song_id", "track"]
    listing = A.stems(spark, d).select(*keys, F.when(F.col("present"), F.col("bytes")).otherwise(0).alias("bytes"))
    out = None
    for name, stems in (("ddsp_piano", raw.filter("pass = 'ddsp_piano'")), ("midi_ddsp", raw.filter("pass = 'midi_ddsp' and wall_seconds < 0"))):
        x = G.claimed_on_disk([stems, A.recipe_rows(spark, d).filter(F.col("pass") == name)], listing, keys)
        x = x.select(F.lit(name).alias("pass"), "on_disk")
        out = x if out is None else out.unionByName(x)
    return out.groupBy("pass").agg(F.count(F.lit(1)).alias("claimed"), F.count_if("on_disk").alias("on_disk"))


@query("release_summary", f""", t AS (SELECT song_id, count(*) AS n_tracks, count(DISTINCT {_TARGET}) = 4 AS bdgp, sum(bytes) AS bytes FROM stems GROUP BY 1), s AS (SELECT t.*, song_length, chunk FROM t JOIN songs_meta USING (song_id)),
  h AS (SELECT sum(song_length) FILTER (song_length > 0) / 3600 AS h, sum(song_length) FILTER (song_length > 0 AND n_tracks >= 2) / 3600 AS m FROM s)
  SELECT count(*) AS songs, sum(n_tracks)::BIGINT AS stems, round(any_value(h), 1) AS hours, count(*) FILTER (n_tracks >= 2) AS multitrack_songs, round(any_value(m), 1) AS multitrack_hours, round(count(*) FILTER (n_tracks >= 2) / count(*)::DOUBLE, 4) AS multitrack_song_share,
    round(any_value(m) / any_value(h), 4) AS multitrack_hour_share, round(avg(n_tracks), 6) AS mean_stems, median(n_tracks)::DOUBLE AS median_stems, max(n_tracks) AS most_stems, count(*) FILTER (bdgp) AS bdgp_songs, count(DISTINCT chunk) AS chunks, round(sum(bytes) / count(DISTINCT chunk)::DOUBLE / 1073741824, 6) AS chunk_gib FROM s, h""")
def release_summary(spark, d):
    """A24."""
    program, drum = F.col("program"), F.col("is_drum")
    t = A.stems(spark, d).groupBy("song_id").agg(F.count(F.lit(1)).alias("n_tracks"), (F.countDistinct(X.separation_target(program, drum)) == 4).alias("bdgp"), F.sum("bytes").alias("bytes"))
    s = t.join(A.songs_meta(spark, d).select("song_id", "song_length", "chunk"), "song_id")
    return I.release_summary(s, s.select("chunk", "bytes"))


@query("numbered_manifest", _GM_SQL + ", o AS (SELECT DISTINCT song_id, category FROM g) SELECT song_id, category, row_number() OVER (PARTITION BY category ORDER BY song_id) - 1 AS place FROM o")
def numbered_manifest(spark, d):
    """C48."""
    return files.numbered(_gm(A.stems(spark, d)).select("song_id", "category").distinct(), "category", "song_id")


@query("downmixed", ", p AS (SELECT w.vec_id, w.x AS a, coalesce(v.x, w.x) AS b FROM waveforms w LEFT JOIN waveforms v ON v.vec_id = w.vec_id + 1) SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs((a[i] + b[i]) / 2))), 9) AS loud FROM p")
def downmixed(spark, d):
    """K21."""
    w = A.waveforms(spark, d).select("vec_id", F.col("x").alias("a"))
    v = w.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    x = w.join(v, "vec_id", "left").select("vec_id", K.downmix(F.col("a"), F.coalesce("b", "a")).alias("m"))
    return x.select("vec_id", F.round(F.aggregate("m", F.lit(0.0), lambda s, e: s + F.abs(e)), 9).alias("loud"))


@query("finite_values", "SELECT event_id, CASE WHEN isfinite(value / nullif(value - 6.55, 0)) THEN round(value / (value - 6.55), 9) END AS ratio FROM events")
def finite_values(spark, d):
    """Divisions by zero are null, not infinite."""
    e = table(spark, d, "events")
    ratio = F.col("value") / F.when(F.col("value") != 6.55, F.col("value") - 6.55)
    return e.select("event_id", F.round(files.finite(F.coalesce(ratio, F.lit(float("inf")))), 9).alias("ratio"))


@query("merged_catalogs", ", c AS (SELECT p_brand || p_size AS id, p_name AS title, 0 AS o, p_partkey FROM part WHERE p_size <= 30 UNION ALL SELECT p_brand || p_size, p_type, 1, p_partkey FROM part WHERE p_size > 20), k AS (SELECT id, o, min(title) AS title FROM c GROUP BY 1, 2) SELECT id, title FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY o DESC) = 1")
def merged_catalogs(spark, d):
    """Two soundfont catalogs by id; the later one wins."""
    part = table(spark, d, "part").withColumn("id", F.concat("p_brand", F.col("p_size").cast("string")))
    one = lambda rows, c: part.filter(rows).groupBy("id").agg(F.min(c).alias("title"))
    return files.merge_catalogs(one("p_size <= 30", "p_name"), one("p_size > 20", "p_type")).select("id", "title")


@query("nested_votes", "SELECT card_id, category, variant_id, tier, count(*) AS n FROM votes GROUP BY ALL")
def nested_votes(spark, d):
    """Votes of nested responses, a row each."""
    v = A.votes(spark, d).withColumn("session", F.pmod(F.xxhash64("card_id"), F.lit(500)))
    vote = F.struct("card_id", "category", F.lit("").alias("stem_id"), F.col("clip_id").cast("string").alias("clip_id"), "variant_id", "tier")
    responses = v.groupBy("session").agg(F.collect_list(vote).alias("votes"))  # a session's votes are one document
    return files.votes_rows(responses).groupBy("card_id", "category", "variant_id", "tier").agg(F.count(F.lit(1)).alias("n"))


@query("needles_of_programs", _REGISTER_SQL + "SELECT needle, needles.program, count(*) AS songs FROM needles JOIN (SELECT DISTINCT song_id, program FROM x) y ON y.program = needles.program WHERE o = 3 GROUP BY 1, 2")
def needles_of_programs(spark, d):
    """The needles that tell one program, and the songs that have it."""
    x = _part_names(spark, d).select("song_id", "program").distinct()
    return I.counts(x.join(register.gm_needles(spark), "program"), "needle", "program").withColumnRenamed("n", "songs")
