"""Registered queries of the catalog over the star-schema tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemloom.functions import exprs as X
from stemloom.functions import values as V
from stemloom.operators import documents as O
from stemloom.operators import inventory as I
from stemloom.operators import listening as L
from stemloom.operators import merge as M
from stemloom.operators import packing, register
from stemloom.operators import sampling as P
from stemloom.operators import signal as K
from stemloom.operators import songs as S
from stemloom.operators.dedupe import keep_first, keep_last
from stemloom.session import table
from stemloom.sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` stands after the WITH clause of the adapter views."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            text = sql.strip()
            ORACLE[name] = A.VIEWS_SQL + (", " + text[1:] if text.startswith(",") else text)
        return f

    return add


def _pipe(c: str, where: str = "true") -> str:
    return f"coalesce(array_to_string(list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL AND {where})), '|'), '')"


_TARGET = "CASE WHEN is_drum THEN 'drums' WHEN program BETWEEN 0 AND 7 THEN 'piano' WHEN program BETWEEN 24 AND 31 THEN 'guitar' WHEN program BETWEEN 32 AND 39 THEN 'bass' END"
_GM_CLASSES = "[" + ", ".join("'" + c + "'" for c in V.GM_CLASSES) + "]"
_GM_NAMES = "[" + ", ".join("'" + n + "'" for n in V.GM_NAMES) + "]"


# --- songs and packaging ---------------------------------------------------------------------------


@query(
    "songs_table",
    f"""SELECT song_id, min_by(name, (track, p1, p2, p3, p4)) FILTER (name IS NOT NULL) AS name, count(*) AS n_tracks, sum(present::INT)::BIGINT AS n_stems_on_disk,
  max(wall_seconds) AS song_length, {_pipe('track')} AS tracks, {_pipe('program')} AS programs, {_pipe(A.CLASS_SQL)} AS gm_classes, {_pipe(_TARGET)} AS targets,
  true AS subset_all, count(DISTINCT {_TARGET}) = 4 AS subset_bdgp, count(*) > 1 AS subset_multitrack FROM stems GROUP BY song_id""",
)
def songs_table(spark, d):
    return S.songs_table(A.stems(spark, d), list(A.ORDER))


@query(
    "songs_table_checked",
    f"""SELECT song_id, count(*) AS n_tracks, sum(present::INT)::BIGINT AS n_stems_on_disk, {_pipe('track', 'present')} AS tracks, {_pipe('program', 'present')} AS programs,
  arg_min_null(name, track) AS head_name FROM stems GROUP BY song_id HAVING sum(present::INT) > 0""",
)
def songs_table_checked(spark, d):
    return S.songs_table_checked(A.stems(spark, d))


@query("multitrack_filter", "SELECT song_id, count(*) AS n_tracks FROM stems GROUP BY song_id HAVING count(*) >= 2")
def multitrack_filter(spark, d):
    return A.stems(spark, d).groupBy("song_id").agg(F.count(F.lit(1)).alias("n_tracks")).filter("n_tracks >= 2")


@query("bdgp_division", f"SELECT song_id FROM stems GROUP BY song_id HAVING count(DISTINCT {_TARGET}) = 4")
def bdgp_division(spark, d):
    return S.divides(A.stems(spark, d), "song_id", X.separation_target(F.col("program"), F.col("is_drum")), S.TARGET_NAMES)


@query(
    "chunk_manifest",
    """SELECT chunk, count(*) AS n_songs, sum(coalesce(n, 0))::BIGINT AS n_stems, sum(coalesce(b, 0))::BIGINT AS bytes FROM songs_meta
  LEFT JOIN (SELECT song_id, count(*) AS n, sum(bytes) AS b FROM stems GROUP BY song_id) USING (song_id) GROUP BY chunk""",
)
def chunk_manifest(spark, d):
    stems = A.stems(spark, d)
    sizes = stems.groupBy("song_id").agg(F.sum("bytes").alias("bytes"))
    return S.chunk_manifest(stems, A.songs_meta(spark, d).select("song_id", "chunk"), sizes)


@query("chunk_paths", "SELECT song_id, track, './chunk_' || chunk || '/' || song_id AS path, './chunk_' || chunk || '/' || song_id || '.mid' AS mid, './chunk_' || chunk || '/' || song_id || '/mix.flac' AS mix FROM stems JOIN songs_meta USING (song_id)")
def chunk_paths(spark, d):
    x = S.matched_or_raise(A.stems(spark, d).select("song_id", "track"), A.songs_meta(spark, d).select("song_id", "chunk"), "song_id", "chunks")
    return S.chunk_paths(x).drop("chunk")


@query("chunk_stats", "SELECT chunk, round(sum(bytes) / 1073741824.0, 9) AS gib, round(sum(bytes) / 1073741824.0 / avg(sum(bytes) / 1073741824.0) OVER (), 6) AS of_mean FROM stems JOIN songs_meta USING (song_id) GROUP BY chunk")
def chunk_stats(spark, d):
    x = A.stems(spark, d).join(A.songs_meta(spark, d), "song_id").groupBy("chunk").agg((F.sum("bytes") / 1073741824.0).alias("g"))
    return x.select("chunk", F.round("g", 9).alias("gib"), F.round(F.col("g") / F.avg("g").over(W.partitionBy(F.lit(0))), 6).alias("of_mean"))


@query("chunk_parts", "SELECT (chunk % 2 + 1)::INT AS part, array_to_string(list_sort(list(DISTINCT chunk)), '|') AS chunks FROM songs_meta GROUP BY 1")
def chunk_parts(spark, d):
    return M.partition_ids(A.songs_meta(spark, d), "chunk")


@query("part_bytes", "SELECT chunk % 2 + 1 AS part, (sum(coalesce(bytes, 0)) + 1000)::BIGINT AS bytes FROM songs_meta LEFT JOIN stems USING (song_id) GROUP BY 1")
def part_bytes(spark, d):
    x = A.songs_meta(spark, d).join(A.stems(spark, d).select("song_id", "bytes"), "song_id", "left")
    return x.groupBy(X.download_part(F.col("chunk")).alias("part")).agg((F.sum(F.coalesce("bytes", F.lit(0))) + 1000).alias("bytes"))


@query("mix_length_update", "SELECT song_id, CASE WHEN NOT all_valid THEN 1.5::DOUBLE ELSE song_length END AS song_length FROM songs_meta")
def mix_length_update(spark, d):
    s = A.songs_meta(spark, d).select("song_id", "all_valid", "song_length")
    return S.rewritten(s, s.filter("not all_valid").select("song_id", F.lit(1.5).alias("song_length")), "song_id", "song_length").drop("all_valid")


@query("dense_tracks", "SELECT song_id, (row_number() OVER (PARTITION BY song_id ORDER BY track) - 1)::INT AS track, track AS original_track FROM stems WHERE present")
def dense_tracks(spark, d):
    return S.dense_tracks(A.stems(spark, d).filter("present").select("song_id", "track"))


@query("velocity_scales", "SELECT song_id, track, CASE WHEN max(program) OVER w <= 0 THEN 1.0 WHEN program <= 0 THEN 0.0 ELSE program::DOUBLE / max(program) OVER w END::DOUBLE AS scale FROM stems WINDOW w AS (PARTITION BY song_id)")
def velocity_scales(spark, d):
    return S.velocity_scales(A.stems(spark, d).select("song_id", "track", F.col("program").cast("double").alias("peak"))).drop("peak")


@query("complete_maps", "SELECT song_id, CASE WHEN count(*) FILTER (name IS NULL) = 0 THEN array_to_string(list(track || ':' || name ORDER BY track), '|') END AS scales FROM stems GROUP BY song_id")
def complete_maps(spark, d):
    x = S.complete_map(A.stems(spark, d), "song_id", "track", "name")
    text = F.array_join(F.transform(F.map_entries("scales"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"])), "|")
    return x.select("song_id", F.when(F.col("scales").isNotNull(), text).alias("scales"))


@query("claimed_paths", "SELECT song_id, array_to_string(list_sort(list(DISTINCT track || '.flac')), '|') AS files FROM stems WHERE present GROUP BY song_id")
def claimed_paths(spark, d):
    return A.stems(spark, d).filter("present").groupBy("song_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.col("track").cast("string"), F.lit(".flac")))), "|").alias("files"))


@query("song_sizes", "SELECT song_id, sum(bytes)::BIGINT AS bytes FROM stems GROUP BY song_id")
def song_sizes(spark, d):
    return A.stems(spark, d).groupBy("song_id").agg(F.sum("bytes").alias("bytes"))


@query("lpt_packing")
def lpt_packing(spark, d):
    return packing.pack(song_sizes(spark, d), 64)


# --- inventory -------------------------------------------------------------------------------------


def _gm(stems: DataFrame) -> DataFrame:
    p, drum = F.col("program"), F.col("is_drum")
    return stems.select("*", X.gm_id(p, drum).alias("gm_id"), X.gm_class(p, drum).alias("gm_class"), X.probe_category(p, drum, F.col("name")).alias("category"))


_GM_SQL = f", g AS (SELECT *, CASE WHEN is_drum THEN 128 ELSE program END AS gm_id, {A.CLASS_SQL} AS gm_class, {A.CATEGORY_SQL} AS category FROM stems) "


@query(
    "gm_report",
    _GM_SQL + """SELECT gm_id, gm_class, category, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM g), 6) AS pct FROM g GROUP BY GROUPING SETS ((gm_id), (gm_class), (category))""",
)
def gm_report(spark, d):
    return I.shares(_gm(A.stems(spark, d)), [["gm_id"], ["gm_class"], ["category"]], ["gm_id", "gm_class", "category"]).drop("level")


@query("gm_class_counts", _GM_SQL + "SELECT gm_class, count(*) AS n FROM g GROUP BY 1")
def gm_class_counts(spark, d):
    return I.counts(_gm(A.stems(spark, d)), "gm_class")


@query("drum_shares", _GM_SQL + "SELECT count(*) AS n, round(avg(is_drum::INT) * 100, 6) AS drum_pct, round(avg((program = 0 AND NOT is_drum)::INT) * 100, 6) AS program0_pct FROM g")
def drum_shares(spark, d):
    s = A.stems(spark, d)
    zero = (F.col("program") == 0) & ~F.col("is_drum")
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("is_drum").cast("int")) * 100, 6).alias("drum_pct"), F.round(F.avg(zero.cast("int")) * 100, 6).alias("program0_pct"))


_CATS = "(VALUES " + ", ".join(f"({k}, '{c}')" for k, c in enumerate(V.CATEGORIES)) + ") AS c(place, category)"


@query("category_counts", _GM_SQL + f"SELECT place::INT AS place, category, coalesce(n, 0) AS n FROM {_CATS} LEFT JOIN (SELECT category, count(*) AS n FROM g GROUP BY 1) USING (category)")
def category_counts(spark, d):
    return I.with_dimension(I.counts(_gm(A.stems(spark, d)), "category"), I.dimension(spark, "category", V.CATEGORIES), "category", {"n": 0}).select("place", "category", "n")


_HOURS = "count(*) AS n, round(sum(wall_seconds) / 3600, 6) AS wall_hours, round(sum(active_seconds) / 3600, 6) AS active_hours, round(CASE WHEN sum(wall_seconds) > 0 THEN sum(active_seconds) / sum(wall_seconds) ELSE 0 END, 6) AS active_frac"


@query("program_hours", _GM_SQL + f"SELECT gm_id, {_HOURS} FROM g GROUP BY 1")
def program_hours(spark, d):
    return I.hours(_gm(A.stems(spark, d)), "gm_id")


@query("category_hours_dim", _GM_SQL + f", h AS (SELECT category, {_HOURS} FROM g GROUP BY 1) SELECT place::INT AS place, category, coalesce(n, 0) AS n, coalesce(wall_hours, 0) AS wall_hours, coalesce(active_hours, 0) AS active_hours, coalesce(active_frac, 0) AS active_frac FROM {_CATS} LEFT JOIN h USING (category)")
def category_hours_dim(spark, d):
    h = I.hours(_gm(A.stems(spark, d)), "category")
    return I.with_dimension(h, I.dimension(spark, "category", V.CATEGORIES), "category", {"n": 0, "wall_hours": 0.0, "active_hours": 0.0, "active_frac": 0.0}).select("place", *h.columns)


@query("attach_active_hours", _GM_SQL + ", a AS (SELECT gm_id, round(sum(active_seconds) / 3600, 6) AS active_hours FROM g WHERE present GROUP BY 1) SELECT gm_id, n, coalesce(active_hours, 0) AS active_hours FROM (SELECT gm_id, count(*) AS n FROM g GROUP BY 1) LEFT JOIN a USING (gm_id)")
def attach_active_hours(spark, d):
    g = _gm(A.stems(spark, d))
    a = g.filter("present").groupBy("gm_id").agg(F.round(F.sum("active_seconds") / 3600, 6).alias("active_hours"))
    return I.counts(g, "gm_id").join(a, "gm_id", "left").na.fill({"active_hours": 0.0})


@query("programs_top", f", n AS (SELECT program, count(*) AS n FROM stems WHERE NOT is_drum GROUP BY 1) SELECT program, n, ({_GM_NAMES})[program + 1] AS label FROM n ORDER BY n DESC, program LIMIT 20")
def programs_top(spark, d):
    x = I.top_n(I.counts(A.stems(spark, d).filter("not is_drum"), "program"), "program", 20)
    return x.select("program", "n", X.program_name(F.col("program")).alias("label"))


@query("gm_labels", _GM_SQL + f"SELECT DISTINCT gm_id, CASE WHEN gm_id = 128 THEN '128: Drums (channel 10)' ELSE gm_id || ': ' || ({_GM_NAMES})[gm_id + 1] END AS label, CASE WHEN gm_id = 128 THEN 'Drums' ELSE ({_GM_NAMES})[gm_id + 1] || ' (' || gm_id || ')' END AS paper FROM g")
def gm_labels(spark, d):
    g = _gm(A.stems(spark, d)).select("gm_id").distinct()
    return g.select("gm_id", X.gm_id_label(F.col("gm_id")).alias("label"), X.gm_paper_label(F.col("gm_id")).alias("paper"))


@query("top_n_other", ", n AS (SELECT coalesce(name, '-') AS name, count(*) AS n FROM stems GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS rn FROM n) SELECT CASE WHEN rn <= 5 THEN name ELSE 'Other' END AS bucket, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def top_n_other(spark, d):
    return I.top_n_other(I.counts(A.stems(spark, d).select(F.coalesce("name", F.lit("-")).alias("name")), "name"), "name", 5)


@query("top_n_keep_drums", _GM_SQL + ", n AS (SELECT gm_id, count(*) AS n FROM g GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN gm_id = 128 THEN 0 ELSE 1 END, n DESC, gm_id) AS rn FROM n) SELECT CASE WHEN rn <= 12 THEN gm_id::VARCHAR ELSE 'Other' END AS bucket, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def top_n_keep_drums(spark, d):
    return I.top_n_other(I.counts(_gm(A.stems(spark, d)), "gm_id"), "gm_id", 12, keep=F.col("gm_id") == 128)


@query("share_compare", _GM_SQL + ", a AS (SELECT gm_class, count(*) AS n FROM g GROUP BY 1), b AS (SELECT gm_class, count(*) AS n FROM g WHERE present GROUP BY 1) SELECT a.gm_class, a.n AS n_a, round(a.n / (SELECT sum(n) FROM a), 9) AS share_a, coalesce(b.n, 0) AS n_b, coalesce(round(b.n / (SELECT sum(n) FROM b), 9), 0) AS share_b FROM a LEFT JOIN b USING (gm_class) ORDER BY n_a DESC, gm_class LIMIT 10")
def share_compare(spark, d):
    g = _gm(A.stems(spark, d))
    return I.compared(I.counts(g, "gm_class"), I.counts(g.filter("present"), "gm_class"), "gm_class", 10)


@query("count_labels", _GM_SQL + ", n AS (SELECT gm_class, count(*) AS n FROM g GROUP BY 1), t AS (SELECT *, n * 100.0::DOUBLE / (SELECT count(*) FROM g) AS pct FROM n) SELECT gm_class, CASE WHEN pct > 1 THEN n || ' (' || round_even(pct, 0)::BIGINT || '%)' ELSE n::VARCHAR END AS label FROM t")
def count_labels(spark, d):
    n = I.counts(_gm(A.stems(spark, d)), "gm_class")
    return n.select("gm_class", X.count_label(F.col("n"), F.sum("n").over(W.partitionBy(F.lit(0)))).alias("label"))


@query("name_report", ", s AS (SELECT nullif(trim(regexp_replace(replace(name, ',', ' '), '\\s+', ' ', 'g')), '') AS clean FROM stems) SELECT count(*) AS n, count(clean) AS named, round(count(clean) * 100.0::DOUBLE / count(*), 6) AS named_pct, count(DISTINCT lower(clean)) AS names FROM s")
def name_report(spark, d):
    c = A.stems(spark, d).select(X.sanitize_name(F.col("name")).alias("c"))
    return c.agg(F.count(F.lit(1)).alias("n"), F.count("c").alias("named"), F.round(F.count("c") * 100.0 / F.count(F.lit(1)), 6).alias("named_pct"), F.countDistinct(F.lower("c")).alias("names"))


@query("class_token_counts", f", t AS (SELECT DISTINCT song_id, {A.CLASS_SQL} AS token FROM stems) SELECT token, count(*) AS n FROM t GROUP BY 1")
def class_token_counts(spark, d):
    return I.token_counts(songs_table(spark, d), F.col("gm_classes"))


@query("render_backends", "SELECT CASE WHEN backend = 'midi_ddsp' THEN 'neural' WHEN method = 'basic' THEN 'basic' WHEN method = 'midi-ddsp' AND fallback = 'basic' THEN 'basic' ELSE 'varied' END AS kind, count(*) AS n FROM recipe GROUP BY 1")
def render_backends(spark, d):
    kind = F.when(F.col("backend") == "midi_ddsp", "neural").when(F.col("method") == "basic", "basic").when((F.col("method") == "midi-ddsp") & (F.col("fallback") == "basic"), "basic").otherwise("varied")
    return I.counts(A.recipe(spark, d).select(kind.alias("kind")), "kind")


@query("corpus_summary", "SELECT count(*) AS songs, count(song_length) AS timed, round(sum(CASE WHEN song_length > 0 THEN song_length END) / 3600, 6) AS hours, count(*) FILTER (all_valid) AS valid, count(*) FILTER (all_valid AND rated_deduplicated) AS both_subsets, count(DISTINCT chunk) AS chunks FROM songs_meta")
def corpus_summary(spark, d):
    m = A.songs_meta(spark, d)
    return m.agg(
        F.count(F.lit(1)).alias("songs"), F.count("song_length").alias("timed"), F.round(F.sum(F.when(F.col("song_length") > 0, F.col("song_length"))) / 3600, 6).alias("hours"),
        F.count_if("all_valid").alias("valid"), F.count_if(F.col("all_valid") & F.col("rated_deduplicated")).alias("both_subsets"), F.countDistinct("chunk").alias("chunks"),
    )


@query("subset_filter", "SELECT song_id FROM songs_meta WHERE all_valid AND rated_deduplicated")
def subset_filter(spark, d):
    return A.songs_meta(spark, d).filter("all_valid and rated_deduplicated").select("song_id")


# --- histograms ------------------------------------------------------------------------------------


@query("tracks_hist_overflow", ", n AS (SELECT least(count(*), 5)::INT AS bin FROM stems GROUP BY song_id), c AS (SELECT bin, count(*) AS n FROM n WHERE bin >= 2 GROUP BY 1) SELECT b.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(2, 6))::INT AS bin) b LEFT JOIN c USING (bin)")
def tracks_hist_overflow(spark, d):
    return I.overflow_histogram(multitrack_filter(spark, d), F.col("n_tracks"), 2, 5)


@query("hours_by_stems", ", n AS (SELECT song_id, count(*) AS n FROM stems GROUP BY 1), c AS (SELECT least(n, 5)::INT AS bin, count(*) AS n, round(sum(song_length) / 3600, 6) AS hours FROM n JOIN songs_meta USING (song_id) WHERE song_length > 0 AND n >= 2 GROUP BY 1) SELECT b.bin, coalesce(n, 0) AS n, coalesce(hours, 0) AS hours FROM (SELECT unnest(range(2, 6))::INT AS bin) b LEFT JOIN c USING (bin)")
def hours_by_stems(spark, d):
    n = A.stems(spark, d).groupBy("song_id").agg(F.count(F.lit(1)).alias("k")).join(A.songs_meta(spark, d), "song_id")
    return I.binned_hours(n, F.col("k"), F.col("song_length"), 5)


EDGES = (0.0, 15.0, 30.0, 60.0, 120.0, 240.0, 380.0, 1000.0)


@query("duration_hist_uneven", ", e(bin, lo, hi) AS (VALUES " + ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(zip(EDGES, EDGES[1:]))) + ") SELECT e.bin, count(*) AS n FROM songs_meta JOIN e ON song_length >= lo AND song_length < hi GROUP BY 1")
def duration_hist_uneven(spark, d):
    return I.edge_histogram(A.songs_meta(spark, d), F.col("song_length"), EDGES)


@query("duration_shares", "SELECT round(avg((song_length <= 120)::INT) * 100, 6) AS le_120, round(avg((song_length <= 380)::INT) * 100, 6) AS le_380 FROM songs_meta")
def duration_shares(spark, d):
    share = lambda s: F.round(F.avg((F.col("song_length") <= s).cast("int")) * 100, 6)
    return A.songs_meta(spark, d).agg(share(120).alias("le_120"), share(380).alias("le_380"))


@query("ecdf", "SELECT DISTINCT program AS value, count(*) OVER (PARTITION BY program) AS n, round(count(*) OVER (ORDER BY program)::DOUBLE / count(*) OVER (), 9) AS fraction FROM stems")
def ecdf(spark, d):
    return I.ecdf(A.stems(spark, d), "program")


@query("percentile_table", ", p AS (SELECT unnest([50.0, 75.0, 90.0, 95.0, 99.0, 99.9])::DOUBLE AS percent, unnest(quantile_cont(song_length, [0.5, 0.75, 0.9, 0.95, 0.99, 0.999])) AS v FROM songs_meta) SELECT percent, round(v, 6) AS value FROM p")
def percentile_table(spark, d):
    return I.percentiles(A.songs_meta(spark, d), "song_length")


@query("duration_summary", "SELECT count(song_length) AS n, round(quantile_cont(song_length, 0.5), 6) AS median, round(quantile_cont(song_length, 0.95), 6) AS p95, round(quantile_cont(song_length, 0.99), 6) AS p99, round(max(song_length), 6) AS max, round(avg(song_length), 6) AS mean FROM songs_meta")
def duration_summary(spark, d):
    return I.summary(A.songs_meta(spark, d), "song_length")


@query("breakdown_two_level", ", u AS (SELECT r.song_id, max(wall_seconds) AS v, min(genre) AS genre FROM stems r JOIN songs_meta USING (song_id) GROUP BY 1) SELECT genre, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS median, round(max(v), 6) AS max FROM u GROUP BY 1 ORDER BY n DESC, genre LIMIT 3")
def breakdown_two_level(spark, d):
    x = A.stems(spark, d).select("song_id", "wall_seconds").join(A.songs_meta(spark, d).select("song_id", "genre"), "song_id")
    return I.two_level(x, "song_id", "genre", "wall_seconds", 3)


# --- joins -----------------------------------------------------------------------------------------


@query(
    "stem_soundfonts_provenance",
    """, j AS (SELECT s.song_id, s.track, r.category, r.method, r.backend, CASE WHEN trim(coalesce(r.soundfont_id, '')) <> '' THEN 'recorded' WHEN r.backend IS NULL THEN 'missing_recipe'
  WHEN r.backend IN ('midi_ddsp', 'ddsp_piano') THEN 'neural' WHEN r.method = 'slakh' OR (r.method = 'midi-ddsp' AND r.fallback = 'slakh') THEN 'slakh_unlogged' ELSE 'basic_default' END AS provenance, r.soundfont_id AS own
  FROM stems s LEFT JOIN recipe r USING (song_id, track)) SELECT song_id, track, category, method, backend, CASE provenance WHEN 'recorded' THEN trim(own) WHEN 'basic_default' THEN 'basic' END AS soundfont_id, provenance FROM j""",
)
def stem_soundfonts_provenance(spark, d):
    return M.provenance(A.stems(spark, d), A.recipe(spark, d))


_SPECS = [(c, "midi-ddsp" if c in ("piano", "strings", "wind") else "basic" if c in ("drums", "mallet") else "slakh", "slakh" if c in ("strings", "piano") else "basic") for c in V.CATEGORIES if c != "organ"]


@query(
    "recipe_conflicts",
    _GM_SQL + ", w(category, wm, wf) AS (VALUES " + ", ".join(str(s) for s in _SPECS) + """), j AS (SELECT g.song_id, g.track, coalesce(r.category, g.category) AS category, r.method, r.fallback FROM g LEFT JOIN recipe r USING (song_id, track)),
  k AS (SELECT song_id, track, j.category, CASE WHEN wm IS NULL THEN 'unknown_category' WHEN method IS NULL THEN 'missing' WHEN method IS DISTINCT FROM wm OR fallback IS DISTINCT FROM wf THEN 'differs' END AS conflict FROM j LEFT JOIN w USING (category)) SELECT * FROM k WHERE conflict IS NOT NULL""",
)
def recipe_conflicts(spark, d):
    wanted = spark.createDataFrame(_SPECS, "category string, method string, fallback string")
    return M.conflicts(_gm(A.stems(spark, d)), A.recipe(spark, d), wanted)


@query("fallback_reasons", ", f AS (SELECT song_id, track, nullif(reason, '') AS reason FROM recipe WHERE method = 'midi-ddsp' AND backend = 'fluidsynth') SELECT coalesce(f.reason, s.pass) AS reason, count(*) AS n FROM f LEFT JOIN stems s USING (song_id, track) GROUP BY 1")
def fallback_reasons(spark, d):
    f = A.recipe(spark, d).filter(X.is_neural_fallback(F.col("method"), F.col("backend"), F.col("reason"), ("polyphonic",)))
    x = f.select("song_id", "track", F.nullif("reason", F.lit("")).alias("own")).join(A.stems(spark, d).select("song_id", "track", "pass"), ["song_id", "track"], "left")
    return I.counts(x.select(F.coalesce("own", "pass").alias("reason")), "reason")


@query("pending_anti", "SELECT song_id, track FROM recipe p WHERE backend = 'pending_midi_ddsp' AND NOT EXISTS (SELECT 1 FROM raw_stems s WHERE s.song_id = p.song_id AND s.track = p.track AND s.pass = 'midi_ddsp')")
def pending_anti(spark, d):
    return M.delete_keys(A.recipe(spark, d).filter("backend = 'pending_midi_ddsp'").select("song_id", "track"), A.raw_stems(spark, d).filter("pass = 'midi_ddsp'"), ["song_id", "track"])


@query("semi_bdgp", f"SELECT song_id, track FROM stems WHERE song_id IN (SELECT song_id FROM stems GROUP BY song_id HAVING count(DISTINCT {_TARGET}) = 4)")
def semi_bdgp(spark, d):
    return M.restrict(A.stems(spark, d), bdgp_division(spark, d), ["song_id"]).select("song_id", "track")


@query("target_paths", f", t AS (SELECT song_id, track, {_TARGET} AS target FROM stems) SELECT song_id, target, array_to_string(list(track ORDER BY track), '|') AS tracks FROM t WHERE target IS NOT NULL GROUP BY 1, 2")
def target_paths(spark, d):
    x = A.stems(spark, d).select("song_id", "track", X.separation_target(F.col("program"), F.col("is_drum")).alias("target")).filter("target is not null")
    return x.groupBy("song_id", "target").agg(F.array_join(F.transform(F.sort_array(F.collect_list("track")), lambda t: t.cast("string")), "|").alias("tracks"))


@query("program_lookup", "SELECT s.song_id, s.track, coalesce(r.program, -1) AS program FROM stems s LEFT JOIN (SELECT song_id, track, program FROM recipe WHERE category = 'piano') r USING (song_id, track)")
def program_lookup(spark, d):
    r = A.recipe(spark, d).filter("category = 'piano'")
    return M.lookup(A.stems(spark, d).select("song_id", "track"), r, ["song_id", "track"], "program", F.lit(-1))


BASE_OF = {"purchase": "view", "signup": "click"}


@query(
    "content_diff",
    """, b AS (SELECT listener_id, trial_id, variant_id AS base_id, content AS base_content FROM ratings WHERE variant_id NOT IN ('purchase', 'signup') QUALIFY row_number() OVER (PARTITION BY listener_id, trial_id, variant_id ORDER BY event_id) = 1),
  w AS (SELECT *, CASE variant_id WHEN 'purchase' THEN 'view' WHEN 'signup' THEN 'click' END AS base_id FROM ratings)
  SELECT event_id, CASE WHEN w.base_id IS NOT NULL THEN content - base_content WHEN content IS NOT NULL THEN 0.0 END AS content_diff FROM w LEFT JOIN b USING (listener_id, trial_id, base_id)""",
)
def content_diff(spark, d):
    return L.content_difference(A.ratings(spark, d), BASE_OF, ["event_id"]).select("event_id", "content_diff")


@query(
    "leaderboard",
    """, m AS (SELECT category, variant_id, avg(realism) AS r, avg(content) AS c FROM ratings GROUP BY 1, 2), t AS (SELECT *, r >= max(r) OVER (PARTITION BY category) - 1e-9 AS won FROM m)
  SELECT category, array_to_string(list(variant_id ORDER BY variant_id) FILTER (won), ',') AS winner, round(max(r), 6) AS realism, round(max(c) FILTER (won), 6) AS content, round(max(r) - max(r) FILTER (NOT won), 6) AS margin FROM t GROUP BY 1""",
)
def leaderboard(spark, d):
    r = A.ratings(spark, d).groupBy("category", "variant_id")
    return L.leaderboard(r.agg(F.avg("realism").alias("mean")), r.agg(F.avg("content").alias("mean")))


@query(
    "equivalence_expand",
    """, q(trial_id, duplicate, donor) AS (VALUES (1, 'signup', 'view'), (2, 'error', 'click'), (3, 'new', 'click')),
  made AS (SELECT r.listener_id, r.trial_id, q.duplicate AS variant_id, r.event_id, r.variant_id AS source FROM ratings r JOIN q ON r.trial_id = q.trial_id AND r.variant_id = q.donor
    WHERE NOT EXISTS (SELECT 1 FROM ratings o WHERE o.listener_id = r.listener_id AND o.trial_id = r.trial_id AND o.variant_id = q.duplicate))
  SELECT listener_id, trial_id, variant_id, event_id, NULL AS source FROM ratings UNION ALL SELECT listener_id, trial_id, variant_id, event_id, source FROM made""",
)
def equivalence_expand(spark, d):
    q = spark.createDataFrame([(1, "signup", "view"), (2, "error", "click"), (3, "new", "click")], "trial_id long, duplicate string, donor string")
    return L.expand_equivalences(A.ratings(spark, d), q).select("listener_id", "trial_id", "variant_id", "event_id", "source")


@query("probe_variant_cross", ", v AS (SELECT DISTINCT event_type AS variant_id FROM events), p AS (SELECT s.* FROM stems s WHERE is_drum) SELECT song_id, track, variant_id FROM p, v WHERE NOT (track = 1 AND variant_id = 'view')")
def probe_variant_cross(spark, d):
    """Probes with every variant of a fixed list, less those that exist: an explode, not a cross join."""
    probes = A.stems(spark, d).filter("is_drum").select("song_id", "track")
    tasks = probes.withColumn("variant_id", F.explode(F.array(*map(F.lit, ("view", "error", "click", "purchase", "signup")))))
    done = tasks.filter("track = 1 and variant_id = 'view'")
    return M.delete_keys(tasks, done, ["song_id", "track", "variant_id"])


def _part_names(spark, d):
    """Stems with long track names: their own, then the brand and name of their part; of unnamed ones some have the part's name."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("p2"), "p_brand", "p_name", "p_size")
    full = F.coalesce(F.concat_ws(" ", F.col("name"), "p_brand", "p_name"), F.lit(""))
    name = F.when(F.col("name").isNotNull(), full).when(F.col("p_size") > 25, F.col("p_name"))
    return A.stems(spark, d).join(part, "p2").select("song_id", "track", name.alias("name"), "program", "is_drum")


def _part_aliases(spark, d):
    """An alias dimension of hundreds of entries: brands with part names, words of part names, and names that tell nothing."""
    part, program = table(spark, d, "part"), (F.min("p_partkey") % 128).cast("int").alias("program")
    none = F.lit(None).cast("string").alias("gm_class")
    brands = part.filter("p_size > 40").groupBy(F.concat_ws(" ", "p_brand", "p_name").alias("needle")).agg(program).select(F.lit("alias").alias("list"), "needle", "program", none)
    words = part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("needle")).groupBy("needle").agg(program)
    words = words.select(F.lit("family").alias("list"), "needle", "program", X.gm_class(F.col("program"), F.lit(False)).alias("gm_class"))
    skip = part.filter("p_name LIKE 'old %'").select(F.lit("skip").alias("list"), F.col("p_name").alias("needle"), F.lit(None).cast("int").alias("program"), none).distinct()
    return register.dimension(brands.unionByName(words).unionByName(skip))


_STOP = "[" + ", ".join(f"'{w}'" for w in V.GM_STOPWORDS) + "]"
_HAS = "CASE WHEN length({n}) < 5 THEN regexp_matches({f}, '(^|[^a-z0-9])' || {n} || '([^a-z0-9]|$)') ELSE contains({f}, {n}) END"
_REGISTER_SQL = rf""", named AS (SELECT song_id, track, program, is_drum, CASE WHEN name IS NOT NULL THEN name || ' ' || p_brand || ' ' || p_name WHEN p_size > 25 THEN p_name END AS name FROM stems JOIN part ON p_partkey = p2),
  x AS (SELECT *, coalesce(lower(strip_accents(trim(regexp_replace(translate(name, ',', ' '), '\s+', ' ', 'g')))), '') AS folded FROM named),
  gm AS (SELECT unnest(range(128)) AS program, regexp_replace(lower(unnest({_GM_NAMES})), '[()+,/]', ' ', 'g') AS n),
  gm_words AS (SELECT program, trim(regexp_replace(n, ' +', ' ', 'g')) AS needle FROM gm UNION SELECT program, w FROM (SELECT program, unnest(string_split(n, ' ')) AS w FROM gm) WHERE length(w) >= 4 AND w NOT IN (SELECT unnest({_STOP}))),
  needles AS (SELECT 1 AS o, lower(p_brand || ' ' || p_name) AS needle, (min(p_partkey) % 128)::INT AS program, NULL AS cls FROM part WHERE p_size > 40 GROUP BY 2
    UNION ALL SELECT 2, w, program, ({_GM_CLASSES})[program // 8 + 1] FROM (SELECT w, (min(p_partkey) % 128)::INT AS program FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w)
    UNION ALL SELECT 3, needle, min(program)::INT, NULL FROM gm_words WHERE length(needle) >= 4 GROUP BY needle HAVING count(DISTINCT program) = 1),
  h AS (SELECT DISTINCT folded, o, needle, needles.program, cls, length(needle) AS len FROM (SELECT DISTINCT folded FROM x WHERE folded <> '') JOIN needles ON {_HAS.format(n='needle', f='folded')}),
  first_list AS (SELECT folded, min(o) AS o FROM h GROUP BY 1), longest AS (SELECT folded, o, max(len) AS len FROM h JOIN first_list USING (folded, o) GROUP BY 1, 2),
  best AS (SELECT folded, o, min(needle) AS needle, min(program) AS low, max(program) AS high, min_by(cls, needle) AS cls FROM h JOIN longest USING (folded, o, len) GROUP BY 1, 2),
  own AS (SELECT program, lower(({_GM_NAMES})[program + 1]) AS gm, list(w) FILTER (length(w) >= 4 AND w NOT IN (SELECT unnest({_STOP}))) AS words FROM (SELECT program, unnest(string_split(n, ' ')) AS w FROM gm) GROUP BY program),
  skips AS (SELECT DISTINCT p_name FROM part WHERE p_name LIKE 'old %'),
  d AS (SELECT x.*, best.needle, low, CASE WHEN is_drum THEN 'skipped_drum' WHEN x.folded = '' THEN 'skipped_unnamed'
    WHEN x.folded IN (SELECT p_name FROM skips) OR regexp_matches(x.folded, '^((track|part|staff|channel)[\s_\-]*\d+|\d+)$') OR contains(x.folded, 'musicxml') THEN 'skipped_generic'
    WHEN contains(x.folded, gm) OR contains(gm, x.folded) OR coalesce((SELECT bool_or({_HAS.format(n='w', f='x.folded')}) FROM (SELECT unnest(own.words) AS w)), false) THEN 'keep'
    WHEN best.needle IS NULL THEN 'skipped_no_match' WHEN low <> high THEN 'skipped_ambiguous' WHEN low = x.program OR o = 2 AND cls = ({_GM_CLASSES})[x.program // 8 + 1] THEN 'keep_alias' ELSE 'corrected' END AS st
    FROM x LEFT JOIN best ON x.folded = best.folded JOIN own ON own.program = x.program)
"""


@query("resolve_program", _REGISTER_SQL + "SELECT name, replace(st, '_alias', '') AS status, CASE WHEN st IN ('skipped_ambiguous', 'keep_alias', 'corrected') THEN needle END AS match_key, count(*) AS n, sum(CASE WHEN st = 'corrected' THEN low ELSE program END)::BIGINT AS programs FROM d GROUP BY 1, 2, 3")
def resolve_program(spark, d):
    x = register.resolve(_part_names(spark, d), _part_aliases(spark, d))
    return x.groupBy("name", "status", "match_key").agg(F.count(F.lit(1)).alias("n"), F.sum("program_corrected").alias("programs"))


@query("top_corrections", _REGISTER_SQL + "SELECT name, program, low AS program_corrected, count(*) AS n FROM d WHERE st = 'corrected' GROUP BY 1, 2, 3 ORDER BY n DESC, name, program LIMIT 25")
def top_corrections(spark, d):
    return O.top_corrections(register.resolve(_part_names(spark, d), _part_aliases(spark, d)), 25)


@query("needle_theta", ", n(needle) AS (VALUES ('bolt'), ('red'), ('small ring'), ('ring'), ('idge'), ('all')), h AS (SELECT DISTINCT p_name, needle FROM part JOIN n ON CASE WHEN length(needle) < 5 THEN regexp_matches(p_name, '(^|[^a-z0-9])' || needle || '([^a-z0-9]|$)') ELSE contains(p_name, needle) END) SELECT p_name, min(needle) AS needle FROM h WHERE length(needle) = (SELECT max(length(needle)) FROM h x WHERE x.p_name = h.p_name) GROUP BY 1")
def needle_theta(spark, d):
    n = spark.createDataFrame([(x, 0) for x in ("bolt", "red", "small ring", "ring", "idge", "all")], "needle string, program int")
    return register.longest_hits(table(spark, d, "part").select(F.col("p_name").alias("folded")).distinct(), n).select(F.col("folded").alias("p_name"), "needle")


# --- merging ---------------------------------------------------------------------------------------

_KEYS = ["song_id", "track"]


@query("keep_last", "SELECT song_id, track, program, p2 FROM stems")
def keep_last_query(spark, d):
    return A.stems(spark, d).select("song_id", "track", "program", "p2")


@query("merge_shards", "SELECT song_id, track, pass, program FROM raw_stems QUALIFY row_number() OVER (PARTITION BY song_id, track ORDER BY pass_no DESC, p1 DESC, p2 DESC, p3 DESC, p4 DESC) = 1")
def merge_shards(spark, d):
    raw = A.raw_stems(spark, d)
    return M.merge_shards([raw.filter(F.col("pass") == p) for p in A.PASSES], _KEYS, list(A.ORDER)).select(*_KEYS, "pass", "program")


@query("upsert_replace", ", i AS (SELECT * FROM raw_stems WHERE pass_no = 2) SELECT song_id, track, program, pass FROM stems s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.song_id = s.song_id AND i.track = s.track) UNION ALL SELECT song_id, track, program, pass FROM i")
def upsert_replace(spark, d):
    c = [*_KEYS, "program", "pass"]
    return M.upsert(A.stems(spark, d).select(*c), A.raw_stems(spark, d).filter("pass_no = 2").select(*c), _KEYS)


@query("frozen_wins_union", ", f AS (SELECT song_id, 0 AS chunk FROM songs_meta WHERE rated_deduplicated), n AS (SELECT song_id, chunk FROM songs_meta) SELECT * FROM f UNION ALL SELECT * FROM n WHERE song_id NOT IN (SELECT song_id FROM f)")
def frozen_wins_union(spark, d):
    m = A.songs_meta(spark, d)
    return M.frozen_wins(m.filter("rated_deduplicated").select("song_id", F.lit(0).alias("chunk")), m.select("song_id", "chunk"), "song_id")


@query("complete_songs", "SELECT song_id, got FROM (SELECT song_id, count(DISTINCT track) AS got FROM raw_stems WHERE pass_no > 0 GROUP BY 1) JOIN (SELECT song_id, count(DISTINCT track) AS n_tracks FROM raw_stems GROUP BY 1) USING (song_id) WHERE got >= n_tracks")
def complete_songs(spark, d):
    raw = A.raw_stems(spark, d)
    return S.complete_songs(raw.filter("pass_no > 0"), raw.groupBy("song_id").agg(F.countDistinct("track").alias("n_tracks")))


@query("missing_routing", ", n AS (SELECT song_id, count(DISTINCT track) AS n FROM stems GROUP BY 1), r AS (SELECT DISTINCT song_id, track - 1 AS track FROM stems WHERE present) SELECT song_id FROM n WHERE (SELECT count(*) FROM r WHERE r.song_id = n.song_id AND r.track < n.n) < n")
def missing_routing(spark, d):
    s = A.stems(spark, d)
    return S.without_cover(s.groupBy("song_id").agg(F.countDistinct("track").alias("n")), s.filter("present").select("song_id", (F.col("track") - 1).alias("track")))


@query(
    "pass_progress",
    """, a AS (SELECT song_id, count(*) FILTER (method = 'midi-ddsp') AS n_neural, count(*) FILTER (method <> 'midi-ddsp') AS n_native FROM recipe GROUP BY 1),
  x AS (SELECT song_id, count(*) FILTER (backend IN ('midi_ddsp', 'ddsp_piano')) AS neural, count(*) FILTER (method = 'midi-ddsp' AND backend = 'fluidsynth') AS fallback, count(*) FILTER (method <> 'midi-ddsp') AS native FROM recipe_rows GROUP BY 1),
  j AS (SELECT a.*, coalesce(neural, 0) AS neural, coalesce(fallback, 0) AS fallback, coalesce(native, 0) AS native FROM a LEFT JOIN x USING (song_id)),
  k AS (SELECT *, least(neural, n_neural) AS nd FROM j), l AS (SELECT *, least(fallback, greatest(0, n_neural - nd)) AS cr FROM k), m AS (SELECT *, least(native + fallback - cr, n_native) AS vd FROM l)
  SELECT song_id, nd AS neural_done, cr AS credit, vd AS native_done, n_neural - nd - cr + n_native - vd AS remaining FROM m""",
)
def pass_progress(spark, d):
    neural = F.col("method") == "midi-ddsp"
    a = A.recipe(spark, d).groupBy("song_id").agg(F.count_if(neural).alias("n_neural"), F.count_if(~neural).alias("n_native"))
    done = A.recipe_rows(spark, d).groupBy("song_id").agg(
        F.count_if(F.col("backend").isin("midi_ddsp", "ddsp_piano")).alias("neural"), F.count_if(neural & (F.col("backend") == "fluidsynth")).alias("fallback"), F.count_if(~neural).alias("native")
    )
    return S.pass_progress(a, done)


@query("pass_pivot", "SELECT song_id, count(*) FILTER (pass = 'fluidsynth') AS n_fluidsynth, count(*) FILTER (pass = 'ddsp_piano') AS n_ddsp_piano, count(*) FILTER (pass = 'midi_ddsp') AS n_midi_ddsp FROM stems GROUP BY 1")
def pass_pivot(spark, d):
    return S.pass_counts(A.stems(spark, d), A.PASSES)


@query("done_by_song", "SELECT song_id, count(*) AS done FROM recipe WHERE backend <> 'pending_midi_ddsp' GROUP BY 1")
def done_by_song(spark, d):
    return A.recipe(spark, d).filter("backend <> 'pending_midi_ddsp'").groupBy("song_id").agg(F.count(F.lit(1)).alias("done"))


@query("claimed_missing", "SELECT DISTINCT song_id, track FROM raw_stems r WHERE pass_no = 1 AND NOT EXISTS (SELECT 1 FROM stems s WHERE s.present AND s.song_id = r.song_id AND s.track = r.track)")
def claimed_missing(spark, d):
    claimed = A.raw_stems(spark, d).filter("pass_no = 1").select(*_KEYS).distinct()
    return M.delete_keys(claimed, A.stems(spark, d).filter("present"), _KEYS)


# --- listening tests -------------------------------------------------------------------------------

_STATS = """, ps AS (SELECT stem_id, category, variant_id, avg(content) AS content, avg(realism) AS realism FROM ratings GROUP BY 1, 2, 3),
 st AS (SELECT category, variant_id, avg(content) AS mean_content, avg(realism) AS mean_realism, min(content) AS min_content, count(DISTINCT stem_id) AS n_stems FROM ps GROUP BY 1, 2) """


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("variant_stats", _STATS + "SELECT category, variant_id, round(mean_content, 6) AS mean_content, round(mean_realism, 6) AS mean_realism, round(min_content, 6) AS min_content, n_stems FROM st")
def variant_stats(spark, d):
    return _rounded(L.variant_stats(A.ratings(spark, d)))


@query("eligible_fallback", _STATS + ", o AS (SELECT *, min_content >= 1 AND mean_content >= 6 AS ok FROM st), p AS (SELECT *, bool_or(ok) OVER () AS any_ok FROM o) SELECT category, variant_id FROM p WHERE ok OR NOT any_ok")
def eligible_fallback(spark, d):
    return L.eligible(L.variant_stats(A.ratings(spark, d)), 1, 6).select("category", "variant_id")


@query("relative_floor", _STATS + ", o AS (SELECT *, mean_content >= greatest(50.0, max(mean_content) OVER () - 20) AS a, mean_content >= 60 AS b FROM st), p AS (SELECT *, bool_or(a) OVER () AS aa, bool_or(b) OVER () AS bb FROM o) SELECT category, variant_id FROM p WHERE a OR (NOT aa AND (b OR NOT bb))")
def relative_floor(spark, d):
    return L.relative_floor(L.variant_stats(A.ratings(spark, d))).select("category", "variant_id")


@query("auto_winner", _STATS + "SELECT category, variant_id, round(mean_realism, 6) AS mean_realism, n_stems FROM st QUALIFY row_number() OVER (PARTITION BY category ORDER BY mean_realism DESC NULLS LAST, mean_content DESC NULLS LAST, variant_id) = 1")
def auto_winner(spark, d):
    return _rounded(L.auto_winners(L.variant_stats(A.ratings(spark, d))).select("category", "variant_id", "mean_realism", "n_stems"))


@query("noise_winner", _STATS + ", o AS (SELECT *, mean_content >= 10 AS passed FROM st), p AS (SELECT *, bool_or(passed) OVER (PARTITION BY category) AS x FROM o) SELECT category, variant_id, passed FROM p WHERE passed OR NOT x QUALIFY row_number() OVER (PARTITION BY category ORDER BY mean_realism DESC NULLS LAST, mean_content DESC NULLS LAST, variant_id) = 1")
def noise_winner(spark, d):
    return L.gated_winners(L.variant_stats(A.ratings(spark, d)), 10).select("category", "variant_id", "passed")


@query("shortlist", _STATS + ", o AS (SELECT *, mean_realism >= 50 AS shortlisted, row_number() OVER (PARTITION BY category ORDER BY mean_realism DESC NULLS LAST, variant_id)::INT AS place FROM st), p AS (SELECT *, bool_or(shortlisted) OVER (PARTITION BY category) AS x FROM o) SELECT category, variant_id, place, shortlisted FROM p WHERE shortlisted OR (NOT x AND place = 1)")
def shortlist(spark, d):
    return L.shortlist(L.variant_stats(A.ratings(spark, d)), 50)


@query("tied_winners", ", m AS (SELECT category, variant_id, round(avg(realism), 0) AS mean FROM ratings GROUP BY 1, 2) SELECT category, variant_id FROM m QUALIFY mean >= max(mean) OVER (PARTITION BY category) - 1e-9")
def tied_winners(spark, d):
    m = A.ratings(spark, d).groupBy("category", "variant_id").agg(F.round(F.avg("realism"), 0).alias("mean"))
    return L.tied_winners(m, "category", "mean").select("category", "variant_id")


@query("swipe_winners", ", c AS (SELECT category, variant_id, count(*) FILTER (tier = 'strong_accept') AS strong, count(*) FILTER (tier = 'weak_accept') AS weak FROM votes GROUP BY 1, 2), r AS (SELECT *, bool_or(strong > 0) OVER (PARTITION BY category) AS x, row_number() OVER (PARTITION BY category ORDER BY weak DESC, variant_id) AS place FROM c) SELECT category, variant_id, strong, weak FROM r WHERE (x AND strong > 0) OR (NOT x AND weak > 0 AND place <= 2)")
def swipe_winners(spark, d):
    return L.tier_winners(A.votes(spark, d))


_LAST_VOTE = ", lv AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY voted_at DESC, event_id DESC) = 1), cards AS (SELECT DISTINCT card_id, category, variant_id FROM votes) "


def _cards_votes(spark, d):
    v = A.votes(spark, d)
    cards = v.select("card_id", "category", "variant_id").distinct()
    last = keep_last(v, ["card_id"], ["voted_at", "event_id"])
    return cards, last


@query("vote_upsert", _LAST_VOTE + "SELECT card_id, tier FROM lv")
def vote_upsert(spark, d):
    return _cards_votes(spark, d)[1].select("card_id", "tier")


@query(
    "vote_cascades",
    _LAST_VOTE + """, x AS (SELECT c.*, v.tier FROM cards c LEFT JOIN (SELECT card_id, tier FROM lv) v USING (card_id)), f AS (SELECT category, variant_id, coalesce(bool_or(tier = 'strong_reject'), false) AS rej, coalesce(bool_or(tier = 'strong_accept'), false) AS acc FROM x GROUP BY 1, 2),
  n AS (SELECT x.*, CASE WHEN rej THEN 'strong_reject' WHEN tier IS NOT NULL THEN tier WHEN acc THEN 'strong_accept' END AS new FROM x JOIN f USING (category, variant_id)) SELECT card_id, category, variant_id, new AS tier, new IS DISTINCT FROM tier AS cascaded FROM n""",
)
def vote_cascades(spark, d):
    return L.cascades(*_cards_votes(spark, d))


@query("cross_variant_votes", "SELECT event_id FROM votes WHERE cascaded_from IS NULL OR split_part(cascaded_from, '|', 1) = variant_id")
def cross_variant_votes(spark, d):
    return L.without_cross_variant(A.votes(spark, d)).select("event_id")


@query("vote_card_counts", _LAST_VOTE + "SELECT category, count(*) AS total, count(*) FILTER (tier IS NULL) AS open, count(*) FILTER (tier LIKE '%accept') AS accepted, count(*) FILTER (tier LIKE '%reject') AS rejected FROM cards LEFT JOIN (SELECT card_id, tier FROM lv) USING (card_id) GROUP BY 1")
def vote_card_counts(spark, d):
    cards, last = _cards_votes(spark, d)
    x = cards.join(last.select("card_id", "tier"), "card_id", "left")
    t = F.col("tier")
    return x.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count_if(t.isNull()).alias("open"), F.count_if(t.endswith("accept")).alias("accepted"), F.count_if(t.endswith("reject")).alias("rejected"))


@query("condition_sem", ", m AS (SELECT listener_id, variant_id, avg(realism) AS m FROM ratings WHERE realism IS NOT NULL GROUP BY 1, 2) SELECT variant_id, round(avg(m), 6) AS mean, round(coalesce(stddev_samp(m) / sqrt(count(m)), 0), 6) AS sem, count(m) AS n FROM m GROUP BY 1")
def condition_sem(spark, d):
    return _rounded(L.condition_stats(A.ratings(spark, d), "variant_id", "realism"))


@query("factorial_pivot", "SELECT category, round(avg(realism) FILTER (variant_id = 'click'), 6) AS click, round(avg(realism) FILTER (variant_id = 'view'), 6) AS view FROM ratings GROUP BY 1")
def factorial_pivot(spark, d):
    return _rounded(A.ratings(spark, d).groupBy("category").pivot("variant_id", ["click", "view"]).agg(F.avg("realism")))


_BAND = "least(4, greatest(0, least(100, round_even(realism, 0)::INT)) // 20)::INT"


@query("band_hist", f", b AS (SELECT {_BAND} AS band, count(*) AS n FROM ratings WHERE realism IS NOT NULL GROUP BY 1) SELECT d.band, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0::DOUBLE / (SELECT sum(n) FROM b), 6) AS pct FROM (SELECT unnest(range(5))::INT AS band) d LEFT JOIN b USING (band)")
def band_hist(spark, d):
    b = I.counts(A.ratings(spark, d).filter("realism is not null").select(X.band(F.col("realism")).alias("band")), "band")
    x = I.with_dimension(b, spark.range(5).select(F.col("id").cast("int").alias("band")), "band", {"n": 0})
    return x.select("band", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(0))), 6).alias("pct"))


@query("band_scale", f"SELECT event_id, {_BAND} AS band, {_BAND} + 1 AS likert, {_BAND} * 20 + 10 AS midpoint, (['Very synthetic', 'Synthetic', 'Mixed', 'Realistic', 'Very realistic'])[{_BAND} + 1] AS label FROM ratings")
def band_scale(spark, d):
    r = F.col("realism")
    return A.ratings(spark, d).select("event_id", X.band(r).alias("band"), X.likert(r).alias("likert"), X.band_midpoint(r).alias("midpoint"), X.band_label(r, "realism").alias("label"))


@query("hidden_equivalent", "SELECT variant_id, bool_and(auto_assigned) AS hidden FROM ratings GROUP BY 1")
def hidden_equivalent(spark, d):
    return A.ratings(spark, d).groupBy("variant_id").agg(F.bool_and("auto_assigned").alias("hidden"))


@query("sdr_means", "SELECT train_arm, test_set, target, round(avg(si_sdr), 6) AS mean, count(*) AS n FROM metrics GROUP BY 1, 2, 3")
def sdr_means(spark, d):
    return A.metrics(spark, d).groupBy("train_arm", "test_set", "target").agg(F.round(F.avg("si_sdr"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("metric_keep_last", "SELECT train_arm, test_set, song_no, target, si_sdr FROM metrics QUALIFY row_number() OVER (PARTITION BY train_arm, test_set, song_no, target ORDER BY event_id DESC) = 1")
def metric_keep_last(spark, d):
    return keep_last(A.metrics(spark, d), ["train_arm", "test_set", "song_no", "target"], ["event_id"]).drop("event_id")


@query("paper_rows", ", j(train_arm, test_set) AS (SELECT * FROM (SELECT unnest(range(5)) AS a), (SELECT unnest(['view', 'none']) AS b)), m AS (SELECT train_arm, test_set, avg(si_sdr) AS m FROM metrics GROUP BY 1, 2) SELECT train_arm, test_set, CASE WHEN m IS NULL THEN 'pending' ELSE 'done' END AS state, round(m, 6) AS mean FROM j LEFT JOIN m USING (train_arm, test_set)")
def paper_rows(spark, d):
    jobs = spark.createDataFrame([(a, t) for a in range(5) for t in ("view", "none")], "train_arm long, test_set string")
    m = A.metrics(spark, d).groupBy("train_arm", "test_set").agg(F.avg("si_sdr").alias("m"))
    return jobs.join(m, ["train_arm", "test_set"], "left").select("train_arm", "test_set", F.when(F.col("m").isNull(), "pending").otherwise("done").alias("state"), F.round("m", 6).alias("mean"))


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    return I.bootstrap_ci(A.metrics(spark, d), "test_set", "si_sdr")


@query("first_variant", "SELECT variant_id, event_id, category FROM ratings QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY event_id) = 1")
def first_variant(spark, d):
    return keep_first(A.ratings(spark, d).select("variant_id", "event_id", "category"), ["variant_id"], ["event_id"])


@query("approved_lists", _LAST_VOTE + ", a AS (SELECT category, array_to_string(list_sort(list(DISTINCT variant_id)), '|') AS v FROM lv WHERE tier LIKE '%accept' GROUP BY 1) SELECT category, coalesce(v, '') AS approved FROM (SELECT DISTINCT category FROM cards) LEFT JOIN a USING (category)")
def approved_lists(spark, d):
    cards, last = _cards_votes(spark, d)
    a = last.filter(F.col("tier").endswith("accept")).groupBy("category").agg(S.pipe_join(F.col("variant_id")).alias("v"))
    return cards.select("category").distinct().join(a, "category", "left").select("category", F.coalesce("v", F.lit("")).alias("approved"))


# --- sampling --------------------------------------------------------------------------------------


@query("sample_first_n", "SELECT song_id FROM songs_meta WHERE all_valid ORDER BY md5('7|' || song_id), song_id LIMIT 100")
def sample_first_n(spark, d):
    return P.first_n(A.songs_meta(spark, d).filter("all_valid").select("song_id"), 100, 7, "song_id")


@query("stratified_exact_n", ", s AS (SELECT song_id, CASE WHEN count(*) > 1 THEN 'multi' ELSE 'single' END AS stratum FROM stems GROUP BY 1) SELECT song_id, stratum FROM s QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('7|' || song_id), song_id) <= CASE stratum WHEN 'multi' THEN 30 ELSE 10 END")
def stratified_exact_n(spark, d):
    s = A.stems(spark, d).groupBy("song_id").agg(F.count(F.lit(1)).alias("n"))
    return P.stratified(s, F.when(F.col("n") > 1, "multi").otherwise("single"), {"multi": 30, "single": 10}, 7, "song_id").drop("n")


_PLACED = ", p AS (SELECT song_id, row_number() OVER (ORDER BY md5('7|' || song_id), song_id) AS place, count(*) OVER () AS n FROM songs_meta) "


@query("split_three_way", _PLACED + "SELECT song_id, CASE WHEN place <= round_even(n * 0.05::DOUBLE, 0) THEN 'val' WHEN place <= 2 * round_even(n * 0.05::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split FROM p")
def split_three_way(spark, d):
    return P.three_way_split(A.songs_meta(spark, d).select("song_id"), "song_id", 7)


@query("shard_slices", _PLACED + "SELECT song_id, (ntile(7) OVER (ORDER BY place) - 1)::INT AS shard FROM p")
def shard_slices(spark, d):
    return P.shard_slices(A.songs_meta(spark, d).select("song_id"), "song_id", 7, 7)


@query("hour_matched", ", r AS (SELECT song_id, song_length, sum(round(song_length)) OVER (ORDER BY md5('7|' || song_id), song_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM songs_meta WHERE song_length IS NOT NULL) SELECT song_id, round(song_length) AS song_length FROM r WHERE coalesce(before, 0) < 50 * 3600")
def hour_matched(spark, d):
    m = A.songs_meta(spark, d).select("song_id", F.round("song_length").alias("song_length"))
    return P.hour_matched(m, "song_length", 50, 7, "song_id")


@query("split_hours", _PLACED + ", s AS (SELECT song_id, CASE WHEN place <= round_even(n * 0.05::DOUBLE, 0) THEN 'val' WHEN place <= 2 * round_even(n * 0.05::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split FROM p) SELECT split, count(*) AS n, round(sum(song_length) / 3600, 6) AS hours FROM s JOIN songs_meta USING (song_id) GROUP BY 1")
def split_hours(spark, d):
    x = P.three_way_split(A.songs_meta(spark, d).select("song_id", "song_length"), "song_id", 7)
    return x.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("song_length") / 3600, 6).alias("hours"))


@query("quota_sample")
def quota_sample(spark, d):
    return P.quota_sample(_gm(A.stems(spark, d)).select("song_id", "category"), "song_id", "category", 20, 100, 7)


# --- arrays ----------------------------------------------------------------------------------------


@query("rms", "SELECT vec_id, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 9) AS rms FROM waveforms")
def rms(spark, d):
    return A.waveforms(spark, d).select("vec_id", F.round(X.rms(F.col("x")), 9).alias("rms"))


@query("active_seconds", ", h AS (SELECT vec_id, x, i, CASE WHEN i = 5 THEN x[51:64] ELSE x[i * 10 + 1:i * 10 + 10] END AS part, x[i * 10 + 1:i * 10 + 10] AS hop FROM waveforms, (SELECT unnest(range(6)) AS i)) SELECT vec_id, sum(CASE WHEN sqrt(list_sum(list_transform(hop, lambda v: v * v)) / len(hop)) >= 0.12 THEN len(part) ELSE 0 END)::INT AS active FROM h GROUP BY 1")
def active_seconds(spark, d):
    return A.waveforms(spark, d).select("vec_id", K.active_samples(F.col("x"), 10, 0.12).alias("active"))


@query(
    "si_sdr",
    """, p AS (SELECT a.vec_id, a.x AS e, b.x AS r FROM waveforms a JOIN waveforms b ON b.vec_id = a.vec_id + 1), c AS (SELECT vec_id, list_transform(e, lambda v: v - list_sum(e) / len(e)) AS e, list_transform(r, lambda v: v - list_sum(r) / len(r)) AS r FROM p),
  s AS (SELECT *, (list_sum(list_transform(list_zip(e, r), lambda z: z[1] * z[2])) + 1e-8) / (list_sum(list_transform(r, lambda v: v * v)) + 1e-8) AS s FROM c)
  SELECT vec_id, round(10 * log10((list_sum(list_transform(r, lambda v: s * v * s * v)) + 1e-8) / (list_sum(list_transform(list_zip(e, r), lambda z: (z[1] - s * z[2]) * (z[1] - s * z[2]))) + 1e-8)), 6) AS db FROM s""",
)
def si_sdr(spark, d):
    w = A.waveforms(spark, d)
    other = w.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("r"))
    return w.join(other, "vec_id").select("vec_id", F.round(K.si_sdr(F.col("x"), F.col("r")), 6).alias("db"))


@query("mix_sum", ", u AS (SELECT label, unnest(x) AS v, unnest(range(64)) AS pos FROM waveforms) SELECT label, pos::INT AS pos, round(sum(v), 6) AS total FROM u GROUP BY 1, 2")
def mix_sum(spark, d):
    return _rounded(K.mix_sum(A.waveforms(spark, d), "label", "x"))


@query("mix_peak", ", u AS (SELECT label, unnest(x) AS v, unnest(range(64)) AS pos FROM waveforms), t AS (SELECT label, pos, sum(v) AS total FROM u GROUP BY 1, 2), p AS (SELECT label, max(abs(total)) AS peak, count(*) AS length FROM t GROUP BY 1) SELECT label, round(peak, 6) AS peak, length, round(CASE WHEN peak > 0.99 THEN 0.99 / peak ELSE 1 END, 6) AS gain FROM p")
def mix_peak(spark, d):
    return _rounded(K.mix_peak(K.mix_sum(A.waveforms(spark, d), "label", "x"), "label"))


@query("sum_check", "SELECT a.vec_id, list_bool_and(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2]) <= 0.3 + 0.5 * abs(z[2]))) AS ok FROM waveforms a JOIN waveforms b ON b.vec_id = a.vec_id + 1")
def sum_check(spark, d):
    w = A.waveforms(spark, d)
    other = w.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("r"))
    return w.join(other, "vec_id").select("vec_id", K.matches_sum(F.col("x"), F.col("r"), 0.3, 0.5).alias("ok"))


@query("energy_ratio", ", r AS (SELECT vec_id, sqrt(list_sum(list_transform(x[1:32], lambda v: v * v)) / 32) AS a, sqrt(list_sum(list_transform(x, lambda v: v * v)) / 64) AS b FROM waveforms) SELECT vec_id, round(CASE WHEN b > 1e-8 THEN a / b ELSE 0 END, 9) AS ratio FROM r")
def energy_ratio(spark, d):
    return A.waveforms(spark, d).select("vec_id", F.round(K.energy_ratio(F.col("x"), F.slice("x", 1, 32)), 9).alias("ratio"))


@query("span_plan", ", n AS (SELECT DISTINCT program + 1 AS total FROM stems), s AS (SELECT total, unnest(range(CASE WHEN total <= 20 THEN 1 ELSE ceil((total - 20) / 15.0)::BIGINT + 1 END)) AS i FROM n) SELECT total, (i * 15)::INT AS \"start\", least(i * 15 + 20, total)::INT AS \"end\" FROM s")
def span_plan(spark, d):
    n = A.stems(spark, d).select((F.col("program") + 1).alias("total")).distinct()
    return n.select("total", F.inline(K.spans(F.col("total"), 20, 5)))


@query("best_window", ", w AS (SELECT vec_id, i * 8 AS s, sqrt(list_sum(list_transform(x[i * 8 + 1:i * 8 + 16], lambda v: v * v)) / 16) AS r FROM waveforms, (SELECT unnest(range(7)) AS i)) SELECT vec_id, arg_max(s, (r, -s))::INT AS s FROM w GROUP BY 1")
def best_window(spark, d):
    return A.waveforms(spark, d).select("vec_id", K.best_window(F.col("x"), 16, 8).alias("s"))


@query("crop_starts", ", n AS (SELECT DISTINCT program FROM stems) SELECT program, array_to_string(list_distinct_keep, '|') AS starts FROM (SELECT program, list_sort(list_distinct([floor(greatest(0, program - 30) * f)::INT for f in [0.25::DOUBLE, 0.5, 0.75]])) AS list_distinct_keep FROM n)")
def crop_starts(spark, d):
    n = A.stems(spark, d).select("program").distinct()
    return n.select("program", F.array_join(F.transform(K.crop_starts(F.col("program"), 30), lambda v: v.cast("string")), "|").alias("starts"))


# --- text ------------------------------------------------------------------------------------------


@query("sanitize_name", "SELECT song_id, track, nullif(trim(regexp_replace(replace(name, ',', ' '), '\\s+', ' ', 'g')), '') AS clean, coalesce(lower(nullif(trim(regexp_replace(replace(name, ',', ' '), '\\s+', ' ', 'g')), '')), '(unnamed)') AS norm FROM stems")
def sanitize_name(spark, d):
    return A.stems(spark, d).select("song_id", "track", X.sanitize_name(F.col("name")).alias("clean"), X.normalize_name(F.col("name")).alias("norm"))


@query("accent_fold", "SELECT DISTINCT lower(strip_accents(name)) AS folded FROM stems WHERE name IS NOT NULL")
def accent_fold(spark, d):
    return A.stems(spark, d).filter("name is not null").select(X.fold_accents(F.col("name")).alias("folded")).distinct()


@query("gm_class", f"SELECT DISTINCT program, is_drum, {A.CLASS_SQL} AS gm_class, {_TARGET} AS target FROM stems")
def gm_class(spark, d):
    p, drum = F.col("program"), F.col("is_drum")
    return A.stems(spark, d).select("program", "is_drum", X.gm_class(p, drum).alias("gm_class"), X.separation_target(p, drum).alias("target")).distinct()


@query("probe_category", f"SELECT song_id, track, {A.CATEGORY_SQL} AS category FROM stems")
def probe_category(spark, d):
    return A.stems(spark, d).select("song_id", "track", X.probe_category(F.col("program"), F.col("is_drum"), F.col("name")).alias("category"))


def _has(needles) -> str:
    return "(" + " OR ".join(f"contains(n, '{x}')" for x in needles) + ")"


_BY_NAME = "CASE WHEN n = '' OR " + _has(V.NEURAL_DENY) + " THEN NULL " + " ".join(f"WHEN contains(n, '{a}') THEN " + ("CASE WHEN program = 59 THEN NULL ELSE 'trumpet' END" if b == "trumpet" else f"'{b}'") for a, b in V.NEURAL_NAMES) + " END"
_BY_PROGRAM = "CASE WHEN program BETWEEN 32 AND 39 THEN NULL WHEN program BETWEEN 64 AND 67 THEN 'saxophone' " + " ".join(f"WHEN program = {p} THEN '{i}'" for p, i in V.NEURAL_PROGRAMS.items()) + " END"
_ROUTE = f""", s AS (SELECT song_id, track, program, is_drum, lower(trim(coalesce(name, ''))) AS n, {A.CLASS_SQL} AS cls FROM stems),
 f AS (SELECT *, CASE WHEN program BETWEEN 64 AND 67 THEN {_has(V.VOCAL_ALWAYS)} ELSE {_has(V.VOCAL_ALWAYS)} OR ({_has(V.VOCAL_PARTS)} AND NOT {_has(V.VOCAL_EXCEPT)}) OR program BETWEEN 52 AND 54 END AS vocal,
   NOT {_has(V.PIANO_DENY)} AND NOT (program BETWEEN 0 AND 7 AND program NOT IN (0, 1, 3)) AND ((contains(n, 'piano') AND NOT contains(n, 'guitar')) OR program IN (0, 1, 3)) AS piano,
   coalesce({_BY_NAME}, {_BY_PROGRAM}) AS inst FROM s),
 r AS (SELECT *, CASE WHEN is_drum THEN 'drum' WHEN vocal THEN 'vocal' WHEN piano THEN 'piano' WHEN regexp_matches(n, 'guitar|gitar|\\blute\\b|\\bluit\\b') THEN 'guitar' WHEN cls = 'bass' THEN 'bass_guitar' WHEN cls = 'guitar' THEN 'guitar' WHEN inst IS NULL THEN 'unsupported' ELSE 'midi_ddsp' END AS reason FROM f),
 routed AS (SELECT song_id, track, CASE reason WHEN 'piano' THEN 'ddsp_piano' WHEN 'midi_ddsp' THEN 'midi_ddsp' ELSE 'soundfont' END AS backend, CASE reason WHEN 'piano' THEN 'piano' WHEN 'midi_ddsp' THEN inst END AS instrument, reason FROM r) """


def _routed(spark, d):
    return A.stems(spark, d).withColumn("r", X.route(F.col("program"), F.col("is_drum"), F.col("name")))


@query("route_stem", _ROUTE + "SELECT * FROM routed")
def route_stem(spark, d):
    return _routed(spark, d).select("song_id", "track", "r.*")


@query("route_counts", _ROUTE + "SELECT backend, reason, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM routed), 6) AS pct FROM routed GROUP BY 1, 2")
def route_counts(spark, d):
    x = _routed(spark, d).groupBy("r.backend", "r.reason").agg(F.count(F.lit(1)).alias("n"))
    return x.select("backend", "reason", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(0))), 6).alias("pct"))


@query("route_counts_weighted", _ROUTE + "SELECT reason, sum(bytes)::BIGINT AS weight FROM routed JOIN stems USING (song_id, track) GROUP BY 1")
def route_counts_weighted(spark, d):
    return _routed(spark, d).groupBy("r.reason").agg(F.sum("bytes").alias("weight"))


@query("owning_pass", _ROUTE + f", o AS (SELECT s.song_id, s.track, {A.CATEGORY_SQL} AS category FROM stems s) SELECT song_id, track, CASE WHEN category NOT IN ('piano', 'strings', 'wind', 'brass') THEN 'fluidsynth' WHEN backend = 'soundfont' THEN 'fluidsynth' ELSE backend END AS pass FROM routed JOIN o USING (song_id, track)")
def owning_pass(spark, d):
    neural = X.probe_category(F.col("program"), F.col("is_drum"), F.col("name")).isin("piano", "strings", "wind", "brass")
    return _routed(spark, d).select("song_id", "track", F.when(~neural | (F.col("r.backend") == "soundfont"), "fluidsynth").otherwise(F.col("r.backend")).alias("pass"))


@query("paths", "SELECT song_no, song_id AS from_recipe, song_id AS from_audio, replace(path, '/raw/', '/audio/') AS audio, '/new' || substr(path, 2) AS moved FROM songs_meta")
def paths(spark, d):
    p = F.col("path")
    return A.songs_meta(spark, d).select("song_no", X.song_id_from_recipe(p).alias("from_recipe"), X.song_id_from_audio(p).alias("from_audio"), X.raw_to_audio(p).alias("audio"), X.remap_prefix(p, ".", "/new").alias("moved"))


@query("stable_seed")
def stable_seed(spark, d):
    return A.songs_meta(spark, d).select("song_id", X.stable_seed(F.lit("7"), F.col("song_id")).alias("seed"))


@query("blind_labels", """, c AS (SELECT DISTINCT trial_id, listener_id || '|' || variant_id AS condition FROM ratings), o AS (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY md5('7|' || trial_id || '|' || condition), condition) - 1 AS i FROM c)
  SELECT trial_id, condition, CASE WHEN i < 26 THEN chr((i + 65)::INT) ELSE chr((i // 26 + 64)::INT) || chr((i % 26 + 65)::INT) END AS label FROM o""")
def blind_labels(spark, d):
    """The conditions of each trial in a seeded order, under letters that don't tell them."""
    c = A.ratings(spark, d).select("trial_id", F.concat_ws("|", "listener_id", "variant_id").alias("condition")).distinct()
    order = W.partitionBy("trial_id").orderBy(X.seeded_order(7, F.concat_ws("|", "trial_id", "condition")), "condition")
    return c.select("trial_id", "condition", X.blind_label((F.row_number().over(order) - 1).cast("long")).alias("label"))


@query("json_props", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, d):
    x = table(spark, d, "events").select(F.from_json("props", "k long")["k"].alias("k"))
    return I.counts(x, "k")


@query("conversation_turns", "SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, array_to_string(list(role ORDER BY turn), '|') AS roles FROM conversations GROUP BY 1")
def conversation_turns(spark, d):
    c = table(spark, d, "conversations")
    roles = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), "|")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("turn").alias("last_turn"), roles.alias("roles"))
