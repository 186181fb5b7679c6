"""Registered queries of plans, remaining work, manifests, verification documents and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemloom.functions import exprs as X
from stemloom.functions import values as V
from stemloom.operators import documents as D
from stemloom.operators import listening as L
from stemloom.operators import planning as G
from stemloom.operators import sampling as P
from stemloom.operators import songs as S
from stemloom.operators.dedupe import keep_last
from stemloom.plans.catalog import _GM_SQL, _LAST_VOTE, _PLACED, _ROUTE, _STATS, _TARGET, _cards_votes, _gm, _pipe, _routed, query
from stemloom.session import table
from stemloom.sources import adapters as A
from stemloom.sources import collection, midi

#: The recipe as it is now; recorded rows of wind and of organ were made by another one.
SPEC = tuple((c, "midi-ddsp" if c in ("piano", "strings", "brass") else "basic" if c in ("drums", "mallet") else "slakh", "slakh" if c in ("strings", "piano") else "slakh" if c == "organ" else "basic") for c in V.CATEGORIES)
_SPEC_SQL = ", spec(category, method, fallback) AS (VALUES " + ", ".join(f"('{c}', '{m}', '{f}')" for c, m, f in SPEC) + ")"
REASONS = ("polyphonic",)


def _spec(spark):
    return spark.createDataFrame(list(SPEC), "category string, method string, fallback string")


# --- plans and remaining work ----------------------------------------------------------------------


@query("track_plan", _GM_SQL + _SPEC_SQL + " SELECT song_id, track, category, method, fallback, (method = 'slakh' OR fallback = 'slakh') AS use_slakh, method = 'midi-ddsp' AS neural_ok FROM g JOIN spec USING (category)")
def track_plan(spark, d):
    return G.track_plan(_gm(A.stems(spark, d)).select("song_id", "track", "category"), _spec(spark)).select("song_id", "track", "category", "method", "fallback", "use_slakh", "neural_ok")


@query("track_backend", _ROUTE + _GM_SQL.replace("SELECT *,", "SELECT song_id AS sid, track AS t,") + _SPEC_SQL + " SELECT song_id, track, CASE WHEN spec.method = 'midi-ddsp' AND routed.backend IN ('midi_ddsp', 'ddsp_piano') THEN routed.backend ELSE 'fluidsynth' END AS backend FROM routed JOIN g ON sid = song_id AND t = track JOIN spec USING (category)")
def track_backend(spark, d):
    x = _routed(spark, d).withColumn("category", X.probe_category(F.col("program"), F.col("is_drum"), F.col("name"))).select("song_id", "track", "category", F.col("r.backend").alias("route"))
    return G.track_plan(x, _spec(spark)).select("song_id", "track", G.track_backend(F.col("neural_ok"), F.col("route")).alias("backend"))


_CURRENT = _SPEC_SQL + ", cur AS (SELECT r.* FROM recipe r JOIN spec s ON r.category = s.category AND r.method = s.method AND r.fallback = s.fallback)"
_FALLBACK = "method = 'midi-ddsp' AND coalesce(nullif(backend, ''), 'fluidsynth') = 'fluidsynth' AND trim(coalesce(reason, '')) IN ('', 'polyphonic')"


@query("current_done", _CURRENT + " SELECT song_id, count(*) AS done FROM cur GROUP BY 1")
def current_done(spark, d):
    return G.done_by_song(A.recipe(spark, d), _spec(spark))


@query("current_fallbacks", _CURRENT + f" SELECT song_id, count(*) AS fallbacks FROM cur WHERE {_FALLBACK} GROUP BY 1")
def current_fallbacks(spark, d):
    return G.fallbacks_by_song(A.recipe(spark, d), REASONS, _spec(spark))


_WORK = _CURRENT + _GM_SQL + f""", asg AS (SELECT song_id, count(*) FILTER (method <> 'midi-ddsp') AS n_native, count(*) FILTER (method = 'midi-ddsp') AS n_neural FROM g JOIN spec USING (category) GROUP BY 1),
  dn AS (SELECT song_id, count(*) FILTER (method <> 'midi-ddsp') AS native, count(*) FILTER (backend IN ('midi_ddsp', 'ddsp_piano')) AS neural, count(*) FILTER ({_FALLBACK}) AS handled FROM cur GROUP BY 1),
  wk AS (SELECT song_id, greatest(0, n_native - coalesce(native, 0)) AS native_left, greatest(0, n_neural - coalesce(neural, 0) - coalesce(handled, 0)) AS neural_left FROM asg LEFT JOIN dn USING (song_id)),
  work AS (SELECT * FROM wk WHERE native_left + neural_left > 0)"""


def _work(spark, d):
    spec = _spec(spark)
    neural = F.col("method") == G.NEURAL
    plan = G.track_plan(_gm(A.stems(spark, d)).select("song_id", "track", "category"), spec)
    assigned = plan.groupBy("song_id").agg(F.count_if(~neural).alias("n_native"), F.count_if(neural).alias("n_neural"))
    cur = G.current(A.recipe(spark, d), spec)
    return G.work_for_pass(assigned, G.work_done(cur, REASONS))


@query("work_for_pass", _WORK + " SELECT * FROM work")
def work_for_pass(spark, d):
    return _work(spark, d)


@query("neural_work", _GM_SQL + _SPEC_SQL + """, an AS (SELECT song_id, count(*) AS n FROM g JOIN spec USING (category) WHERE spec.method = 'midi-ddsp' GROUP BY 1),
  lp AS (SELECT * FROM recipe_rows QUALIFY row_number() OVER (PARTITION BY pass, song_id, track ORDER BY p1 DESC, p2 DESC, p3 DESC, p4 DESC) = 1),
  cu AS (SELECT lp.* FROM lp JOIN spec USING (category) WHERE lp.method = spec.method AND lp.fallback = spec.fallback),
  ow AS (SELECT DISTINCT song_id, track FROM cu WHERE pass = 'midi_ddsp'), fb AS (SELECT song_id, track FROM cu WHERE pass = 'fluidsynth' AND method = 'midi-ddsp' AND backend = 'fluidsynth'),
  pe AS (SELECT song_id, count(*) AS pending FROM (SELECT DISTINCT song_id, track FROM cu WHERE pass = 'fluidsynth' AND backend = 'pending_midi_ddsp' EXCEPT SELECT * FROM ow) GROUP BY 1),
  dn AS (SELECT song_id, count(*) AS done FROM (SELECT * FROM ow UNION ALL SELECT * FROM fb) GROUP BY 1),
  le AS (SELECT song_id, greatest(coalesce(n, 0) - coalesce(done, 0), coalesce(pending, 0), 0) AS owed FROM (SELECT * FROM an LEFT JOIN dn USING (song_id)) FULL JOIN pe USING (song_id)) SELECT song_id, owed AS "left" FROM le WHERE owed > 0""")
def neural_work(spark, d):
    """The neural pass, its tables recorded under other folders than the plan's."""
    spec = _spec(spark)
    under = lambda folder: F.concat(F.lit(folder), F.col("song_id")).alias("path")
    plan = G.track_plan(_gm(A.stems(spark, d)).select("song_id", "track", "category"), spec).filter(F.col("method") == G.NEURAL)
    assigned = plan.groupBy("song_id").agg(F.count(F.lit(1)).alias("n")).select(under("./data/audio/"), "n")
    rows = G.current(A.recipe_by_pass(spark, d), spec)
    return G.neural_work(assigned, rows.filter(F.col("pass") == "midi_ddsp").select(under("/old/disk/audio/"), "track"), rows.filter(F.col("pass") == "fluidsynth").select(under("/new/audio/"), "track", "method", "backend"))


@query("pass_remaining", _WORK + """, u AS (SELECT 'native' AS pass, song_id, native_left AS k FROM work UNION ALL SELECT 'neural', song_id, neural_left FROM work)
  SELECT pass, count(*) AS songs, sum(k)::BIGINT AS tracks, array_to_string(list_slice(list(song_id ORDER BY song_id), 1, 3), '|') AS examples FROM u WHERE k > 0 GROUP BY 1""")
def pass_remaining(spark, d):
    x = _work(spark, d).select("song_id", F.explode(F.create_map(F.lit("native"), F.col("native_left"), F.lit("neural"), F.col("neural_left"))).alias("pass", "left"))
    return G.remaining(x)


@query("work_in_shards", _PLACED + ", sh AS (SELECT song_id, (ntile(7) OVER (ORDER BY place) - 1)::INT AS shard FROM p)" + _WORK + " SELECT shard, count(*) AS assigned, count(w.song_id) AS left FROM sh LEFT JOIN work w USING (song_id) GROUP BY 1")
def work_in_shards(spark, d):
    return G.work_in_shards(A.songs_meta(spark, d), _work(spark, d), 7, 7)


# --- manifests -------------------------------------------------------------------------------------


def _songs(spark, d):
    """Songs with their tracks; some name their mix, some have no chunk."""
    n = A.stems(spark, d).groupBy("song_id").agg(F.count(F.lit(1)).alias("n_tracks"))
    return A.songs_meta(spark, d).join(n, "song_id").select("song_id", "song_length", "n_tracks", F.when(F.col("song_no") % 11 != 0, F.col("chunk")).alias("chunk"), F.when(F.col("song_no") % 4 == 0, F.concat("path", F.lit("/mix.flac"))).alias("mix"), F.lit(None).cast("string").alias("mid"))


_SONGS = ", so AS (SELECT song_id, song_length, n_tracks, CASE WHEN song_no % 11 <> 0 THEN chunk END AS chunk, CASE WHEN song_no % 4 = 0 THEN path || '/mix.flac' END AS mix FROM songs_meta JOIN (SELECT song_id, count(*) AS n_tracks FROM stems GROUP BY 1) USING (song_id))"
_MANIFEST = _SONGS + """, mp AS (SELECT *, row_number() OVER (ORDER BY md5('43|' || song_id), song_id) AS place, count(*) OVER () AS n FROM so WHERE n_tracks >= 2),
  manifest AS (SELECT 'catalog' AS corpus, CASE WHEN place <= round_even(n * 0.05::DOUBLE, 0) THEN 'val' WHEN place <= 2 * round_even(n * 0.05::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split, song_id,
  coalesce(mix, CASE WHEN chunk IS NOT NULL THEN 'chunk_' || chunk || '/' || song_id || '/mix.flac' ELSE '' END) AS mix_path, CASE WHEN chunk IS NOT NULL THEN 'chunk_' || chunk || '/' || song_id || '/mix.mid' ELSE '' END AS midi_path, n_tracks AS n_stems, song_length AS duration_sec FROM mp)"""


@query("song_manifest", _MANIFEST + " SELECT * FROM manifest")
def song_manifest(spark, d):
    return G.song_manifest(_songs(spark, d), "catalog", 43)


def _second(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("song_id"), F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "validation").otherwise("omitted").alias("split"), (F.col("o_totalprice") / 1000).alias("song_length"))
    return o, A.stems(spark, d)


def _second_sql(with_omitted: bool) -> str:
    return f""", o2 AS (SELECT 's' || o_orderkey AS song_id, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'validation' ELSE 'omitted' END AS split, o_totalprice / 1000 AS song_length FROM orders),
  second AS (SELECT 'second' AS corpus, CASE split WHEN 'omitted' THEN 'train' ELSE split END AS split, song_id, coalesce(CASE WHEN r > 0 THEN r ELSE n END, 0) AS n_stems, song_length AS duration_sec
  FROM o2 LEFT JOIN (SELECT song_id, count(*) FILTER (present) AS r, count(*) AS n FROM stems GROUP BY 1) USING (song_id) {'' if with_omitted else "WHERE split <> 'omitted'"})"""


@query("second_manifest", _second_sql(False) + " SELECT * FROM second")
def second_manifest(spark, d):
    return G.second_manifest(*_second(spark, d), "second", False)


@query("second_manifest_all", _second_sql(True) + " SELECT split, count(*) AS n, sum(n_stems)::BIGINT AS stems FROM second GROUP BY 1")
def second_manifest_all(spark, d):
    x = G.second_manifest(*_second(spark, d), "second", True)
    return x.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("n_stems").alias("stems"))


_SUMMARY = "count(*) AS n, round(coalesce(sum(duration_sec), 0) / 3600, 6) AS hours"


@query("manifest_summary", _MANIFEST + f" SELECT split, {_SUMMARY} FROM manifest GROUP BY 1")
def manifest_summary(spark, d):
    return G.manifest_summary(song_manifest(spark, d), "split")


@query("multistem_index", f", x AS (SELECT song_id, count(*) AS listed, count(*) FILTER (present) AS n_stems, {_pipe('track', 'present')} AS tracks FROM stems GROUP BY 1) SELECT song_id, tracks, n_stems, song_length AS duration_sec, song_length / 3600 AS hours FROM x JOIN songs_meta USING (song_id) WHERE listed >= 3 AND n_stems >= 3 AND song_length > 0")
def multistem_index(spark, d):
    return G.multistem(A.songs_meta(spark, d), A.stems(spark, d), 3)


_INDEX = f""", ix AS (SELECT song_id, 'A piece with ' || array_to_string(list_sort(list(DISTINCT {A.CLASS_SQL})), ', ') AS caption, coalesce(array_to_string(list_sort(list(DISTINCT {_TARGET}) FILTER ({_TARGET} IS NOT NULL)), '|'), '') AS targets,
  count(DISTINCT {_TARGET}) = 4 AS eligible, any_value(song_length) / 3600 AS hours FROM stems JOIN (SELECT song_id, song_length FROM songs_meta) USING (song_id) WHERE song_length > 0 GROUP BY song_id)"""


def _index(spark, d):
    p, drum = F.col("program"), F.col("is_drum")
    stems = A.stems(spark, d).select("song_id", X.gm_class(p, drum).alias("gm_class"), X.separation_target(p, drum).alias("target"))
    return G.song_index(A.songs_meta(spark, d), stems, S.TARGET_NAMES)


@query("song_index", _INDEX + " SELECT * FROM ix")
def song_index(spark, d):
    return _index(spark, d)


@query("matched_pool", _INDEX + """, mp AS (SELECT song_id, 0 AS k FROM ix WHERE eligible AND hours >= 0.5 UNION ALL SELECT song_id, 1 FROM ix JOIN songs_meta USING (song_id) WHERE eligible AND genre = '1-URGENT' AND rated_deduplicated UNION ALL SELECT song_id, 2 FROM ix WHERE eligible),
  mt AS (SELECT song_id FROM mp WHERE k = (SELECT min(k) FROM mp)) SELECT song_id, row_number() OVER (ORDER BY md5('43|' || song_id), song_id) AS place FROM mt""")
def matched_pool(spark, d):
    index = _index(spark, d).filter("eligible").select("song_id", "hours")
    urgent = A.songs_meta(spark, d).filter("genre = '1-URGENT' and rated_deduplicated").select("song_id")
    pool = G.first_nonempty(index.filter("hours >= 0.5").select("song_id"), index.join(urgent, "song_id", "left_semi").select("song_id"), index.select("song_id"))
    return P.ranked(pool, 43, "song_id").select("song_id", "place")


@query("cycled_prompts", _INDEX + ", p AS (SELECT caption, row_number() OVER (ORDER BY caption) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT caption FROM ix)) SELECT r.id, caption AS prompt FROM (SELECT unnest(range(500)) AS id) r JOIN p ON r.id % n = place")
def cycled_prompts(spark, d):
    """Captions of the songs in their order, from the first again after the last."""
    captions = _index(spark, d).select("caption").distinct()
    place = F.row_number().over(D.W.partitionBy(F.lit(0)).orderBy("caption")) - 1  # a caption for each set of classes
    return P.cycled(captions.select(F.col("caption").alias("prompt"), place.cast("int").alias("place")), 500).select("id", "prompt")


@query("arms_summary", _MANIFEST + _second_sql(False) + f", arms AS (SELECT 'first' AS arm, split, duration_sec FROM manifest UNION ALL SELECT 'second', split, duration_sec FROM second UNION ALL SELECT 'both', split, duration_sec FROM manifest UNION ALL SELECT 'both', split, duration_sec FROM second) SELECT arm, split, {_SUMMARY} FROM arms GROUP BY 1, 2")
def arms_summary(spark, d):
    cols = ["split", "duration_sec"]
    a, b = song_manifest(spark, d).select(*cols), second_manifest(spark, d).select(*cols)
    x = a.withColumn("arm", F.explode(F.array(F.lit("first"), F.lit("both")))).unionByName(b.withColumn("arm", F.explode(F.array(F.lit("second"), F.lit("both")))))
    return G.manifest_summary(x, "arm", "split")


_KIND_SQL = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, song_id, n_tracks FROM st WHERE n_tracks BETWEEN {low} AND {high}" + (f" AND regexp_matches(gm_classes, '{pattern}')" if pattern else "") + ("" if covers is None else f" AND subset_bdgp = {str(covers).lower()}")
    for kind, pattern, low, high, covers in G.DEMO_KINDS
)


@query("demo_candidates", f", st AS (SELECT song_id, count(*) AS n_tracks, {_pipe(A.CLASS_SQL)} AS gm_classes, count(DISTINCT {_TARGET}) = 4 AS subset_bdgp FROM stems GROUP BY 1) {_KIND_SQL}")
def demo_candidates(spark, d):
    return G.demo_candidates(S.songs_table(A.stems(spark, d), list(A.ORDER)))


@query("in_saved_order", ", smp AS (SELECT song_id, row_number() OVER (ORDER BY md5('7|' || song_id), song_id) AS place FROM songs_meta WHERE all_valid QUALIFY place <= 100) SELECT song_id, track, place FROM stems JOIN smp USING (song_id)")
def in_saved_order(spark, d):
    songs = P.first_n(A.songs_meta(spark, d).filter("all_valid").select("song_id"), 100, 7, "song_id")
    return G.in_order(A.stems(spark, d).select("song_id", "track"), P.ranked(songs, 7, "song_id"), "song_id").select("song_id", "track", "place")


@query("stem_trials", _GM_SQL + """, oc AS (SELECT song_id, arg_min(category, (md5('7|' || song_id || '|' || category), category)) AS category FROM g GROUP BY 1)
  SELECT song_id, category FROM oc QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5('7|' || song_id), song_id) <= 5""")
def stem_trials(spark, d):
    return G.trials(_gm(A.stems(spark, d)).select("song_id", "category"), "song_id", "category", 5, 7, V.CATEGORIES).select("song_id", "category")


_NOTES = ", ne AS (SELECT user_id AS k, event_id AS place, event_id // 3 AS tick, (value * 10)::BIGINT % 2 AS note, event_type <> 'view' AND event_id % 2 = 0 AS is_on FROM events)"


def _notes(spark, d):
    """Each user's events as notes; a value between two goes to the even one, as a cast does in the SQL."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("k"), F.col("event_id").alias("place"), F.floor(F.col("event_id") / 3).alias("tick"), (F.rint(F.col("value") * 10).cast("long") % 2).alias("note"), ((F.col("event_type") != "view") & (F.col("event_id") % 2 == 0)).alias("is_on"))


@query("monophonic", _NOTES + """, ng AS (SELECT *, sum(is_on::INT) OVER (PARTITION BY k ORDER BY place) AS grp FROM ne), no2 AS (SELECT *, max(note) FILTER (is_on) OVER (PARTITION BY k, grp) AS o FROM ng),
  cl AS (SELECT k, grp, bool_or(NOT is_on AND coalesce(note = o, false)) AS closed FROM no2 GROUP BY 1, 2), fl AS (SELECT *, max(grp) OVER (PARTITION BY k) AS last FROM cl)
  SELECT k, bool_and(grp = 0 OR closed OR grp = last) AS monophonic FROM fl GROUP BY 1""")
def monophonic(spark, d):
    return G.note_faults(_notes(spark, d), "k")


_LASTING = """, lw AS (SELECT *, sum(CASE WHEN is_on THEN 1 ELSE -1 END) OVER w AS s FROM ne WINDOW w AS (PARTITION BY k, note ORDER BY place)),
  la AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY k, note ORDER BY place)) AS after FROM lw),
  lh AS (SELECT *, CASE WHEN is_on THEN after ELSE lag(after, 1, 0) OVER (PARTITION BY k, note ORDER BY place) END AS height FROM la),
  le AS (SELECT *, lag(tick) OVER (PARTITION BY k, note, height ORDER BY place) AS began FROM lh WHERE height > 0),
  lasting AS (SELECT k, coalesce(bool_or(NOT is_on AND tick > began), false) AS lasting FROM (SELECT DISTINCT k FROM ne) LEFT JOIN le USING (k) GROUP BY 1)"""


@query("lasting_notes", _NOTES + _LASTING + "SELECT k, lasting FROM lasting")
def lasting_notes(spark, d):
    return G.lasting_notes(_notes(spark, d), "k")


def _midi_events(spark, d):
    """Each user's events as a MIDI file of four tracks: notes where they start and end, a name and a program of each track."""
    e = table(spark, d, "events")
    path, track = F.concat(F.col("user_id").cast("string"), F.lit(".mid")), (F.col("event_id") % 4).cast("int")
    none, no_text = F.lit(None).cast("int"), F.lit(None).cast("string")
    tick, note = F.floor(F.col("event_id") / 8).alias("tick"), (F.round(F.col("value") * 10).cast("long") % 12).cast("int")
    on = F.col("event_type").isin("click", "view", "signup")
    notes = e.select(path.alias("path"), track.alias("track"), (F.col("event_id") + 2).cast("int").alias("place"), tick, F.when(on, "on").otherwise("off").alias("kind"), F.lit(0).alias("channel"), note.alias("note"), F.when(on, 64).otherwise(0).alias("velocity"), no_text.alias("text"))
    heads = notes.select("path", "track").distinct().withColumn("user", F.regexp_extract("path", r"\d+", 0).cast("int"))
    name = F.element_at(F.array(*map(F.lit, A.NAMES)), (F.col("user") + F.col("track")) % len(A.NAMES) + 1)
    program = (F.col("user") * 7 + F.col("track")) % 128
    row = lambda place, kind, channel, note, text: F.struct(F.lit(place).alias("place"), F.lit(0).cast("long").alias("tick"), F.lit(kind).alias("kind"), channel.alias("channel"), note.alias("note"), none.alias("velocity"), text.alias("text"))
    heads = heads.select("path", "track", F.explode(F.array(row(0, "name", none, none, name), row(1, "program", F.lit(0), program, no_text))).alias("h")).select("path", "track", "h.*")
    return notes.unionByName(heads)


_MIDI = f""", me AS (SELECT user_id, (event_id % 4)::INT AS track, event_id AS place, event_id // 8 AS tick, (round(value * 10)::BIGINT % 12)::INT AS note, event_type IN ('click', 'view', 'signup') AS is_on FROM events),
  ne AS (SELECT user_id || '.mid|' || track AS k, place, tick, note, is_on FROM me),
  ng AS (SELECT *, sum(is_on::INT) OVER (PARTITION BY k ORDER BY place) AS grp FROM ne), no2 AS (SELECT *, max(note) FILTER (is_on) OVER (PARTITION BY k, grp) AS o FROM ng),
  cl AS (SELECT k, grp, bool_or(NOT is_on AND coalesce(note = o, false)) AS closed FROM no2 GROUP BY 1, 2), fl AS (SELECT *, max(grp) OVER (PARTITION BY k) AS last FROM cl),
  mono AS (SELECT k, bool_and(grp = 0 OR closed OR grp = last) AS monophonic FROM fl GROUP BY 1) {_LASTING},
  mt AS (SELECT user_id || '.mid' AS path, track, user_id || '.mid|' || track AS k, ([{', '.join(repr(n) for n in A.NAMES)}])[((user_id + track) % {len(A.NAMES)} + 1)::INT] AS name, ((user_id * 7 + track) % 128)::INT AS program, count(*) FILTER (is_on) AS notes FROM me GROUP BY user_id, track),
  tr AS (SELECT path, track, trim(regexp_replace(translate(name, ',', ' '), '\\s+', ' ', 'g')) AS name, program, notes, lasting, monophonic FROM mt JOIN mono USING (k) JOIN lasting USING (k))"""


@query("midi_round_trip", _MIDI + "SELECT user_id || '.mid' AS path, track, tick, note, is_on, count(*) AS n FROM me GROUP BY ALL")
def midi_round_trip(spark, d):
    """Event rows written as MIDI files and read back."""
    x = midi.read_events(midi.written_midis(_midi_events(spark, d))).filter("kind in ('on', 'off')")
    return x.groupBy("path", "track", "tick", "note", (F.col("kind") == "on").alias("is_on")).agg(F.count(F.lit(1)).alias("n"))


@query("midi_tracks", _MIDI + "SELECT path, track, name, program, notes, lasting, monophonic FROM tr")
def midi_tracks(spark, d):
    """Track rows of files."""
    x = midi.track_rows(midi.read_events(midi.written_midis(_midi_events(spark, d))))
    return x.select("path", "track", "name", "program", "notes", "lasting", "monophonic")


@query(
    "route_with_notes",
    _MIDI
    + _ROUTE[: _ROUTE.index(" routed AS")].rstrip(",\n ").replace("FROM stems)", "FROM (SELECT *, false AS is_drum FROM tr))").replace("SELECT song_id, track,", "SELECT path, track, notes, lasting, monophonic,", 1)
    + """, rn AS (SELECT path, track, inst, CASE WHEN notes = 0 THEN 'empty' WHEN NOT lasting THEN 'zero_duration' WHEN reason = 'midi_ddsp' AND NOT monophonic THEN 'polyphonic' ELSE reason END AS reason FROM r)
  SELECT path, track, CASE reason WHEN 'piano' THEN 'ddsp_piano' WHEN 'midi_ddsp' THEN 'midi_ddsp' ELSE 'soundfont' END AS backend, CASE WHEN reason = 'piano' THEN 'piano' WHEN reason IN ('midi_ddsp', 'polyphonic') THEN inst END AS instrument, reason FROM rn""",
)
def route_with_notes(spark, d):
    """P19 with both note predicates, from files."""
    x = midi.routed(midi.track_rows(midi.read_events(midi.written_midis(_midi_events(spark, d)))))
    return x.select("path", "track", "route.*")


@query("corrected_midis", _MIDI + ", o AS (SELECT path, track, name, program, row_number() OVER (PARTITION BY path ORDER BY track) - 1 AS dense FROM tr WHERE notes > 0) SELECT path, dense::INT AS track, track AS original_track, CASE WHEN program < 8 THEN 6 ELSE program END AS program, false AS is_drum, name FROM o")
def corrected_midis(spark, d):
    """Files with the register's programs, read back from what was written."""
    files = midi.written_midis(_midi_events(spark, d))
    tracks = midi.track_rows(midi.read_events(files))
    register = tracks.select("path", "track", F.when(F.col("program") < 8, 6).otherwise(F.col("program")).alias("program_corrected"))
    out = midi.corrected_midis(files, register)
    rows = out.select("path", F.explode("tracks").alias("t")).select("path", "t.*")
    again = midi.track_rows(midi.read_events(out.filter("content is not null"))).select("path", "track", F.col("program").alias("p2"), F.col("name").alias("n2"))
    return rows.join(again, ["path", "track"]).select("path", "track", "original_track", F.col("p2").alias("program"), "is_drum", F.col("n2").alias("name"))


@query("greedy_windows")
def greedy_windows(spark, d):
    starts = F.transform(F.sequence(F.lit(0), F.lit(48), F.lit(4)), lambda s: F.struct(X.rms(F.slice("x", s + 1, F.lit(16))).alias("score"), s.cast("double").alias("start")))
    return A.waveforms(spark, d).select("vec_id", F.transform(G.greedy_windows(starts, 3, 12.0), lambda t: t.cast("int")).alias("starts")).select("vec_id", F.array_join("starts", "|").alias("starts"))


@query("velocity_applied", ", sc AS (SELECT label, 0.3::DOUBLE / max(list_max(list_transform(x, lambda v: abs(v)))) AS scale FROM waveforms GROUP BY label HAVING max(list_max(list_transform(x, lambda v: abs(v)))) > 0.42) SELECT vec_id, round(list_sum(list_transform(x, lambda v: v * coalesce(scale, 1.0))), 9) AS total FROM waveforms LEFT JOIN sc USING (label)")
def velocity_applied(spark, d):
    w = A.waveforms(spark, d)
    peaks = w.groupBy("label").agg(F.max(F.array_max(F.transform("x", F.abs))).alias("peak"))
    scales = peaks.filter("peak > 0.42").withColumn("scale", F.lit(0.3) / F.col("peak"))  # quieter ones stay
    return G.scaled(w, scales, "label").select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 9).alias("total"))


@query("segment_tiles", "SELECT song_id, array_to_string(range(0, round(song_length)::BIGINT, 60), '|') AS starts FROM songs_meta WHERE song_length IS NOT NULL")
def segment_tiles(spark, d):
    return A.songs_meta(spark, d).filter("song_length is not null").select("song_id", F.array_join(G.tiles(F.round("song_length"), 60), "|").alias("starts"))


# --- verification documents and validators ---------------------------------------------------------


@query("verification_meta", _STATS + """, o AS (SELECT *, min_content >= 1 AND mean_content >= 6 AS ok FROM st), p AS (SELECT *, bool_or(ok) OVER () AS any_ok FROM o), e AS (SELECT * FROM p WHERE ok OR NOT any_ok),
  w AS (SELECT category, variant_id FROM e QUALIFY row_number() OVER (PARTITION BY category ORDER BY mean_realism DESC NULLS LAST, mean_content DESC NULLS LAST, variant_id) = 1)
  SELECT st.category, st.variant_id, round(st.mean_realism, 6) AS mean_realism, round(st.mean_content, 6) AS mean_content, st.n_stems, e.category IS NOT NULL AS passed_filter, w.category IS NOT NULL AS is_auto_winner,
  row_number() OVER (PARTITION BY st.category ORDER BY st.mean_realism DESC NULLS LAST, st.mean_content DESC NULLS LAST, st.variant_id)::INT AS place FROM st LEFT JOIN e ON st.category = e.category AND st.variant_id = e.variant_id LEFT JOIN w ON st.category = w.category AND st.variant_id = w.variant_id""")
def verification_meta(spark, d):
    x = D.verification_meta(L.variant_stats(A.ratings(spark, d)), 1, 6)
    return x.withColumn("mean_realism", F.round("mean_realism", 6)).withColumn("mean_content", F.round("mean_content", 6))


def _doc(spark, d):
    """A document's entries: accepted variants, a winner that some entries lack or didn't accept, a flag."""
    cards, last = _cards_votes(spark, d)
    a = last.filter(F.col("tier") == "strong_accept").groupBy("category").agg(F.array_sort(F.collect_set("variant_id")).alias("approved"))
    n = F.col("category").cast("int")
    x = cards.groupBy("category").agg(F.min("variant_id").alias("w")).join(a, "category", "left")
    return x.select("category", F.when(n != 7, F.coalesce("approved", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("approved"), F.when(n == 3, None).when(n == 5, "nobody").otherwise(F.col("w")).alias("winner"), (n == 9).alias("bypass"))


_DOC = _LAST_VOTE + """, da AS (SELECT category, list_sort(list(DISTINCT variant_id)) AS a FROM lv WHERE tier = 'strong_accept' GROUP BY 1), dw AS (SELECT category, min(variant_id) AS w FROM cards GROUP BY 1),
  doc AS (SELECT category, CASE WHEN category <> '7' THEN coalesce(a, []) ELSE [] END AS approved, CASE WHEN category = '3' THEN NULL WHEN category = '5' THEN 'nobody' ELSE w END AS winner, category = '9' AS bypass FROM dw LEFT JOIN da USING (category))"""


@query("verification_winners", _DOC + " SELECT 'patch' AS kind, category, array_to_string(approved, '|') AS winners FROM doc WHERE len(approved) > 0 UNION ALL SELECT 'other', category, winner FROM doc WHERE NOT bypass AND winner IS NOT NULL")
def verification_winners(spark, d):
    x = _doc(spark, d)
    return D.winners(x, True).withColumn("kind", F.lit("patch")).unionByName(D.winners(x, False).withColumn("kind", F.lit("other")))


@query("verification_messages", _DOC + """ SELECT category, category || ': approve at least one variant' AS message FROM doc WHERE NOT bypass AND len(approved) = 0 UNION ALL SELECT category, category || ': pick a winner' FROM doc WHERE NOT bypass AND winner IS NULL
  UNION ALL SELECT category, category || ': winner must be among approved variants' FROM doc WHERE NOT bypass AND winner IS NOT NULL AND NOT list_contains(approved, winner) UNION ALL SELECT category, category || ': keep at least one soundfont' FROM doc WHERE len(approved) = 0""")
def verification_messages(spark, d):
    x = _doc(spark, d)
    return D.messages(x).unionByName(D.messages(x, patch=True))


@query("verification_bypass", _DOC + ", ls AS (SELECT * FROM lv WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category ORDER BY voted_at, event_id) = 1), sb AS (SELECT category, bool_and(tier IN ('strong_reject', 'weak_reject')) AS s FROM ls GROUP BY 1) SELECT category FROM doc LEFT JOIN sb USING (category) WHERE coalesce(s, bypass)")
def verification_bypass(spark, d):
    oldest = F.row_number().over(D.W.partitionBy("category").orderBy("voted_at", "event_id"))
    stems = _cards_votes(spark, d)[1].filter("tier is not null").withColumn("_n", oldest).filter("_n = 1").select("category", F.col("tier").endswith("reject").alias("bypass"))
    return D.bypassed(_doc(spark, d), stems)


@query("verification_approved", """, sl AS (SELECT category, variant_id, row_number() OVER (PARTITION BY category ORDER BY variant_id DESC) AS place FROM (SELECT DISTINCT category, variant_id FROM votes)),
  lc AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY category, variant_id ORDER BY voted_at DESC, event_id DESC) = 1)
  SELECT category, coalesce(array_to_string(list(variant_id ORDER BY place) FILTER (tier = 'strong_accept'), '|'), '') AS approved FROM sl JOIN lc USING (category, variant_id) GROUP BY 1""")
def verification_approved(spark, d):
    v = A.votes(spark, d)
    lists = v.select("category", "variant_id").distinct()
    place = F.row_number().over(D.W.partitionBy("category").orderBy(F.desc("variant_id")))  # a few variants
    return D.approved(lists.withColumn("place", place), v).select("category", F.array_join("approved", "|").alias("approved"))


@query("category_detail", ", nm AS (SELECT DISTINCT stem_id, (" + A._NAMES_SQL + ")[(stem_id + 7)::INT] AS name FROM ratings), x AS (SELECT DISTINCT category, variant_id, r.stem_id, coalesce(name, '?') AS name FROM ratings r LEFT JOIN nm USING (stem_id)) SELECT category, variant_id, array_to_string(list(stem_id || ':' || name ORDER BY stem_id, name), '|') AS stems FROM x GROUP BY 1, 2")
def category_detail(spark, d):
    r = A.ratings(spark, d).select("category", "variant_id", "stem_id").distinct()
    name = F.element_at(F.array(*map(F.lit, A.NAMES), F.lit(None)), (F.col("stem_id") + 7).cast("int"))  # the last has none
    names = r.select("stem_id").distinct().withColumn("name", name)
    return D.category_detail(r, names)


@query("locked_config", _DOC + ", s2 AS (SELECT category, winner FROM doc WHERE list_contains(approved, winner)) SELECT category, approved[1] AS primary, array_to_string(approved, '|') AS fonts, coalesce(s2.winner, 'dry') AS fx FROM doc LEFT JOIN s2 USING (category) WHERE len(approved) > 0")
def locked_config(spark, d):
    x = _doc(spark, d)
    return D.locked(x, x.filter("array_contains(approved, winner)").select("category", "winner"), "dry")


@query("fonts_by_category", _DOC + ", ct(font, title) AS (VALUES ('click', 'alpha Font'), ('view', 'Beta font'), ('purchase', 'ALPHA two')), t AS (SELECT DISTINCT category, coalesce(title, font) AS t FROM (SELECT category, unnest(approved) AS font FROM doc) LEFT JOIN ct USING (font)) SELECT category, array_to_string(list(t ORDER BY lower(t), t), '|') AS fonts FROM t GROUP BY 1")
def fonts_by_category(spark, d):
    catalog = spark.createDataFrame([("click", "alpha Font"), ("view", "Beta font"), ("purchase", "ALPHA two")], "font string, title string")
    return D.fonts_by_category(_doc(spark, d), catalog)


@query("probe_faults", _GM_SQL + """, pb AS (SELECT p1 || '|' || p2 AS id, category, song_id, (track % 2)::INT AS track, present AS legacy FROM g),
  n AS (SELECT c.category, n FROM (SELECT unnest([""" + ", ".join(f"'{c}'" for c in (*V.CATEGORIES, "bells")) + """]) AS category) c LEFT JOIN (SELECT category, count(*) FILTER (NOT legacy) AS n FROM pb GROUP BY 1) USING (category)),
  lk AS (SELECT song_id || '/' || track AS detail, count(*) FILTER (NOT legacy) AS n, count(*) FILTER (legacy) AS m FROM pb GROUP BY song_id, track)
  SELECT CASE WHEN n IS NULL THEN 'missing' ELSE 'count' END AS fault, CASE WHEN n IS NULL THEN category ELSE category || ': ' || n || CASE WHEN n < 100 THEN ' < ' ELSE ' > ' END || '100' END AS detail FROM n WHERE coalesce(n, 0) <> 100
  UNION ALL SELECT 'id', id FROM pb GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'key', detail FROM lk WHERE n > 1 UNION ALL SELECT 'reused', detail FROM lk WHERE n > 0 AND m > 0""")
def probe_faults(spark, d):
    x = _gm(A.stems(spark, d)).select(F.concat_ws("|", F.col("p1").cast("string"), F.col("p2").cast("string")).alias("id"), "category", "song_id", (F.col("track") % 2).cast("int").alias("track"), F.col("present").alias("legacy"))
    return D.probe_faults(x, 100, (*V.CATEGORIES, "bells"))


_ALLOWED = " OR ".join(f"(category = '{c}' AND gm_class = '{g}')" for g, c in (*V.CATEGORY_CLASSES, ("drums", "drums")))


@query("misplaced_stems", _GM_SQL + f"SELECT category, gm_class, count(*) AS n FROM g WHERE NOT ({_ALLOWED}) GROUP BY 1, 2")
def misplaced_stems(spark, d):
    return D.misplaced(_gm(A.stems(spark, d)))


_TRIALS = ", tr AS (SELECT DISTINCT trial_id, trial_id % 3 AS k FROM ratings)"


def _trials(spark, d):
    k = F.col("trial_id") % 3
    pairs = F.when(k == 0, F.create_map(F.lit("view"), F.lit("click"), F.lit("purchase"), F.lit("nobody"))).when(k == 1, F.create_map(F.lit("view"), F.lit("purchase")))
    return A.ratings(spark, d).select("trial_id").distinct().select("trial_id", pairs.alias("equivalences"))


@query("trial_equivalences", _TRIALS + " SELECT trial_id, 'view' AS duplicate, 'click' AS donor FROM tr WHERE k = 0")
def trial_equivalences(spark, d):
    return D.equivalences(_trials(spark, d), {"view": "click", "purchase": "click"})


@query("unique_conditions", _TRIALS + " SELECT trial_id, CASE WHEN k = 0 THEN 'click|purchase' ELSE 'click|view|purchase' END AS conditions FROM tr")
def unique_conditions(spark, d):
    t = _trials(spark, d)
    e = D.equivalences(t, {"view": "click", "purchase": "click"}).groupBy("trial_id").agg(F.collect_set("duplicate").alias("dup"))
    return t.join(e, "trial_id", "left").select("trial_id", F.array_join(D.unique_conditions(("click", "view", "purchase"), F.col("dup")), "|").alias("conditions"))


# --- listings and rewrites -------------------------------------------------------------------------

_ORDER_SQL = "[" + ", ".join(f"'{c}'" for c in V.CATEGORIES) + "]"


@query("song_categories", _GM_SQL + f", h AS (SELECT song_id, list(DISTINCT category) AS c FROM g GROUP BY 1) SELECT song_id, coalesce(array_to_string(list_filter({_ORDER_SQL}, lambda v: list_contains(c, v)), '|'), '') AS categories FROM songs_meta LEFT JOIN h USING (song_id)")
def song_categories(spark, d):
    return D.listing(A.songs_meta(spark, d), _gm(A.stems(spark, d)), V.CATEGORIES)


@query("categories_present", _GM_SQL + f"SELECT DISTINCT category, list_position({_ORDER_SQL}, category)::BIGINT AS place FROM g")
def categories_present(spark, d):
    return D.present(_gm(A.stems(spark, d)), V.CATEGORIES)


@query("stem_list", ", f AS (SELECT * FROM ratings QUALIFY row_number() OVER (PARTITION BY stem_id ORDER BY event_id) = 1) SELECT stem_id, CASE WHEN stem_id = 3 THEN 'bells' ELSE category END AS category, variant_id FROM f")
def stem_list(spark, d):
    over = spark.createDataFrame([(3, "bells")], "stem_id long, category string")
    return D.stem_list(A.ratings(spark, d).select("stem_id", "event_id", "category", "variant_id"), over, ["event_id"]).select("stem_id", "category", "variant_id")


@query("swipe_cards", ", m AS (SELECT DISTINCT variant_id, category, stem_id, listener_id AS clip_id FROM ratings), n AS (SELECT stem_id, count(DISTINCT clip_id) AS n_clips FROM m GROUP BY 1) SELECT m.*, n_clips, md5('7|' || variant_id || '|' || category || '|' || stem_id || '|' || clip_id) AS shuffle FROM m JOIN n USING (stem_id) WHERE category = 'piano'")
def swipe_cards(spark, d):
    return D.swipe_cards(A.ratings(spark, d).withColumnRenamed("listener_id", "clip_id"), 7, "piano")


@query("clip_rows", """, m AS (SELECT DISTINCT stem_id, variant_id FROM ratings), w AS (SELECT DISTINCT stem_id, trial_id AS clip FROM ratings WHERE content >= (SELECT 0.98::DOUBLE * max(content) FROM ratings)), nw AS (SELECT stem_id, variant_id, clip FROM m JOIN w USING (stem_id))
  SELECT * FROM nw UNION ALL SELECT stem_id, variant_id, -1 FROM m WHERE stem_id NOT IN (SELECT stem_id FROM nw)""")
def clip_rows(spark, d):
    r = A.ratings(spark, d)
    m = r.select("stem_id", "variant_id").distinct()
    best = r.agg((F.lit(0.98) * F.max("content")).alias("least"))  # one row
    r = r.join(F.broadcast(best), F.col("content") >= F.col("least"))
    return D.clip_rows(m, r.select("stem_id", F.col("trial_id").alias("clip")).distinct(), m.withColumn("clip", F.lit(-1).cast("long")))


@query("tagged_parts", "SELECT p_partkey::VARCHAR AS id FROM part WHERE list_has_any(string_split(p_type, ' '), ['BRASS', 'SMALL', 'bolt']) ORDER BY id LIMIT 50")
def tagged_parts(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.split("p_type", " ").alias("tags"))
    return D.tagged(p, ["BRASS", "SMALL", "bolt"], limit=50).select("id")


@query("stem_records", _GM_SQL + "SELECT song_id, track, gm_id, gm_class, category FROM g")
def stem_records(spark, d):
    """Stems as records of an inventory, with the class and category that their program and name give."""
    return _gm(A.stems(spark, d)).select("song_id", "track", "gm_id", "gm_class", "category")


@query("named_programs", _GM_SQL + "SELECT gm_id, count(*) AS n FROM g WHERE trim(coalesce(name, '')) <> '' GROUP BY 1")
def named_programs(spark, d):
    """The inventory of stems that have a name."""
    x = _gm(A.stems(spark, d)).filter(F.trim(F.coalesce("name", F.lit(""))) != "")
    return x.groupBy("gm_id").agg(F.count(F.lit(1)).alias("n"))


@query("condition_tables", ", sv AS (SELECT song_id FROM songs_meta WHERE all_valid) SELECT c AS condition, song_id, track, 'clips/' || c || '/' || song_id || '/' || track || '.flac' AS path, 10.0::DOUBLE AS duration_sec FROM stems JOIN sv USING (song_id), (SELECT unnest(['a', 'b', 'c']) AS c)")
def condition_tables(spark, d):
    return D.condition_tables(A.songs_meta(spark, d).filter("all_valid"), A.stems(spark, d), ("a", "b", "c"), 10.0)


@query("media_paths", ", tm AS (SELECT song_id, './chunk_' || chunk || '/' || song_id AS m FROM songs_meta WHERE rated_deduplicated) SELECT song_id, track, coalesce(m, replace(path, '/raw/', '/audio/')) || '/' || track || '.flac' AS file FROM stems JOIN songs_meta USING (song_id) LEFT JOIN tm USING (song_id)")
def media_paths(spark, d):
    m = A.songs_meta(spark, d)
    tracks = m.filter("rated_deduplicated").select("song_id", F.concat(F.lit("./chunk_"), F.col("chunk").cast("string"), F.lit("/"), "song_id").alias("path"))
    return D.media_paths(A.stems(spark, d).select("song_id", "track").join(m.select("song_id", "path"), "song_id"), tracks)


@query("canonical_paths", """, rp AS (SELECT CASE WHEN pass_no = 0 THEN './data/raw/' WHEN pass_no = 1 THEN './media/' ELSE './other/' END || song_id AS path, track, program, p1, p2, p3, p4 FROM raw_stems),
  mv AS (SELECT * REPLACE (CASE WHEN starts_with(path, './data/raw/') THEN './media/' || substr(path, 12) ELSE path END AS path) FROM rp)
  SELECT path, track, program FROM mv QUALIFY row_number() OVER (PARTITION BY path, track ORDER BY p1 DESC, p2 DESC, p3 DESC, p4 DESC) = 1""")
def canonical_paths(spark, d):
    root = F.element_at(F.array(F.lit("./data/raw/"), F.lit("./media/"), F.lit("./other/")), F.col("pass_no") + 1)
    x = A.raw_stems(spark, d).select(F.concat(root, "song_id").alias("path"), "track", "program", *A.ORDER)
    return D.canonical(x, ["path", "track"], list(A.ORDER), "./data/raw/", "./media/").select("path", "track", "program")


@query("corrected_files", "SELECT song_id, array_to_string(list(track || ':' || program ORDER BY track), '|') AS programs, count(*)::INT AS n_tracks FROM stems GROUP BY 1")
def corrected_files(spark, d):
    return D.corrected_files(A.stems(spark, d))


_CUES = (("Flute, solo", "wind"), ("Cello", "strings"), ("Piano", "piano"), ("Tuba", "brass"), ("Organ", "piano"))


@query("files_by_target", ", ft AS (SELECT song_id, track || '.wav' AS file, CASE name WHEN 'Flute, solo' THEN 'wind' WHEN 'Cello' THEN 'strings' WHEN 'Piano' THEN 'piano' WHEN 'Tuba' THEN 'brass' END AS target FROM stems WHERE present) SELECT song_id, target, array_to_string(list_sort(list(DISTINCT file)), '|') AS files FROM ft WHERE target IS NOT NULL GROUP BY 1, 2")
def files_by_target(spark, d):
    x = A.stems(spark, d).select("song_id", F.concat(F.col("track").cast("string"), F.lit(".wav")).alias("file"), F.col("name").alias("instrument"), "present")
    return D.files_by_target(x, _CUES, ("Organ",))


@query("patch_pool", _GM_SQL + ", p AS (SELECT DISTINCT program, is_drum FROM g) SELECT program, is_drum, CASE WHEN is_drum THEN '128' ELSE array_to_string(CASE WHEN program % 8 = 0 THEN [program, program + 1] WHEN program % 8 = 1 THEN [program, program - 1] ELSE [program, program // 8 * 8, program // 8 * 8 + 1] END, '|') END AS pool FROM p")
def patch_pool(spark, d):
    p = F.col("program")
    first = (F.floor(p / 8) * 8).cast("int")
    pool = D.pooled(F.array(p), F.array(first, first + 1), F.array(first))
    pool = F.when((p % 8) == 1, F.array(p, first)).otherwise(pool)
    return A.stems(spark, d).select("program", "is_drum").distinct().select("program", "is_drum", F.when(F.col("is_drum"), "128").otherwise(F.array_join(pool, "|")).alias("pool"))




_CONDITIONS = ("view", "click", "purchase", "signup", "refund", "error")
_BANDS = {k: "[" + ", ".join(f"'{b}'" for b in v) + "]" for k, v in V.BAND_LABELS.items()}
_BAND = "least(4, floor(greatest(0, least(100, {x})) / 20))::INT"


@query(
    "listening_summary",
    f""", lr AS (SELECT listener_id, variant_id AS condition_id, CASE WHEN category = 'drums' THEN 'mixture' WHEN category IN ('piano', 'strings') THEN 'stem' ELSE 'other' END AS trial_type, variant_id = 'view' OR auto_assigned AS is_reference, content, realism FROM ratings),
  co(place, condition_id) AS (VALUES {', '.join(f"({k}, '{c}')" for k, c in enumerate(_CONDITIONS))}),
  m AS (SELECT condition_id, count(*) AS n, count(DISTINCT listener_id) AS listeners, avg(content) FILTER (NOT is_reference) AS c0, avg(content) AS any_c, avg(realism) AS r FROM lr GROUP BY 1),
  j AS (SELECT co.place, co.condition_id, n, listeners, r, CASE WHEN co.condition_id = 'view' THEN c0 ELSE coalesce(c0, any_c) END AS c FROM co LEFT JOIN m USING (condition_id))
  SELECT place, 'condition' AS section, condition_id AS key, coalesce(n, 0) AS n, coalesce(listeners, 0) AS listeners, round(c, 2) AS content, CASE WHEN c IS NOT NULL THEN {_BAND.format(x='c')} + 1 END AS content_likert,
    CASE WHEN c IS NOT NULL THEN ({_BANDS['content']})[{_BAND.format(x='c')} + 1] WHEN condition_id = 'view' AND n > 0 THEN '— (reference)' END AS content_band, round(r, 2) AS realism, CASE WHEN r IS NOT NULL THEN {_BAND.format(x='r')} + 1 END AS realism_likert, CASE WHEN r IS NOT NULL THEN ({_BANDS['realism']})[{_BAND.format(x='r')} + 1] END AS realism_band FROM j
  UNION ALL SELECT place, trial_type, condition_id, count(*), count(DISTINCT listener_id), round(avg(content), 2), NULL, NULL, round(avg(realism), 2), NULL, NULL FROM lr JOIN co USING (condition_id) WHERE trial_type <> 'other' GROUP BY 1, 2, 3
  UNION ALL SELECT -1, 'all', '', count(*), count(DISTINCT listener_id), NULL, NULL, NULL, NULL, NULL, NULL FROM lr""",
)
def listening_summary(spark, d):
    kind = F.when(F.col("category") == "drums", "mixture").when(F.col("category").isin("piano", "strings"), "stem").otherwise("other")
    r = A.ratings(spark, d).select("listener_id", F.col("variant_id").alias("condition_id"), kind.alias("trial_type"), ((F.col("variant_id") == "view") | F.col("auto_assigned")).alias("is_reference"), "content", "realism")
    return D.listening_summary(r, _CONDITIONS, "view")


def _lengths(column: str) -> str:
    return f"SELECT * FROM (SELECT '{column}' AS section, {column} AS key, count(s) AS n, NULL::DOUBLE AS mean, round(median(s), 2) AS median, NULL::DOUBLE AS p95, NULL::DOUBLE AS p99, round(max(s), 2) AS max FROM so WHERE {column} IS NOT NULL GROUP BY 2 ORDER BY n DESC, key LIMIT 10)"


@query(
    "duration_report",
    """, sg AS (SELECT s.*, genre FROM stems s JOIN songs_meta USING (song_id)), so AS (SELECT song_id, max(wall_seconds) AS s, arg_min(program::VARCHAR, track) AS program, arg_min(is_drum::VARCHAR, track) AS is_drum, arg_min(name, track) FILTER (name IS NOT NULL) AS name, arg_min(genre, track) AS genre FROM sg GROUP BY 1)
  SELECT 'summary' AS section, '' AS key, count(s) AS n, round(avg(s), 2) AS mean, round(median(s), 2) AS median, round(quantile_cont(s, 0.95), 2) AS p95, round(quantile_cont(s, 0.99), 2) AS p99, round(max(s), 2) AS max FROM so UNION ALL """
    + " UNION ALL ".join(map(_lengths, ("program", "is_drum", "name", "genre"))),
)
def duration_report(spark, d):
    x = A.stems(spark, d).join(A.songs_meta(spark, d).select("song_id", "genre"), "song_id").withColumnRenamed("wall_seconds", "seconds")
    return D.duration_report(x.select("song_id", "track", "seconds", "program", "is_drum", "name", "genre"), ["program", "is_drum", "name", "genre"])


@query("clipped_lengths", "SELECT song_id, least(song_length, 300.0) AS song_length FROM songs_meta WHERE all_valid AND song_length IS NOT NULL")
def clipped_lengths(spark, d):
    """The columns of a subset that are needed, lengths as numbers, null ones dropped, long ones clipped."""
    x = A.songs_meta(spark, d).filter("all_valid").select("song_id", F.col("song_length").cast("string").try_cast("double").alias("s"))
    return x.filter("s is not null").select("song_id", F.least("s", F.lit(300.0)).alias("song_length"))


def _songs_csv(spark, d):
    """The song table as it is recorded: paths from a dot on, flags as text."""
    m = A.songs_meta(spark, d)
    song = F.col("song_id")
    return m.select(
        "path", F.concat(F.lit("./mid/"), song, F.lit(".mid")).alias("mid"), F.col("song_no").alias("tracks"), "genre", F.lit("x").alias("metadata"),
        F.when(F.col("all_valid"), "True").otherwise("False").alias("subset:all_valid"), F.col("rated_deduplicated").cast("string").alias("subset:rated_deduplicated"),
    )


@query("render_dataset", "SELECT '/pdmx/data/raw/' || song_id AS path, '/pdmx/mid/' || song_id || '.mid' AS mid, song_no AS tracks, genre, '/out/basic/' || song_id AS path_output, '/pdmx/mid/' || song_id || '.mid' AS mid_pdmx FROM songs_meta WHERE all_valid")
def render_dataset(spark, d):
    """S42."""
    return collection.render_rows(_songs_csv(spark, d), "/pdmx", "/out", "basic")


@query("subset_mids", "SELECT '/pdmx/mid/' || song_id || '.mid' AS mid FROM songs_meta WHERE all_valid AND rated_deduplicated")
def subset_mids(spark, d):
    """S39, P30."""
    return collection.of_subset(_songs_csv(spark, d), "rated_deduplicated").select(collection.mid_path(F.col("mid"), "/pdmx/").alias("mid"))


@query("recorded_programs", ", t AS (SELECT song_id, string_agg(program, '-' ORDER BY track) AS tracks FROM stems GROUP BY 1), u AS (SELECT song_id, unnest(string_split(tracks, '-'))::INT AS program FROM t JOIN songs_meta USING (song_id) WHERE all_valid) SELECT program, count(*) AS n FROM u GROUP BY 1")
def recorded_programs(spark, d):
    """Programs of the track lists of valid songs."""
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("track", "program"))), lambda s: s["program"].cast("string")), "-")  # a song's tracks are few
    x = A.stems(spark, d).groupBy("song_id").agg(own.alias("tracks")).join(A.songs_meta(spark, d).select("song_id", F.col("all_valid").alias("subset:all_valid")), "song_id")
    x = collection.of_subset(x, "all_valid").select(F.explode(collection.track_programs(F.col("tracks"))).alias("program"))
    return x.groupBy("program").agg(F.count(F.lit(1)).alias("n"))


@query("midi_index", _ROUTE + _GM_SQL.replace("SELECT *,", "SELECT song_id AS sid, track AS t,") + _SPEC_SQL + """, tb AS (SELECT song_id, CASE WHEN spec.method = 'midi-ddsp' AND routed.backend IN ('midi_ddsp', 'ddsp_piano') THEN routed.backend ELSE 'fluidsynth' END AS backend FROM routed JOIN g ON sid = song_id AND t = track JOIN spec USING (category))
  SELECT song_id, '/corrected/' || song_id || '.mid' AS mid, count(*) AS n_tracks, count(*) FILTER (backend = 'fluidsynth') AS n_fluidsynth, count(*) FILTER (backend = 'ddsp_piano') AS n_ddsp_piano, count(*) FILTER (backend = 'midi_ddsp') AS n_midi_ddsp FROM tb GROUP BY 1""")
def midi_index(spark, d):
    """S45."""
    return collection.midi_index(A.stems(spark, d), _spec(spark), "/corrected")


@query("track_maps", "SELECT song_id, array_to_string(list(track || '>' || program || coalesce('/' || name, '') ORDER BY track), '|') AS tracks FROM stems GROUP BY 1")
def track_maps(spark, d):
    """Each song's map from tracks to their rows."""
    rows = F.array_sort(F.collect_list(F.struct("track", "program", "name")))
    x = A.stems(spark, d).groupBy("song_id").agg(F.map_from_entries(F.transform(rows, lambda r: F.struct(r["track"], r))).alias("m"))
    text = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"].cast("string"), F.lit(">"), e["value"]["program"].cast("string"), F.coalesce(F.concat(F.lit("/"), e["value"]["name"]), F.lit(""))))
    return x.select("song_id", F.array_join(text, "|").alias("tracks"))


@query("normalised_manifest", "SELECT event_id, coalesce(CASE WHEN event_id % 17 <> 0 THEN variant_id END, '') AS variant_id, try_cast(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE (event_id * 2)::VARCHAR END AS BIGINT) AS track FROM ratings")
def normalised_manifest(spark, d):
    """A typed manifest: text without nulls, numbers null where they are none."""
    e = F.col("event_id")
    raw = A.ratings(spark, d).select("event_id", F.when(e % 17 != 0, F.col("variant_id")).alias("variant_id"), F.when(e % 5 == 0, "n/a").otherwise((e * 2).cast("string")).alias("track"))
    return raw.select("event_id", F.coalesce("variant_id", F.lit("")).alias("variant_id"), F.col("track").try_cast("long").alias("track"))


@query("arm_results", "SELECT train_arm, test_set, song_no, target, si_sdr FROM metrics QUALIFY row_number() OVER (PARTITION BY train_arm, test_set, song_no, target ORDER BY event_id DESC) = 1")
def arm_results(spark, d):
    """Results of all arms, the last row of each song and target."""
    m = A.metrics(spark, d)
    parts = [m.filter(F.col("train_arm") == a) for a in range(3)]
    x = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return keep_last(x, ["train_arm", "test_set", "song_no", "target"], ["event_id"]).drop("event_id")
