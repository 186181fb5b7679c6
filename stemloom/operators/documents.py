"""Verification documents, validators and catalog listings, as tables with a row for each entry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemloom.functions import exprs as X
from stemloom.functions import values as V
from stemloom.operators import listening as L
from stemloom.operators.dedupe import keep_first, keep_last


def verification_meta(stats: DataFrame, least: float, mean: float) -> DataFrame:
    """Variants of each category with passed_filter, is_auto_winner and rank by realism."""
    passed = L.eligible(stats, least, mean).select("category", "variant_id", F.lit(True).alias("_p"))
    winner = L.auto_winners(L.eligible(stats, least, mean)).select("category", "variant_id", F.lit(True).alias("_w"))
    x = stats.join(passed, ["category", "variant_id"], "left").join(winner, ["category", "variant_id"], "left")
    rank = F.row_number().over(W.partitionBy("category").orderBy(F.desc_nulls_last("mean_realism"), F.desc_nulls_last("mean_content"), "variant_id"))  # variants, not ratings
    return x.select("category", "variant_id", "mean_realism", "mean_content", "n_stems", F.coalesce("_p", F.lit(False)).alias("passed_filter"), F.coalesce("_w", F.lit(False)).alias("is_auto_winner"), rank.alias("place"))


def approved(shortlists: DataFrame, votes: DataFrame) -> DataFrame:
    """C20: (category, approved): shortlisted variants, in their order, whose last vote is a strong accept; an empty list stays.

    shortlists: (category, place, variant_id).
    """
    last = keep_last(votes.select("category", "variant_id", "tier", "voted_at", "event_id"), ["category", "variant_id"], ["voted_at", "event_id"])
    x = shortlists.join(last.filter("tier = 'strong_accept'").select("category", "variant_id", F.lit(True).alias("_a")), ["category", "variant_id"], "left")
    rows = F.array_sort(F.collect_list(F.when(F.col("_a"), F.struct("place", "variant_id"))))
    return x.groupBy("category").agg(F.transform(rows, lambda r: r["variant_id"]).alias("approved"))


def winners(doc: DataFrame, patch: bool) -> DataFrame:
    """The winners of a document (category, approved, winner, bypass): lists of a patch sweep, else one variant."""
    if patch:
        return doc.filter("category is not null and size(approved) > 0").select("category", F.array_join("approved", "|").alias("winners"))
    return doc.filter("category is not null and not coalesce(bypass, false) and winner is not null").select("category", F.col("winner").alias("winners"))


def bypassed(doc: DataFrame, stems: DataFrame) -> DataFrame:
    """Categories where every stem (category, bypass) is bypassed; where there are no stems, the category's flag holds."""
    s = stems.groupBy("category").agg(F.bool_and(F.coalesce("bypass", F.lit(False))).alias("_s"))
    return doc.join(s, "category", "left").filter(F.coalesce("_s", "bypass", F.lit(False))).select("category")


def messages(doc: DataFrame, patch: bool = False, preset: bool = False) -> DataFrame:
    """(category, message): what is wrong with the entries of a document."""
    empty = lambda x: F.nullif(F.col(x), F.lit(""))  # noqa: E731  an empty text is as good as none
    c, winner, n = empty("category"), empty("winner"), F.coalesce(F.size("approved"), F.lit(0))
    if patch:
        tests = [F.when(n <= 0, F.concat(c, F.lit(": keep at least one soundfont")))]
    elif preset:
        tests = []
    else:
        live = ~F.coalesce("bypass", F.lit(False))
        tests = [
            F.when(live & (n <= 0), F.concat(c, F.lit(": approve at least one variant"))),
            F.when(live & winner.isNull(), F.concat(c, F.lit(": pick a winner"))),
            F.when(live & winner.isNotNull() & ~F.coalesce(F.array_contains("approved", winner), F.lit(False)), F.concat(c, F.lit(": winner must be among approved variants"))),
        ]
    # fixed values: the texts of these messages
    said = F.when(c.isNull(), F.array(F.lit("missing category"))).otherwise(F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>"))
    return doc.select("category", F.explode(said).alias("message"))


def category_detail(entries: DataFrame, names: DataFrame) -> DataFrame:
    """(category, variant_id, stems): per variant its stems and their names, missing ones kept."""
    x = entries.join(names, "stem_id", "left").groupBy("category", "variant_id").agg(F.array_sort(F.collect_set(F.struct("stem_id", F.coalesce("name", F.lit("?")).alias("name")))).alias("_s"))
    return x.select("category", "variant_id", F.array_join(F.transform("_s", lambda s: F.concat(s["stem_id"].cast("string"), F.lit(":"), s["name"])), "|").alias("stems"))


def probe_faults(probes: DataFrame, target: int, categories: tuple[str, ...]) -> DataFrame:
    """(fault, detail): categories with another number than the target, ids and keys that repeat.

    probes: (id, category, song_id, track, legacy).
    """
    spark = probes.sparkSession
    n = spark.createDataFrame([(c,) for c in categories], "category string").join(probes.groupBy("category").agg(F.count_if(~F.col("legacy")).alias("n")), "category", "left")
    sign = F.when(F.col("n") < target, " < ").otherwise(" > ")
    count = n.filter(F.coalesce("n", F.lit(0)) != target).select(F.when(F.col("n").isNull(), "missing").otherwise("count").alias("fault"), F.when(F.col("n").isNull(), F.col("category")).otherwise(F.concat("category", F.lit(": "), F.col("n").cast("string"), sign, F.lit(str(target)))).alias("detail"))
    ids = probes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("id").alias("fault"), F.col("id").cast("string").alias("detail"))
    name = F.concat("song_id", F.lit("/"), F.col("track").cast("string"))
    live = probes.groupBy("song_id", "track").agg(F.count_if(~F.col("legacy")).alias("n"), F.count_if("legacy").alias("m"))
    keys = live.filter("n > 1").select(F.lit("key").alias("fault"), name.alias("detail"))
    reused = live.filter("n > 0 and m > 0").select(F.lit("reused").alias("fault"), name.alias("detail"))
    return reduce(DataFrame.unionByName, [count, ids, keys, reused])


def fits_category(gm_class: Column, category: Column) -> Column:
    """Whether the class may stand in the category; a category without classes takes none."""
    allowed = {}
    for g, c in V.CATEGORY_CLASSES:
        allowed.setdefault(c, []).append(g)
    out = F.lit(False)
    for c, classes in {**allowed, "drums": ["drums"]}.items():
        out = F.when(category == c, gm_class.isin(*classes)).otherwise(out)
    return out


def misplaced(stems: DataFrame) -> DataFrame:
    """(category, gm_class, n): stems in a category that doesn't take their class."""
    return stems.filter(~fits_category(F.col("gm_class"), F.col("category"))).groupBy("category", "gm_class").agg(F.count(F.lit(1)).alias("n"))


def locked(first: DataFrame, second: DataFrame, default: str) -> DataFrame:
    """(category, primary, fonts, fx): the first phase's list, its first id, and the second phase's choice or a default."""
    x = first.join(second.select("category", F.col("winner").alias("_w")), "category", "left")
    return x.filter("size(approved) > 0").select("category", F.element_at("approved", 1).alias("primary"), F.array_join("approved", "|").alias("fonts"), F.coalesce("_w", F.lit(default)).alias("fx"))


def fonts_by_category(lists: DataFrame, catalog: DataFrame) -> DataFrame:
    """(category, fonts): the titles of a category's fonts, each once, in an order that ignores case."""
    x = lists.select("category", F.explode("approved").alias("font")).join(catalog, "font", "left").select("category", F.coalesce("title", "font").alias("t"))
    rows = F.array_sort(F.collect_set(F.struct(F.lower("t").alias("k"), "t")))
    return x.groupBy("category").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "|").alias("fonts"))


def pooled(*lists: Column) -> Column:
    """The members of some lists in their order, each once."""
    return F.array_distinct(F.flatten(F.array(*lists)))


def equivalences(trials: DataFrame, allowed: dict[str, str]) -> DataFrame:
    """(trial_id, duplicate, donor) of trials (trial_id, equivalences map), of allowed pairs only."""
    x = trials.filter("trial_id is not null").select("trial_id", F.explode("equivalences").alias("duplicate", "donor"))
    on = F.lit(False)
    for a, b in allowed.items():
        on = on | ((F.col("duplicate") == a) & (F.col("donor") == b))
    return x.filter(on)


def unique_conditions(conditions: tuple[str, ...], duplicates: Column) -> Column:
    """Conditions in their order without the duplicates."""
    return F.filter(F.array(*map(F.lit, conditions)), lambda c: ~F.coalesce(F.array_contains(duplicates, c), F.lit(False)))


def listing(songs: DataFrame, stems: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Every song with the categories of its stems, in a fixed order; stems without a category add none."""
    have = stems.groupBy("song_id").agg(F.collect_set("category").alias("_c"))
    kept = F.filter(F.array(*map(F.lit, order)), lambda c: F.array_contains("_c", c))
    return songs.join(have, "song_id", "left").select("song_id", F.coalesce(F.array_join(kept, "|"), F.lit("")).alias("categories"))


def present(stems: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """C11: (place, category): categories that some stem has, with their place in the fixed order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("category"))
    return stems.select("category").distinct().withColumn("place", place).filter("place > 0")


def stem_list(manifest: DataFrame, overrides: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each stem, with the category that an override gives it."""
    x = keep_first(manifest, ["stem_id"], order).join(overrides.select("stem_id", F.col("category").alias("_o")), "stem_id", "left")
    return x.withColumn("category", F.coalesce("_o", "category")).drop("_o")


def swipe_cards(manifest: DataFrame, seed: int, category: str | None = None) -> DataFrame:
    """Cards (variant, category, clip) with the clips of their stem over the whole manifest, and a seeded key of their order."""
    clips = manifest.groupBy("stem_id").agg(F.countDistinct("clip_id").alias("n_clips"))
    x = (manifest if category is None else manifest.filter(F.col("category") == category)).select("variant_id", "category", "stem_id", "clip_id").distinct().join(clips, "stem_id")
    return x.withColumn("shuffle", F.md5(F.concat_ws("|", F.lit(str(seed)), "variant_id", "category", F.col("stem_id").cast("string"), F.col("clip_id").cast("string"))))


def clip_rows(manifest: DataFrame, windows: DataFrame, old: DataFrame) -> DataFrame:
    """Manifest rows of each clip window of their stem; old rows stay for stems that have no new ones."""
    new = manifest.join(windows, "stem_id")
    return new.unionByName(old.join(new.select("stem_id").distinct(), "stem_id", "left_anti").select(new.columns))


def tagged(catalog: DataFrame, tags: list[str], ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Entries by id where ids are given, else those that share a tag; the first `limit` by id."""
    x = catalog.filter(F.col("id").isin(*ids)) if ids else catalog.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else catalog
    return x if limit is None else x.orderBy("id").limit(limit)


def condition_tables(songs: DataFrame, stems: DataFrame, conditions: tuple[str, ...], seconds: float) -> DataFrame:
    """Stems of the songs for each condition, with the condition's paths and the clips' fixed length."""
    x = stems.join(songs.select("song_id").distinct(), "song_id", "left_semi").withColumn("condition", F.explode(F.array(*map(F.lit, conditions))))
    path = F.concat(F.lit("clips/"), "condition", F.lit("/"), "song_id", F.lit("/"), F.col("track").cast("string"), F.lit(".flac"))
    return x.select("condition", "song_id", "track", path.alias("path"), F.lit(seconds).alias("duration_sec"))


def media_paths(stems: DataFrame, track_map: DataFrame, suffix: str = ".flac") -> DataFrame:
    """(song_id, track, file): the folder of the track map where the song has one, else that of the raw path."""
    x = stems.join(track_map.select("song_id", F.col("path").alias("_m")), "song_id", "left")
    folder = F.coalesce("_m", F.regexp_replace("path", "/raw/", "/audio/"))
    return x.select("song_id", "track", F.concat(folder, F.lit("/"), F.col("track").cast("string"), F.lit(suffix)).alias("file"))


def canonical(rows: DataFrame, keys: list[str], order: list[str], old: str, new: str) -> DataFrame:
    """Paths under `old` moved to `new`, then the last row of each key."""
    moved = F.when(F.col("path").startswith(old), F.concat(F.lit(new), F.substr("path", F.lit(len(old) + 1)))).otherwise(F.col("path"))
    return keep_last(rows.withColumn("path", moved), keys, order)


def corrected_files(register: DataFrame) -> DataFrame:
    """(song_id, programs, n_tracks): each file's corrected programs by track."""
    rows = F.array_sort(F.collect_list(F.struct("track", "program")))
    x = register.groupBy("song_id").agg(rows.alias("_r"))
    return x.select("song_id", F.array_join(F.transform("_r", lambda r: F.concat(r["track"].cast("string"), F.lit(":"), r["program"].cast("string"))), "|").alias("programs"), F.size("_r").alias("n_tracks"))


def files_by_target(stems: DataFrame, cues: tuple[tuple[str, str], ...], skip: tuple[str, ...] = ()) -> DataFrame:
    """(song_id, target, files): existing files by the target of their instrument; instruments without one go.

    stems: (song_id, file, instrument, present). An exact name decides; names to skip have no target.
    """
    target = F.lit(None).cast("string")
    for name, t in cues:
        target = F.when(F.col("instrument") == name, t).otherwise(target)
    target = F.when(F.col("instrument").isin(*skip), None).otherwise(target) if skip else target
    x = stems.filter("present").withColumn("target", target).filter("target is not null")
    return x.groupBy("song_id", "target").agg(F.array_join(F.array_sort(F.collect_set("file")), "|").alias("files"))


def top_corrections(report: DataFrame, n: int) -> DataFrame:
    """The n most frequent corrections (name, program, program_corrected, n)."""
    x = report.filter("status = 'corrected'").groupBy("name", "program", "program_corrected").agg(F.count(F.lit(1)).alias("n"))
    return x.orderBy(F.desc("n"), "name", "program").limit(n)


def listening_summary(ratings: DataFrame, conditions: tuple[str, ...], reference: str) -> DataFrame:
    """(place, section, key, n, listeners, content, content_likert, content_band, realism, realism_likert, realism_band).

    ratings: (listener_id, condition_id, trial_type, is_reference, content, realism). Section `all` has the
    counts, `condition` a row for each condition in the order given, rated or not, `mixture` and `stem` the
    means by condition of their trials. Content leaves out ratings of the reference itself, in `condition`;
    the reference condition has no content. Means have two digits. One pass; conditions are a few rows.
    """
    rated = ratings.filter(F.col("condition_id").isin(*conditions))
    heard = ~F.coalesce("is_reference", F.lit(False))
    mean = lambda x: F.round(F.avg(x), 2)
    every = ratings.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("listener_id").alias("listeners")).select(F.lit("all").alias("section"), F.lit("").alias("key"), "n", "listeners")
    by = rated.groupBy("condition_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("listener_id").alias("listeners"), F.avg(F.when(heard, F.col("content"))).alias("c"), F.avg("realism").alias("r"))
    # a condition whose content was heard only as the reference keeps the mean of what there is, the reference itself none
    rest = rated.groupBy("condition_id").agg(F.avg("content").alias("any"))
    order = ratings.sparkSession.createDataFrame([(k, c) for k, c in enumerate(conditions)], "place int, condition_id string")
    x = order.join(by, "condition_id", "left").join(rest, "condition_id", "left")
    c = F.when(F.col("condition_id") == reference, F.col("c")).otherwise(F.coalesce("c", "any"))
    label = lambda v, rubric: F.when(v.isNotNull(), X.band_label(v, rubric))
    rubrics = [F.round(c, 2).alias("content"), F.when(c.isNotNull(), X.likert(c)).alias("content_likert"), F.coalesce(label(c, "content"), F.when((F.col("condition_id") == reference) & F.col("n").isNotNull(), "— (reference)")).alias("content_band")]
    rubrics += [F.round("r", 2).alias("realism"), F.when(F.col("r").isNotNull(), X.likert(F.col("r"))).alias("realism_likert"), label(F.col("r"), "realism").alias("realism_band")]
    x = x.select("place", F.lit("condition").alias("section"), F.col("condition_id").alias("key"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("listeners", F.lit(0)).alias("listeners"), *rubrics)
    kinds = rated.filter(F.col("trial_type").isin("mixture", "stem")).groupBy("trial_type", "condition_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("listener_id").alias("listeners"), mean("content").alias("content"), mean("realism").alias("realism"))
    kinds = kinds.join(order, "condition_id").select("place", F.col("trial_type").alias("section"), F.col("condition_id").alias("key"), "n", "listeners", "content", "realism")
    return x.unionByName(kinds, allowMissingColumns=True).unionByName(every.withColumn("place", F.lit(-1)), allowMissingColumns=True)


def duration_report(stems: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """(section, key, n, mean, median, p95, p99, max): lengths of songs.

    stems: (song_id, track, seconds, *columns). A song is as long as its longest stem. Section `summary`
    has one row; each column has a section with its `most` most frequent values, by the first track's
    value of a song; rows of equal count stand by key. Values of a column are counted in one pass each.
    """
    first = [F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), F.col("track"))).alias(c) for c in columns]
    songs = stems.groupBy("song_id").agg(F.max("seconds").alias("s"), *first)
    at = lambda p: F.round(F.percentile("s", p), 2)
    out = songs.agg(F.count("s").alias("n"), F.round(F.avg("s"), 2).alias("mean"), at(0.5).alias("median"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.round(F.max("s"), 2).alias("max"))
    out = out.select(F.lit("summary").alias("section"), F.lit("").alias("key"), "*")
    for c in columns:
        x = songs.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("key")).agg(F.count("s").alias("n"), at(0.5).alias("median"), F.round(F.max("s"), 2).alias("max"))
        out = out.unionByName(x.orderBy(F.desc("n"), "key").limit(most).withColumn("section", F.lit(c)), allowMissingColumns=True)
    return out
