"""Windows of waveforms: energies of hops as rows, prefix sums over them, and the windows worth hearing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemloom.operators import planning

#: A sample is loud from this amplitude on.
LOUD = 0.01


def hops(waves: DataFrame, keys: Sequence[str], x: str, size: int, least_rms: float, loud: float = LOUD) -> DataFrame:
    """(*keys, hop, energy, active, loud): a row for each whole hop of `size` samples; what is left at the end goes.

    energy is the mean square, active whether its root reaches `least_rms`, loud the number of loud samples.
    """
    count = F.floor(F.size(x) / size).cast("int")
    part = lambda i: F.slice(x, i * size + 1, size)
    square = lambda i: F.aggregate(part(i), F.lit(0.0), lambda s, v: s + v.cast("double") * v) / size
    noise = lambda i: F.aggregate(part(i), F.lit(0), lambda s, v: s + (F.abs(v) >= loud).cast("int"))
    rows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("hop"), square(i).alias("energy"), noise(i).alias("loud")))
    y = waves.filter(count > 0).select(*keys, F.explode(rows).alias("h")).select(*keys, "h.*")
    return y.withColumn("active", (F.sqrt("energy") >= least_rms).cast("int"))


def sums(rows: DataFrame, keys: Sequence[str], width: int, *columns: str) -> DataFrame:
    """Each hop at which a window of `width` hops begins, with the sums of the columns over it: c_sum for c.

    Differences of running sums, so a window costs the same whatever its width.
    """
    order = W.partitionBy(*keys).orderBy("hop")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    x = rows.withColumns({f"_{c}": F.sum(c).over(so_far) for c in columns})
    x = x.withColumns({f"{c}_sum": F.lead(f"_{c}", width - 1).over(order) - F.col(f"_{c}") + F.col(c) for c in columns})
    return x.filter(F.col(f"{columns[0]}_sum").isNotNull()).drop(*[f"_{c}" for c in columns])


def audible_start(
    waves: DataFrame, keys: Sequence[str], rows: DataFrame, width: int, least_rms: float, step: int = 1, first: int = 0, least_active: float = 0.0, densest: bool = False
) -> DataFrame:
    """(*keys, start): the hop of the first window, or of the densest, that is loud and active enough; null where there is none.

    Windows begin at hop `first` and each `step` hops after it; dense is the share of active hops, the first of equals wins.
    """
    x = sums(rows, keys, width, "energy", "active").filter((F.col("hop") >= first) & ((F.col("hop") - first) % step == 0))
    share = F.col("active_sum") / width
    x = x.filter((F.sqrt(F.greatest(F.col("energy_sum"), F.lit(0.0)) / width) >= least_rms) & (share >= least_active))
    best = F.max_by("hop", F.struct(share.alias("share"), -F.col("hop"))) if densest else F.min("hop")
    return waves.select(*keys).distinct().join(x.groupBy(*keys).agg(best.alias("start")), list(keys), "left")


def best_start(waves: DataFrame, keys: Sequence[str], rows: DataFrame, width: int, least_rms: float, step: int = 1, room: int = 0) -> DataFrame:
    """(*keys, start, score): the window with the highest RMS that is loud enough, the first of equals.

    A wave with fewer than `width` + `room` hops has none; so has one whose windows are too quiet.
    """
    length = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    x = sums(rows, keys, width, "energy").filter(F.col("hop") % step == 0).join(length.filter(F.col("_n") >= width + room), list(keys))
    x = x.withColumn("rms", F.round(F.sqrt(F.greatest(F.col("energy_sum"), F.lit(0.0)) / width), 9)).filter(F.col("rms") >= least_rms)
    best = x.groupBy(*keys).agg(F.max(F.struct("rms", (-F.col("hop")).alias("start"))).alias("b"))
    return waves.select(*keys).distinct().join(best.select(*keys, (-F.col("b.start")).alias("start"), F.col("b.rms").alias("score")), list(keys), "left")


def all_active_start(waves: DataFrame, song: str, stem: str, rows: DataFrame, width: int, least_rms: float, step: int = 1, room: int = 0) -> DataFrame:
    """(song, start, score): the window in which all stems of a song are loud enough; null where there is none.

    The score is the least RMS times one and the mean RMS, so a balanced window wins; the first of equals.
    Each stem's windows are measured by themselves and meet as numbers; no song's waveforms come together.
    """
    length = rows.groupBy(song, stem).agg(F.count(F.lit(1)).alias("_n")).groupBy(song).agg(F.min("_n").alias("_least"))
    stems = waves.select(song, stem).distinct().groupBy(song).agg(F.count(F.lit(1)).alias("_stems"))
    x = sums(rows, [song, stem], width, "energy").filter(F.col("hop") % step == 0)
    x = x.withColumn("rms", F.sqrt(F.greatest(F.col("energy_sum"), F.lit(0.0)) / width + 1e-12))
    x = x.groupBy(song, "hop").agg(F.min("rms").alias("low"), F.avg("rms").alias("mean"), F.count(F.lit(1)).alias("_k"))
    x = x.join(stems, song).join(length, song).filter((F.col("_k") == F.col("_stems")) & (F.col("_least") >= width + room) & (F.col("low") >= least_rms))
    x = x.withColumn("score", F.round(F.col("low") * (1 + F.col("mean")), 9))
    best = x.groupBy(song).agg(F.max(F.struct("score", (-F.col("hop")).alias("start"))).alias("b"))
    return stems.select(song).join(best.select(song, (-F.col("b.start")).alias("start"), F.col("b.score").alias("score")), song, "left")


def onsets(rows: DataFrame, keys: Sequence[str], near: int = 3, around: int = 8, delta: float = 0.01) -> DataFrame:
    """The rows with onset: hops whose RMS rises by most among `near` hops to each side and by `delta` more than on average `around`.

    Of equal rises so near to each other the first is the onset, so two onsets are more than `near` hops apart.
    """
    order = W.partitionBy(*keys).orderBy("hop")
    rms = F.sqrt("energy")
    x = rows.withColumn("_rise", F.round(F.greatest(F.lit(0.0), rms - F.coalesce(F.lag(rms).over(order), F.lit(0.0))), 12))
    before = F.coalesce(F.max("_rise").over(order.rowsBetween(-near, -1)), F.lit(-1.0))
    after = F.coalesce(F.max("_rise").over(order.rowsBetween(1, near)), F.lit(-1.0))
    mean = F.avg("_rise").over(order.rowsBetween(-around, around))
    peak = (F.col("_rise") > before) & (F.col("_rise") >= after) & (F.col("_rise") >= F.round(mean, 12) + delta)
    return x.withColumn("onset", peak.cast("int")).drop("_rise")


def scores(rows: DataFrame, keys: Sequence[str], width: int, size: int, seconds: float, least_rms: float, step: int = 1, edge: float = 0.15) -> DataFrame:
    """(*keys, start, score) of each window that is loud enough: start in hops.

    Twice the RMS, the share of loud samples, a quarter of the onsets a second, less up to 0.35 for each
    end of the wave that is nearer than the longer of the window and `edge` of the wave. rows have `onset`;
    a hop has `size` samples and lasts `seconds`.
    """
    total = F.count(F.lit(1)).over(W.partitionBy(*keys))
    x = sums(rows.withColumn("_all", total), keys, width, "energy", "loud", "onset").filter(F.col("hop") % step == 0)
    x = x.withColumn("rms", F.sqrt(F.greatest(F.col("energy_sum"), F.lit(0.0)) / width)).filter(F.col("rms") >= least_rms)
    margin = F.greatest(F.lit(float(width)), F.col("_all") * edge)
    tail = F.greatest(F.col("_all") - F.col("hop") - width, F.lit(0))
    near = lambda room: F.when(room < margin, 0.35 * (1 - room / margin)).otherwise(0.0)
    score = 2 * F.col("rms") + F.col("loud_sum") / (width * size) + 0.25 * F.col("onset_sum") / (width * seconds) - near(F.col("hop")) - near(tail)
    return x.select(*keys, F.col("hop").alias("start"), F.round(score, 9).alias("score"))


def rich_clips(scored: DataFrame, keys: Sequence[str], n: int, apart: float) -> DataFrame:
    """(*keys, starts): up to n windows, best score first, each `apart` hops from the others, in ascending order.

    A wave's windows come together as pairs of numbers, a few for each second of it.
    """
    pairs = F.collect_list(F.struct("score", F.col("start").cast("double").alias("start")))
    return scored.groupBy(*keys).agg(planning.greedy_windows(pairs, n, apart).alias("starts"))


def padded(waves: DataFrame, group: str, x: str) -> DataFrame:
    """Arrays with zeros after them up to the longest of their group."""
    most = waves.groupBy(group).agg(F.max(F.size(x)).alias("_most"))
    zeros: Column = F.array_repeat(F.lit(0.0), F.col("_most") - F.size(x))
    return waves.join(most, group).withColumn(x, F.concat(F.col(x).cast("array<double>"), zeros)).drop("_most")
