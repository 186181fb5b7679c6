"""Measures of fixed-size numeric arrays, all as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemloom.functions import exprs as X


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _mean(x: Column) -> Column:
    return _sum(x) / F.size(x)


def active_samples(x: Column, hop: int, least_rms: float) -> Column:
    """Samples in hops whose RMS reaches the gate; the rest goes to the last hop."""
    n = F.floor(F.size(x) / hop)
    hops = F.sequence(F.lit(0), (n - 1).cast("int"))
    part = lambda i: F.slice(x, i * hop + 1, F.when(i == n - 1, F.size(x) - i * hop).otherwise(F.lit(hop)).cast("int"))
    got = F.aggregate(hops, F.lit(0), lambda s, i: s + F.when(X.rms(F.slice(x, i * hop + 1, F.lit(hop))) >= least_rms, F.size(part(i))).otherwise(0))
    whole = F.when(X.rms(x) >= least_rms, F.size(x)).otherwise(0)
    return F.when(n >= 1, got).otherwise(whole)


def si_sdr(estimate: Column, reference: Column, eps: float = 1e-8) -> Column:
    """Scale-invariant signal-to-distortion ratio in dB of mean-centred arrays, cut to one length."""
    n = F.least(F.size(estimate), F.size(reference))
    e0, r0 = F.slice(estimate, F.lit(1), n), F.slice(reference, F.lit(1), n)
    both = F.transform(F.array(F.struct(_mean(e0).alias("me"), _mean(r0).alias("mr"))), lambda m: F.struct(F.transform(e0, lambda v: v - m["me"]).alias("e"), F.transform(r0, lambda v: v - m["mr"]).alias("r")))[0]

    def ratio(p: Column) -> Column:
        e, r = p["e"], p["r"]
        dot = _sum(F.zip_with(e, r, lambda a, b: a * b))
        scale = F.transform(F.array((dot + eps) / (_sum(F.transform(r, lambda v: v * v)) + eps)), lambda s: F.struct(s.alias("s"), e.alias("e"), r.alias("r")))[0]
        target = lambda q: _sum(F.transform(q["r"], lambda v: (q["s"] * v) * (q["s"] * v)))
        noise = lambda q: _sum(F.zip_with(q["e"], q["r"], lambda a, b: (a - q["s"] * b) * (a - q["s"] * b)))
        return F.transform(F.array(scale), lambda q: 10 * F.log10((target(q) + eps) / (noise(q) + eps)))[0]

    return F.when(n > 0, F.transform(F.array(both), ratio)[0])


def mix_sum(df: DataFrame, group: str, x: str) -> DataFrame:
    """(group, pos, total): sample-wise sum, shorter arrays padded with zeros."""
    return df.select(group, F.posexplode(x).alias("pos", "v")).groupBy(group, "pos").agg(F.sum("v").alias("total"))


def mix_peak(summed: DataFrame, group: str, limit: float = 0.99) -> DataFrame:
    """The peak of each mix and the gain that keeps it below a limit."""
    p = summed.groupBy(group).agg(F.max(F.abs("total")).alias("peak"), F.count(F.lit(1)).alias("length"))
    return p.withColumn("gain", F.when(F.col("peak") > limit, limit / F.col("peak")).otherwise(1.0))


def matches_sum(mix: Column, total: Column, atol: float = 1e-4, rtol: float = 1e-3, most_delta: int = 1) -> Column:
    """Whether a mix equals a sum; the tolerance scales with the sum."""
    n = F.least(F.size(mix), F.size(total))
    close = F.forall(F.zip_with(F.slice(mix, F.lit(1), n), F.slice(total, F.lit(1), n), lambda a, b: F.abs(a - b) <= atol + rtol * F.abs(b)), lambda v: v)
    return (F.abs(F.size(mix) - F.size(total)) <= most_delta) & close


def spans(total: Column, chunk: int, overlap: int) -> Column:
    """[start, end) of overlapping windows that cover a length; the first that reaches it is the last."""
    hop = chunk - overlap
    last = F.when(total <= chunk, 0).otherwise(F.ceil((total - chunk) / hop))
    return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.struct((i * hop).alias("start"), F.least(i * hop + chunk, total.cast("int")).alias("end")))


def stitched(df: DataFrame, group: str, start: str, x: str, overlap: int) -> DataFrame:
    """Windows put together again, linearly cross-faded where they overlap."""
    p = df.select(group, start, F.size(x).alias("n"), F.posexplode(x).alias("k", "v"))
    rise = F.when((F.col(start) > 0) & (F.col("k") < overlap), (F.col("k") + 1) / (overlap + 1)).otherwise(1.0)
    fall = F.when(F.col("n") - F.col("k") <= overlap, (F.col("n") - F.col("k")) / (overlap + 1)).otherwise(1.0)
    p = p.withColumn("w", F.least(rise, fall)).withColumn("pos", F.col(start) + F.col("k"))
    return p.groupBy(group, "pos").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))


def energy_ratio(mix: Column, stem: Column, eps: float = 1e-8) -> Column:
    """Rms of a stem over that of its mix, 0 for a silent mix."""
    return F.when(X.rms(mix) > eps, X.rms(stem) / X.rms(mix)).otherwise(0.0)


def crop_starts(n: Column, segment: int, fractions: tuple[float, ...] = (0.25, 0.5, 0.75)) -> Column:
    """Starts of evaluation crops at fixed fractions of the room that is left."""
    room = F.greatest(F.lit(0), n - segment)
    return F.array_distinct(F.transform(F.array(*map(F.lit, fractions)), lambda f: F.floor(room * f).cast("int")))


def downmix(a: Column, b: Column) -> Column:
    """The mean of two channels."""
    return F.zip_with(a, b, lambda p, q: (p + q) / 2)


def best_window(x: Column, width: int, hop: int) -> Column:
    """Start of the window with the highest RMS, the first of equals."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(x) - width) / hop)).cast("int"))
    scored = F.transform(starts, lambda i: F.struct(X.rms(F.slice(x, i * hop + 1, F.lit(width))).alias("r"), (-i * hop).alias("s")))
    return -F.array_max(scored)["s"]
