"""Instrument register: program corrections from track names, by an alias dimension and a keyed needle join."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemloom.functions import exprs as X
from stemloom.functions import values as V

#: Needles from so many characters on may stand anywhere in a name; shorter ones stand between other characters than letters and digits.
ANYWHERE = 5
ALIASES = "list string, needle string, program int, gm_class string"
#: The lists of a dimension in the order in which they decide; those of the list `skip` are names that tell no instrument.
LISTS = ("alias", "family", "gm")


def gm_tokens(name: str) -> list[str]:
    """Telling words of a GM name."""
    return [t for t in re.sub(r"[()+,/]", " ", name.lower()).split() if len(t) >= 4 and t not in V.GM_STOPWORDS]


def gm_needles(spark: SparkSession) -> DataFrame:
    """(needle, program): names and telling words of GM names that belong to one program only."""
    found: dict[str, set[int]] = {}
    for p, name in enumerate(V.GM_NAMES):
        whole = " ".join(re.sub(r"[()+,/]", " ", name.lower()).split())
        for n in {whole, *gm_tokens(name)}:
            if len(n) >= 4:
                found.setdefault(n, set()).add(p)
    return spark.createDataFrame([(n, min(p)) for n, p in sorted(found.items()) if len(p) == 1], "needle string, program int")


def folded(name: Column) -> Column:
    """A name as it is compared: sanitised, in lower case, without accents; '' where there is none."""
    return F.trim(X.fold_accents(F.coalesce(X.sanitize_name(name), F.lit(""))))


def with_folded(rows: DataFrame, *keep: str) -> DataFrame:
    """Distinct rows (name, *keep) with their folded name; a name is folded once, whatever the number of rows that have it."""
    x = rows.groupBy("name", *keep).agg(F.count(F.lit(1)).alias("_n"))
    # a column that needs the count: the optimiser can't move what asks for it below the groups, to each row
    return x.select("name", *keep, F.when(F.col("_n") > 0, folded(F.col("name"))).alias("folded"))


def dimension(entries: DataFrame) -> DataFrame:
    """The entries of an alias dimension (list, needle, program, gm_class), needles as names are compared; empty ones go."""
    x = entries.select("list", folded(F.col("needle")).alias("needle"), F.col("program").cast("int").alias("program"), "gm_class")
    return x.filter("needle <> ''").distinct()


def alias_rows(spark: SparkSession, aliases: Sequence[tuple[str, int]], families: Sequence[tuple[str, int, str]] = (), skip: Sequence[str] = ()) -> DataFrame:
    """A small alias dimension from Python's values."""
    rows = [("alias", n, p, None) for n, p in aliases] + [("family", n, p, c) for n, p, c in families] + [("skip", n, None, None) for n in skip]
    return dimension(spark.createDataFrame(rows, ALIASES))


def _keys(name: Column) -> Column:
    """What a needle in the name can have as its key: each stretch of ANYWHERE characters, and each shorter one between boundaries."""
    padded, size = F.concat(F.lit(" "), name, F.lit(" ")), F.length(name)
    edge = lambda i: F.instr(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), F.substr(padded, i, F.lit(1))) == 0
    long = F.when(size >= ANYWHERE, F.transform(F.sequence(F.lit(1), size - (ANYWHERE - 1)), lambda i: F.substr(name, i, F.lit(ANYWHERE))))
    starts = F.filter(F.sequence(F.lit(1), size), edge)
    lengths = F.array(*map(F.lit, range(1, ANYWHERE)))
    whole = lambda i: F.transform(F.filter(lengths, lambda k: (i + k <= size + 1) & edge(i + k + 1)), lambda k: F.substr(name, i, k))
    short = F.flatten(F.transform(starts, whole))
    return F.array_distinct(F.concat(F.coalesce(long, F.array().cast("array<string>")), short))


def hits(names: DataFrame, needles: DataFrame, *more: str) -> DataFrame:
    """(folded, *columns of needles): each needle in each name, by a join on keys.

    A needle's key is the needle itself where it is short, else its first ANYWHERE characters; a name
    has as many keys as characters. names (folded) are distinct and not empty.
    """
    keyed = names.select("folded", *more, F.explode(_keys(F.col("folded"))).alias("key"))
    x = needles.withColumn("key", F.substring("needle", 1, ANYWHERE))
    x = keyed.join(x, "key").filter((F.length("needle") < ANYWHERE) | F.col("folded").contains(F.col("needle")))
    return x.drop("key").distinct()


def longest_hits(names: DataFrame, needles: DataFrame) -> DataFrame:
    """Per name the longest needle in it (the first of them), and the lowest and highest program of needles that long."""
    x = hits(names.select("folded").filter("folded <> ''").distinct(), needles.select("needle", "program"))
    x = x.groupBy("folded", F.length("needle").alias("len")).agg(F.min("needle").alias("needle"), F.min("program").alias("low"), F.max("program").alias("high"))
    best = x.groupBy("folded").agg(F.max_by(F.struct("needle", "low", "high"), "len").alias("b"))
    return best.select("folded", "b.*")


def decisive_hits(names: DataFrame, needles: DataFrame) -> DataFrame:
    """Per name the longest needle of the first list that has any: (folded, list, needle, low, high, gm_class)."""
    x = hits(names, needles)
    place = F.array_position(F.array(*map(F.lit, LISTS)), F.col("list"))
    x = x.groupBy("folded", "list", F.length("needle").alias("len")).agg(
        F.min("needle").alias("needle"), F.min("program").alias("low"), F.max("program").alias("high"), F.min_by("gm_class", "needle").alias("gm_class")
    )
    best = x.groupBy("folded").agg(F.max_by(F.struct("list", "needle", "low", "high", "gm_class"), F.struct(-place, F.col("len"))).alias("b"))
    return best.select("folded", "b.*")


def agrees_with_name(name: Column, program: Column) -> Column:
    """Whether a name already looks like its GM program: one contains the other, or the name has a telling word of it."""
    known = F.element_at(F.array(*[F.lit(n.lower()) for n in V.GM_NAMES]), (program + 1).cast("int"))  # plain ASCII
    gm = F.when(program.between(0, 127), known).otherwise(F.concat(F.lit("unknown program "), program.cast("string")))
    tokens = F.array(*[F.array(*map(F.lit, gm_tokens(n))) if gm_tokens(n) else F.array().cast("array<string>") for n in V.GM_NAMES])
    own = F.when(program.between(0, 127), F.element_at(tokens, (program + 1).cast("int")))
    # the optimiser puts what makes a name into each place that names it
    return X.once(name, lambda n: n.contains(gm) | gm.contains(n) | F.coalesce(F.exists(own, lambda t: X.needle_in_name(t, n)), F.lit(False)))


def resolve(stems: DataFrame, aliases: DataFrame) -> DataFrame:
    """Stems with program_corrected, status and match_key, by an alias dimension (list, needle, program, gm_class).

    In order: drums, unnamed, generic, agrees with its GM name, aliases, family defaults (unless the
    program is of their class already), GM names. At each list the longest needle decides; needles of
    one length with different programs are ambiguous.

    All is decided once for each distinct name and program, whatever the number of stems that have them.
    """
    spark = stems.sparkSession
    name, program = F.col("folded"), F.col("program")
    spelt = with_folded(stems, "program")
    pairs = spelt.filter("folded <> ''").select("folded", "program").distinct()
    names = pairs.select("folded").distinct()
    gm = gm_needles(spark).select(F.lit("gm").alias("list"), "needle", "program", F.lit(None).cast("string").alias("gm_class"))
    found = decisive_hits(names, aliases.filter(F.col("list").isin(*LISTS)).unionByName(gm))
    skip = aliases.filter("list = 'skip'").select(F.col("needle").alias("folded"), F.lit(True).alias("skip")).distinct()
    same = (F.col("low") == program) | F.coalesce((F.col("list") == "family") & (X.gm_class(program, F.lit(False)) == F.col("gm_class")), F.lit(False))
    status = (
        F.when(F.coalesce("skip", F.lit(False)) | X.is_generic_name(name), "skipped_generic")
        .when(agrees_with_name(name, program), "keep")
        .when(F.col("needle").isNull(), "skipped_no_match")
        .when(F.col("low") != F.col("high"), "skipped_ambiguous")
        .when(same, "keep_alias")
        .otherwise("corrected")
    )
    decided = pairs.join(found, "folded", "left").join(skip, "folded", "left").select("folded", "program", "low", "needle", status.alias("decision"))
    by_needle = F.col("decision").isin("skipped_ambiguous", "keep_alias", "corrected")
    decided = decided.select(
        F.col("folded").alias("_f"), F.col("program").alias("_p"), F.when(F.col("decision") == "corrected", F.col("low")).alias("_to"),
        F.when(F.col("decision") == "keep_alias", "keep").otherwise(F.col("decision")).alias("_s"), F.when(by_needle, F.col("needle")).alias("_k"),
    )
    decided = spelt.join(decided, (F.col("folded") == F.col("_f")) & F.col("program").eqNullSafe(F.col("_p")), "left").drop("_f", "_p")
    decided = decided.withColumnsRenamed({"name": "_n", "program": "_p"})
    x = stems.join(decided, F.col("name").eqNullSafe(F.col("_n")) & F.col("program").eqNullSafe(F.col("_p")), "left")
    drum = F.coalesce(F.col("is_drum"), F.lit(False))
    return x.select(
        *stems.columns,
        F.when(~drum, F.coalesce("_to", "program")).otherwise(program).cast("int").alias("program_corrected"),
        F.when(drum, "skipped_drum").when(name == "", "skipped_unnamed").otherwise(F.col("_s")).alias("status"),
        F.when(~drum, F.col("_k")).alias("match_key"),
    )
