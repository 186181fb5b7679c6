"""The alias dimension's source, the keyed needle join, and seeded picks, against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from stemloom.functions import picks
from stemloom.operators import register
from stemloom.sources import files

ALIAS_FILE = """# corrections
generic_skip:
  - Melody
  - "right hand"   # quoted
family_defaults:
  - needle: guitar
    program: 24
    gm_class: guitar
aliases:
  # longest wins
  - needle: 'Ténor Sax'
    program: 66

  - needle: sax
    program: 65
  - needle: "ピアノ"
    program: 0
  - needle: chor
    program: 52
"""


def test_alias_file(spark, tmp_path):
    (tmp_path / "aliases.yaml").write_text(ALIAS_FILE)
    got = files.read_aliases(spark, f"{tmp_path}/aliases.yaml")
    assert {tuple(r) for r in got.collect()} == {
        ("skip", "melody", None, None), ("skip", "right hand", None, None), ("family", "guitar", 24, "guitar"), ("alias", "tenor sax", 66, None),
        ("alias", "sax", 65, None), ("alias", "ピアノ", 0, None), ("alias", "chor", 52, None),
    }
    names = [("Melody", 5), ("Ténor  sax, 2", 0), ("saxhorn", 0), ("alto sax", 0), ("Harpsichord", 0), ("Chor", 0), ("my guitar", 30), ("my guitar", 0), ("ピアノ", 9), ("Tenor Sax", 66), ("Right Hand", 1)]
    stems = spark.createDataFrame([(k, n, p, False) for k, (n, p) in enumerate(names)], "k int, name string, program int, is_drum boolean")
    rows = {r.k: (r.status, r.program_corrected, r.match_key) for r in register.resolve(stems, got).collect()}
    assert [rows[k] for k in range(len(names))] == [
        ("skipped_generic", 5, None), ("corrected", 66, "tenor sax"), ("skipped_no_match", 0, None), ("corrected", 65, "sax"), ("corrected", 6, "harpsichord"), ("corrected", 52, "chor"),
        ("keep", 30, None), ("corrected", 24, "guitar"), ("corrected", 0, "ピアノ"), ("keep", 66, None), ("skipped_generic", 1, None),
    ]


@pytest.mark.parametrize("text", ["aliases:\n  - needle: x\n", "odd:\n  - needle: x\n    program: 1\n"])
def test_broken_alias_files_are_errors(spark, tmp_path, text):
    (tmp_path / "a.yaml").write_text(text)
    with pytest.raises(Exception, match="no program for|unknown section"):
        files.read_aliases(spark, f"{tmp_path}/a.yaml").collect()


def test_needle_join_by_brute_force(spark):
    rng = random.Random(3)
    word = lambda low, high: "".join(rng.choice("ab1 -é") for _ in range(rng.randrange(low, high))).strip()
    names = sorted({w for _ in range(150) if (w := word(1, 16))})
    needles = sorted({(w, rng.randrange(4)) for _ in range(120) if (w := word(1, 8))})

    def inside(needle, name):
        if len(needle) < 5:
            return bool(re.search(rf"(^|[^a-z0-9]){re.escape(needle)}([^a-z0-9]|$)", name))
        return needle in name

    want = {(n, w, p) for n in names for w, p in needles if inside(w, n)}
    x = spark.createDataFrame([(n,) for n in names], "folded string")
    y = spark.createDataFrame(needles, "needle string, program int")
    assert {tuple(r) for r in register.hits(x, y).collect()} == want and len(want) > 50
    best = {}
    for n in names:
        own = [(w, p) for m, w, p in want if m == n]
        if own:
            top = [(w, p) for w, p in own if len(w) == max(len(v) for v, _ in own)]
            best[n] = (min(w for w, _ in top), min(p for _, p in top), max(p for _, p in top))
    assert {r.folded: (r.needle, r.low, r.high) for r in register.longest_hits(x, y).collect()} == best


def test_no_nested_loop_in_the_plan(spark):
    stems = spark.createDataFrame([("Violin", 0, False)], "name string, program int, is_drum boolean")
    aliases = register.alias_rows(spark, [("violin", 40)], [("organ", 19, "organ")], ["x"])
    plan = register.resolve(stems, aliases)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def seed(*parts):
    return int.from_bytes(hashlib.sha256("\0".join(map(str, parts)).encode()).digest()[:8], "big") & 0x7FFFFFFF


def test_picks_are_those_of_the_generator(spark):
    fonts = ["a", "b", "c", "d", "e"]
    rows = [(k, f"song{k}", fonts[: k % 6]) for k in range(60)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "k int, song string, fonts array<string>")
    got = {r.k: r.p for r in df.select("k", picks.pick(F.col("fonts"), F.lit(42), F.col("song"), F.lit("piano")).alias("p")).collect()}
    for k, song, own in rows[:-1]:
        assert got[k] == (random.Random(seed(42, song, "piano")).choice(own) if own else None)
    assert got[99] is None
    pools = {"piano": (0, 1, 2), "organ": (16, 0, 17)}
    x = df.select("k", "song", F.when(F.col("k") % 3 == 0, F.array(F.lit("piano"), F.lit("organ"))).when(F.col("k") % 3 == 1, F.array(F.lit("organ"))).otherwise(F.array(F.lit("none"))).alias("keys"))
    x = x.filter("song is not null").select("k", picks.select_patch(F.col("k"), picks.candidates(pools, F.col("keys")), F.lit(1), F.col("song")).alias("p"))
    for r in x.collect():
        own = ([0, 1, 2, 16, 17], [16, 0, 17], [])[r.k % 3]
        assert r.p == (random.Random(seed(1, f"song{r.k}")).choice(own) if own else r.k)


def test_names_are_folded_once_for_all_their_rows(spark):
    """A rule on folded names stays above the groups of names, where each is judged once."""
    from pyspark.sql import functions as F

    from stemloom.operators import register

    df = spark.createDataFrame([("Violín", 40), ("Violín", 40), ("Harp", 3)], "name string, program int")
    x = register.with_folded(df, "program")
    x = x.filter(register.agrees_with_name(F.col("folded"), F.col("program")))
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate") :]
    assert "translate(" not in below and "exists(" not in below
    assert [tuple(r) for r in x.collect()] == [("Violín", 40, "violin")]
