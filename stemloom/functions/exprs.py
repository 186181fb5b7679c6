"""Scalar functions of the catalog as Column expressions; all stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def _any(name: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(n) for n in needles])


def _clean(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit(""))))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once a row, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def sanitize_name(name: Column) -> Column:
    """No NUL, commas to spaces, white space collapsed; empty becomes null."""
    x = F.replace(name, F.lit("\0"), F.lit(""))
    return F.nullif(F.trim(F.regexp_replace(F.translate(x, ",", " "), r"\s+", " ")), F.lit(""))


def normalize_name(name: Column) -> Column:
    """The sanitised name in lower case, a sentinel when there is none."""
    return F.coalesce(F.lower(sanitize_name(name)), F.lit("(unnamed)"))


def gm_class(program: Column, is_drum: Column) -> Column:
    """Drums first, else one of 16 classes; programs out of range fall in the outer classes."""
    return F.when(is_drum, "drums").otherwise(_of_class(program, V.GM_CLASSES))


def _of_class(program: Column, values: Sequence[str]) -> Column:
    """The value of a program's GM class."""
    at = F.least(F.lit(15), F.greatest(F.lit(0), F.floor(program / 8).cast("int")))
    return F.element_at(F.array(*map(F.lit, values)), at + 1)


def probe_category(program: Column, is_drum: Column, name: Column) -> Column:
    """Drums, then cues in the name in order, then the GM class."""
    of_class = dict(V.CATEGORY_CLASSES)

    def by_name(n: Column) -> Column:
        out = F.when(n == "", None)
        for category, needles in V.CATEGORY_NAMES:
            out = out.when(_any(n, needles), category)
        return out

    by_program = _of_class(program, [of_class.get(c, "polyphonic") for c in V.GM_CLASSES])
    return F.when(is_drum, "drums").otherwise(F.coalesce(once(_clean(name), by_name), by_program))


def separation_target(program: Column, is_drum: Column) -> Column:
    """Drums, piano, guitar, bass, or null."""
    out = F.when(is_drum, "drums")
    for target, low, high in V.TARGETS:
        out = out.when(program.between(low, high), target)
    return out


def class_text_target(text: Column, is_drum: Column) -> Column:
    """A target from an instrument class's text: exact, else the first one it contains."""
    t = F.lower(F.trim(text))
    out = F.when(is_drum, "drums").when(t == "", None)
    for needle, target in (("bass", "bass"), ("drums", "drums"), ("drum", "drums"), ("guitar", "guitar"), ("piano", "piano")):
        out = out.when(t == needle, target)
    for needle, target in (("bass", "bass"), ("drum", "drums"), ("guitar", "guitar"), ("piano", "piano")):
        out = out.when(t.contains(needle), target)
    return out


def gm_id(program: Column, is_drum: Column) -> Column:
    """128 for drums, else the program; -1 where it is no number."""
    return F.when(is_drum, 128).otherwise(F.coalesce(program.cast("string").try_cast("int"), F.lit(-1)))


def program_name(program: Column) -> Column:
    """The GM name of a program."""
    names = F.array(*map(F.lit, V.GM_NAMES))
    return F.when(program.between(0, 127), F.element_at(names, (program + 1).cast("int"))).otherwise(F.concat(F.lit("Unknown program "), program.cast("string")))


def gm_id_label(gm: Column) -> Column:
    """P09: "id: name"."""
    return F.concat(gm.cast("string"), F.lit(": "), F.when(gm == 128, "Drums (channel 10)").when(gm.between(0, 127), program_name(gm)).otherwise("Unknown"))


def gm_paper_label(gm: Column) -> Column:
    """P10: "name (id)", drums bare."""
    return F.when(gm == 128, "Drums").otherwise(F.concat(program_name(gm), F.lit(" ("), gm.cast("string"), F.lit(")")))


def parse_tracks(cell: Column) -> Column:
    """The integers of a text joined by -; blank tokens skipped, one bad token makes it null."""
    tokens = F.filter(F.split(cell, "-"), lambda t: F.trim(t) != "")
    ints = F.transform(tokens, lambda t: F.trim(t).try_cast("int"))
    return F.when(F.trim(cell) == "", None).when(F.exists(ints, lambda t: t.isNull()), None).otherwise(ints)


def parse_pipe(cell: Column) -> Column:
    """The integers of a text joined by pipes or commas."""
    tokens = F.filter(F.split(F.translate(cell, ",", "|"), r"\|"), lambda t: F.trim(t) != "")
    return F.transform(tokens, lambda t: F.trim(t).cast("int"))


@cache
def _folding() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(characters, what each becomes, longer ones): by Unicode's compatibility decomposition without its marks.

    Characters beyond the end of the second text are marks, which go.
    """
    single, longer, marks = {}, [], []
    for k in [*range(0x80, 0x3000), *range(0xFB00, 0xFB50), *range(0xFE00, 0x10000)]:
        c = chr(k)
        if unicodedata.combining(c):
            marks.append(c)
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if base != c and not 0xD800 <= k < 0xE000:
            if len(base) == 1:
                single[c] = base
            elif c.isalpha() and (k < 0x250 or 0xFB00 <= k <= 0xFB06):
                longer.append((c, base))
    return "".join(single) + "".join(marks), "".join(single.values()), tuple(longer)


def fold_accents(text: Column) -> Column:
    """Lower case without accents, of all scripts that write them; Latin ligatures as their letters."""
    have, to, longer = _folding()
    x = F.translate(F.lower(text), have, to)
    odd = "".join(c for c, _ in longer)
    # few texts have characters that become more than one: only those go through the map
    spelt = F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(_map(longer), c), c)), "")
    return F.when(x.rlike(f"[{re.escape(odd)}]"), spelt).otherwise(x)


def _map(pairs: tuple[tuple[str, str], ...]) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def needle_in_name(needle: Column, name: Column) -> Column:
    """Short needles must stand between other characters than letters and digits."""
    bounded = F.concat(F.lit(" "), F.regexp_replace(name, "[^a-z0-9]", " "), F.lit(" ")).contains(F.concat(F.lit(" "), needle, F.lit(" ")))
    return (needle != "") & F.when(F.length(needle) < 5, bounded).otherwise(name.contains(needle))


def is_generic_name(name: Column, skip: tuple[str, ...] = ()) -> Column:
    """A name that tells no instrument."""
    x = name.isNull() | (name == "") | (name == "(unnamed)") | name.rlike(r"^((track|part|staff|channel)[\s_\-]*\d+|\d+)$") | name.contains("musicxml")
    return x | name.isin(*skip) if skip else x


def neural_by_name(name: Column, program: Column) -> Column:
    """P20: the neural backend's instrument from the name; program 59 vetoes a trumpet."""
    return once(_clean(name), lambda n: _neural_by_name(n, program))


def _neural_by_name(n: Column, program: Column) -> Column:
    out = F.when((n == "") | _any(n, V.NEURAL_DENY), None)
    for needle, instrument in V.NEURAL_NAMES:
        out = out.when(n.contains(needle), F.when(program == 59, None).otherwise(instrument) if instrument == "trumpet" else F.lit(instrument))
    return out


def neural_by_program(program: Column, is_drum: Column) -> Column:
    """The neural backend's instrument from the program."""
    out = F.when(is_drum, None).when(program.between(32, 39), None).when(program.between(64, 67), "saxophone")
    for p, instrument in V.NEURAL_PROGRAMS.items():
        out = out.when(program == p, instrument)
    return out


def is_piano(program: Column, is_drum: Column, name: Column) -> Column:
    """An acoustic hammer piano."""
    return once(_clean(name), lambda n: _is_piano(program, is_drum, n))


def _is_piano(program: Column, is_drum: Column, n: Column) -> Column:
    acoustic = program.isin(0, 1, 3)
    named = n.contains("piano") & ~n.contains("guitar")
    return ~is_drum & ~_any(n, V.PIANO_DENY) & ~(program.between(0, 7) & ~acoustic) & (named | acoustic)


def is_vocal(program: Column, is_drum: Column, name: Column) -> Column:
    """A voice; bare part names of the saxophone family are none."""
    return once(_clean(name), lambda n: _is_vocal(program, is_drum, n))


def _is_vocal(program: Column, is_drum: Column, n: Column) -> Column:
    always = _any(n, V.VOCAL_ALWAYS)
    part = _any(n, V.VOCAL_PARTS) & ~_any(n, V.VOCAL_EXCEPT)
    return ~is_drum & F.when(program.between(64, 67), always).otherwise(always | part | program.between(52, 54))


def route(program: Column, is_drum: Column, name: Column, notes: Column | None = None, lasting: Column | None = None, monophonic: Column | None = None) -> Column:
    """Struct (backend, instrument, reason) of a stem.

    With its notes (how many sound, whether any lasts, whether never two sound at a time) stems without
    a note, or without one that lasts, go to the soundfont, and so do polyphonic ones of instruments that
    the neural backend plays one note at a time; without them the metadata alone decides.
    """

    def to(backend: str, instrument: Column, reason: str) -> Column:
        return F.struct(F.lit(backend).alias("backend"), instrument.alias("instrument"), F.lit(reason).alias("reason"))

    none = F.lit(None).cast("string")
    cls, by_program = gm_class(program, is_drum), neural_by_program(program, is_drum)
    out = F.when(is_drum, to("soundfont", none, "drum"))
    if notes is not None:
        out = out.when(notes == 0, to("soundfont", none, "empty"))
    if lasting is not None:
        out = out.when(~lasting, to("soundfont", none, "zero_duration"))

    def by_instrument(instrument: Column) -> Column:
        x = F.when(instrument.isNull(), to("soundfont", none, "unsupported"))
        if monophonic is not None:
            x = x.when(~monophonic, to("soundfont", instrument, "polyphonic"))
        return x.otherwise(to("midi_ddsp", instrument, "midi_ddsp"))

    def by_name(n: Column) -> Column:
        return (
            F.when(_is_vocal(program, is_drum, n), to("soundfont", none, "vocal"))
            .when(_is_piano(program, is_drum, n), to("ddsp_piano", F.lit("piano"), "piano"))
            .when(n.rlike(r"guitar|gitar|\blute\b|\bluit\b"), to("soundfont", none, "guitar"))
            .when(cls == "bass", to("soundfont", none, "bass_guitar"))
            .when(cls == "guitar", to("soundfont", none, "guitar"))
            .otherwise(once(F.coalesce(_neural_by_name(n, program), by_program), by_instrument))
        )

    return out.otherwise(once(_clean(name), by_name))


def parse_bool(c: Column) -> Column:
    """True, 1 and yes in any case are true; all else, null too, is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def chunk_id(c: Column) -> Column:
    """The plain number of a chunk id, as text."""
    return F.regexp_replace(F.trim(c), r"^chunk_", "").cast("int").cast("string")


def download_part(chunk: Column) -> Column:
    """Which of two parts a chunk is in."""
    return F.pmod(chunk.cast("int"), F.lit(2)) + 1


def song_id_from_mid(mid: Column) -> Column:
    """P35."""
    return F.regexp_replace(F.regexp_replace(F.replace(mid, F.lit("\\"), F.lit("/")), r"^[./]*(mid/)?", ""), r"\.mid$", "")


def song_id_from_meta(path: Column) -> Column:
    """Leading dots and slashes go as characters, not as a prefix."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]*(data/)?", ""), r"\.json$", "")


def song_id_from_recipe(path: Column) -> Column:
    """What follows the segment raw, else the last three segments."""
    x = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"/+$", "")
    parts = F.split(x, "/")
    at = F.array_position(parts, "raw").cast("int")
    tail = F.concat_ws("/", F.slice(parts, at + 1, F.size(parts)))
    last = F.substring_index(x, "/", -3)
    return F.when(at > 0, tail).otherwise(last)


def song_id_from_audio(path: Column) -> Column:
    """What follows the first marker of raw, audio or data, else the base name."""
    out = F.when(F.lit(False), path)
    for marker in ("/raw/", "/audio/", "/audio_summable/", "/data/"):
        out = out.when(path.contains(marker), F.element_at(F.split(path, marker, 2), 2))
    return out.otherwise(F.substring_index(path, "/", -1))


def raw_to_audio(path: Column) -> Column:
    """The released path of a raw one; null where there is no raw segment."""
    return F.when(path.rlike(r"(^\.|)/raw/"), F.regexp_replace(path, r"^(.*?)/raw/", "$1/audio/"))


def remap_prefix(path: Column, old: str, new: str) -> Column:
    """P40."""
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 20))).otherwise(path)


def clamp_score(x: Column) -> Column:
    """Half-even to a whole number from 0 to 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(x).cast("int")))


def band(x: Column) -> Column:
    """Bands of 20, the last one closed."""
    return F.least(F.lit(4), F.floor(clamp_score(x) / 20).cast("int"))


def likert(x: Column) -> Column:
    """P45."""
    return band(x) + 1


def band_midpoint(x: Column) -> Column:
    """P46."""
    return band(x) * 20 + 10


def band_label(x: Column, rubric: str) -> Column:
    """C49."""
    return F.element_at(F.array(*map(F.lit, V.BAND_LABELS[rubric])), band(x) + 1)


def is_rated(x: Column) -> Column:
    """P47."""
    return F.coalesce(x.cast("string").try_cast("double").between(0, 100), F.lit(False))


def noise_level(variant: Column) -> Column:
    """The number after noise, else minus infinity."""
    return F.coalesce(F.nullif(F.regexp_extract(variant, r"^noise(.+)$", 1), F.lit("")).try_cast("double"), F.lit(float("-inf")))


def stable_seed(*parts: Column) -> Column:
    """31 bits of sha-256 of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256), 9, 8), 16, 10).cast("long").bitwiseAND(0x7FFFFFFF)


def seeded_choice(options: Column, *parts: Column) -> Column:
    """One of a list by the stable seed; the seed is hashed, not run through a generator."""
    return F.when(F.size(options) > 0, F.try_element_at(options, (F.pmod(stable_seed(*parts), F.size(options)) + 1).cast("int")))


def seeded_order(seed: int, *key: Column) -> Column:
    """The order that stands for a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))


def category_from_trial(trial: Column) -> Column:
    """P54."""
    return F.nullif(F.regexp_extract(trial, r"^stem_(.+?)(_\d+)?$", 1), F.lit(""))


def caption(instruments: Column, template: str = "{}", none: str = "ensemble") -> Column:
    """Distinct instruments in order, in a template."""
    names = F.concat_ws(", ", F.array_sort(F.array_distinct(instruments)))
    before, after = template.split("{}")
    return F.concat(F.lit(before), F.when(names == "", none).otherwise(names), F.lit(after))


def slugify(name: Column) -> Column:
    """P57."""
    x = F.regexp_replace(F.lower(F.regexp_replace(name, r"\.[^./]*$", "")), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(x, "^_+|_+$", ""), F.lit("")), F.lit("soundfont"))


def tags(name: Column, hints: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """Tags whose hints the name holds, or general."""
    n = F.lower(name)
    found = F.array_compact(F.array(*[F.when(_any(n, needles), tag) for tag, needles in hints]))
    return F.when(F.size(found) == 0, F.array(F.lit("general"))).otherwise(found)


def is_neural_fallback(method: Column, backend: Column, reason: Column, reasons: tuple[str, ...]) -> Column:
    """A neural stem that was rendered by the soundfont backend."""
    b = F.coalesce(F.when(backend.isin("", "nan", "None"), None).otherwise(backend), F.lit("fluidsynth"))
    r = F.trim(F.coalesce(reason, F.lit("")))
    return F.coalesce(method == "midi-ddsp", F.lit(False)) & (b == "fluidsynth") & r.isin("", "nan", "None", "NA", "<NA>", *reasons)


def deletable_failure(reason: Column) -> Column:
    """P62."""
    return _any(reason, ("max|mix-sum|", "length mix=", "sample-rate mix="))


def count_label(n: Column, total: Column, least_pct: float = 1.0) -> Column:
    """P63: "n (p%)" above a share, else "n"."""
    pct = n * 100.0 / total
    return F.when((total > 0) & (n > 0) & (pct > least_pct), F.concat(n.cast("string"), F.lit(" ("), F.bround(pct).cast("long").cast("string"), F.lit("%)"))).otherwise(n.cast("string"))


def blind_label(position: Column) -> Column:
    """A to Z, AA on, by a position from 0."""
    char = lambda x: F.char((x + 65).cast("long"))
    return F.when(position < 26, char(position)).otherwise(F.concat(char(F.floor(position / 26) - 1), char(F.pmod(position, F.lit(26)))))


def rms(x: Column) -> Column:
    """Root mean square of an array; 0 for an empty one."""
    return F.when(F.size(x) > 0, F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) / F.size(x))).otherwise(0.0)


def pad_add(a: Column, b: Column) -> Column:
    """Sum of two arrays, the shorter one padded with zeros."""
    return F.zip_with(a, b, lambda p, q: F.coalesce(p, F.lit(0.0)) + F.coalesce(q, F.lit(0.0)))
