"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

# The patterns of the four base kinds. `find` uses forms of them that find the same spans
# in time linear in the text: a run is entered at its start, or where the last match ended, and left whole.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
DIGITS = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "digits": r"[0-9]([\x20-]?[0-9])+",
    "phone": PHONE,
    "iban": IBAN,
}
OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})){3}$"
SSN = r"^(00[1-9]|0[1-9][0-9]|[1-578][0-9][0-9]|6[0-57-9][0-9]|66[0-57-9])-(0[1-9]|[1-9][0-9])-(000[1-9]|00[1-9][0-9]|0[1-9][0-9][0-9]|[1-9][0-9][0-9][0-9])$"
TEL = r"^[2-9][0-9]{2}[ -][0-9]{3}[ -][0-9]{4}$"
#: Text before and after a candidate that is searched for words that speak for it, in code points; words against it stand before.
NEAR = 40
#: Score that a span of the further kinds needs; a telling word gives or takes WORD, in thousandths.
LEAST, WORD = 700, 300
#: Scores of what the pattern and the checksum of each further kind give together.
PROPOSED = {"iban": 800, "ssn": 450, "tel": 400, "short_card": 450}
SPEAKS = {
    "iban": r"(?i)iban|account|bank|konto|cuenta|compte",
    "ssn": r"(?i)\bssn\b|social security",
    "tel": r"(?i)\b(phone|tel|call|mobile|fax|telefon|teléfono|appel)",
    "short_card": r"(?i)\b(card|visa|amex|diners|karte|tarjeta|carte)",
}
AGAINST = r"(?i)\b(isbn|issn|serial|version|part number|order number|sku|example)"
KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "tel", "short_card"]
BASE = KINDS[:4]
MARK = "\x01"
BLOCK = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, first: Column) -> Column:
    """first and the sums of it with each prefix of the values; for short arrays."""
    return F.aggregate(values, F.array(first), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))


def starts_of(lengths: Column) -> Column:
    """Where each of consecutive pieces starts: sums over blocks first, then within each block."""
    zero = F.lit(0).cast("long")

    def by_blocks(x: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))
        part = lambda b: F.slice(x, b * BLOCK + 1, BLOCK)
        sums = F.transform(blocks, lambda b: F.aggregate(part(b), zero, lambda a, v: a + v))
        within = lambda base: F.flatten(F.transform(blocks, lambda b: F.slice(_running(part(b), F.get(base, b)), F.lit(1), F.size(part(b)))))
        return _let(_running(sums, zero), within)

    return _let(F.transform(lengths, lambda v: v.cast("long")), by_blocks)


def matches(text: Column, pattern: str, may: Column) -> Column:
    """Leftmost non-overlapping matches: (start, end, m, before, after), in code points, end exclusive.

    The text is cut at its matches, so a piece's place is the sum of the lengths before it. `may` is a
    cheap test that every text with a match passes.
    """
    safe = F.translate(text, MARK, "\x02")  # no pattern has either character
    pieces = F.split(F.regexp_replace(safe, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)

    def hit(p: Column, s: Column) -> Callable[[Column], Column]:
        at = lambda k: F.get(p, k)
        return lambda k: F.struct(
            F.get(s, k).alias("start"),
            (F.get(s, k) + F.char_length(at(k))).alias("end"),
            at(k).alias("m"),
            F.substring(at(k - 1), -NEAR, NEAR).alias("before"),
            F.substring(at(k + 1), 1, NEAR).alias("after"),
        )

    each = lambda p: _let(starts_of(F.transform(p, F.char_length)), lambda s: F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), hit(p, s)))
    kind = "array<struct<start:bigint,end:bigint,m:string,before:string,after:string>>"
    found = _let(pieces, lambda p: F.when(F.size(p) > 2, each(p)))
    return F.coalesce(F.when(may, found), F.array().cast(kind))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether at most 20 digits pass the Luhn check."""
    plain = F.lpad(digits, 20, "0")
    twice = F.translate(plain, "0123456789", "0246813579")
    digit = lambda i: F.substr(F.when(i % 2 == 1, twice).otherwise(plain), i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), lambda a, i: a + digit(i)) % 10 == 0


def mod97(m: Column) -> Column:
    """Whether an account number's letters and digits, its first four moved to the end, leave 1 by 97."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    value = lambda s, i: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substr(s, i, F.lit(1))) - 1
    step = lambda s: lambda a, i: _let(value(s, i), lambda v: (a * F.when(v < 10, 10).otherwise(100) + v) % 97)
    return _let(turned, lambda s: F.aggregate(F.sequence(F.lit(1), F.char_length(s)), F.lit(0), step(s))) == 1


def _stands_alone(h: Column) -> Column:
    """No letter, digit or sign beside it that would make it part of something longer."""
    return ~h["before"].rlike(r"[A-Za-z0-9.@+_%-]$") & ~h["after"].rlike(r"^(?:[A-Za-z0-9@_%-]|\.[0-9])")


def _scored(hits: Column, kind: str, test: Callable[[Column], Column]) -> Column:
    """The candidates of a further kind that its test and the words beside them confirm."""
    near = lambda h: F.concat(h["before"], F.lit(" "), h["after"])
    score = lambda h: F.lit(PROPOSED[kind]) + F.when(near(h).rlike(SPEAKS[kind]), WORD).otherwise(0) - F.when(h["before"].rlike(AGAINST), WORD).otherwise(0)
    sure = F.filter(hits, lambda h: test(h) & _stands_alone(h) & (score(h) >= LEAST))
    return _spans(sure, kind, score)


def _spans(hits: Column, kind: str, score: Callable[[Column], Column] = lambda _: F.lit(1000)) -> Column:
    return F.transform(hits, lambda h: F.struct(F.lit(kind).alias("kind"), h["start"].alias("start"), h["end"].alias("end"), score(h).cast("int").alias("score")))


def find(docs: DataFrame) -> DataFrame:
    """(row, spans) of each row of docs: spans has (kind, start, end, score), by kind, then start.

    Base kinds are matches that pass their test: e-mail addresses, IP addresses with parts up to 255,
    cards of 16 to 19 digits that pass Luhn, phone numbers of 8 to 15 digits after a plus; their score
    is 1000. Further kinds have to reach LEAST: account numbers by mod-97 (a word such as "serial"
    beside one drops it), and, only beside a word that speaks for them, social security numbers,
    national phone numbers and shorter cards that pass Luhn. Spans of one kind don't overlap.

    Each row is judged where it is read, nothing is shuffled. Null and empty texts have no spans;
    repeated rows are judged alike, each; an empty table gives an empty result; all columns, whatever
    their names, travel in `row`; very long texts take time in proportion to their length and matches.
    """
    text = F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    has = lambda s: F.contains(text, F.lit(s))
    x = docs.select(
        T.packed(docs),
        matches(text, EMAIL, has("@")).alias("email"),
        matches(text, IP, has(".") & text.rlike(r"[0-9]\.[0-9]")).alias("ip"),
        matches(text, DIGITS, text.rlike(r"[0-9][\x20-]?[0-9]")).alias("digits"),
        matches(text, PHONE, has("+")).alias("phone"),
        matches(text, IBAN, text.rlike(r"[A-Z]{2}[0-9]{2}")).alias("iban"),
    )
    number = lambda h: F.char_length(digits_of(h["m"]))
    alone = lambda h: ~h["before"].rlike(r"[+(.)][ ().0-9-]*$")
    spans = [
        _spans(F.col("email"), "email"),
        _spans(F.filter("ip", lambda h: h["m"].rlike(OCTETS)), "ip"),
        _spans(F.filter("digits", lambda h: number(h).between(16, 19) & luhn(digits_of(h["m"]))), "card"),
        _spans(F.filter("phone", lambda h: number(h).between(8, 15)), "phone"),
        _scored(F.col("iban"), "iban", lambda h: mod97(h["m"])),
        _scored(F.col("digits"), "ssn", lambda h: h["m"].rlike(SSN)),
        _scored(F.col("digits"), "tel", lambda h: h["m"].rlike(TEL) & alone(h)),
        _scored(F.col("digits"), "short_card", lambda h: number(h).between(13, 15) & h["m"].rlike("^[3-6]") & luhn(digits_of(h["m"]))),
    ]
    return x.select("row", F.concat(*spans).alias("spans"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = find(T.documents(spark, sf_dir).select("doc_id", "text"))
    named = lambda s: F.array_join(F.transform(s, lambda h: F.concat_ws(":", h["kind"], h["start"], h["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda h: h["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda h: h["kind"].isin(BASE))
    return x.select(F.col("row.doc_id").alias("doc_id"), *map(count, BASE), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def _sql() -> str:
    found = " UNION ALL ".join(
        f"SELECT row, '{k}' AS k, i, p FROM (SELECT row, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM (SELECT row, string_split(regexp_replace(t, '({p})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS x FROM d))"
        for k, p in PLAIN.items()
    )
    words = lambda k: f"CASE WHEN regexp_matches(near, '{SPEAKS[k]}') THEN {WORD} ELSE 0 END - CASE WHEN regexp_matches(before, '{AGAINST}') THEN {WORD} ELSE 0 END"
    further = {
        "iban": ("iban", "(SELECT list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(m, 1, 4), ''), lambda c: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)), lambda a, v: (a * (CASE WHEN v < 10 THEN 10 ELSE 100 END) + v) % 97)) = 1"),
        "ssn": ("digits", f"regexp_matches(m, '{SSN}')"),
        "tel": ("digits", f"regexp_matches(m, '{TEL}') AND NOT regexp_matches(before, '[+(.)][ ().0-9-]*$')"),
        "short_card": ("digits", "n BETWEEN 13 AND 15 AND luhn AND regexp_matches(m, '^[3-6]')"),
    }
    rest = " ".join(f"UNION ALL SELECT row, {4 + j} AS o, '{k}' AS kind, start, stop FROM h WHERE k = '{src}' AND alone AND ({test}) AND {PROPOSED[k]} + {words(k)} >= {LEAST}" for j, (k, (src, test)) in enumerate(further.items()))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
f AS ({found}),
g AS (SELECT *, coalesce(sum(length(p)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
    lag(p) OVER w AS prev, lead(p) OVER w AS next FROM f WINDOW w AS (PARTITION BY row, k ORDER BY i)),
h0 AS (SELECT row, k, p AS m, start, (start + length(p))::BIGINT AS stop, right(prev, {NEAR}) AS before, left(next, {NEAR}) AS after, regexp_replace(p, '[^0-9]', '', 'g') AS ds FROM g WHERE i % 2 = 0),
h AS (SELECT *, length(ds) AS n, before || ' ' || after AS near,
    NOT regexp_matches(before, '[A-Za-z0-9.@+_%-]$') AND NOT regexp_matches(after, '^([A-Za-z0-9@_%-]|\.[0-9])') AS alone,
    length(ds) <= 19 AND list_sum(list_transform(range(0, length(ds)), lambda i: CASE WHEN i % 2 = 0 THEN ds[length(ds) - i]::INTEGER
      ELSE (2 * ds[length(ds) - i]::INTEGER) // 10 + (2 * ds[length(ds) - i]::INTEGER) % 10 END)) % 10 = 0 AS luhn FROM h0),
s AS (SELECT row, 0 AS o, 'email' AS kind, start, stop FROM h WHERE k = 'email'
  UNION ALL SELECT row, 1, 'ip', start, stop FROM h WHERE k = 'ip' AND (SELECT bool_and(length(ltrim(x, '0')) <= 3 AND lpad(ltrim(x, '0'), 3, '0') <= '255') FROM (SELECT unnest(string_split(m, '.')) AS x))
  UNION ALL SELECT row, 2, 'card', start, stop FROM h WHERE k = 'digits' AND n BETWEEN 16 AND 19 AND luhn
  UNION ALL SELECT row, 3, 'phone', start, stop FROM h WHERE k = 'phone' AND n BETWEEN 8 AND 15 {rest}),
l AS (SELECT row, count(*) FILTER (o = 0) AS n_email, count(*) FILTER (o = 1) AS n_ip, count(*) FILTER (o = 2) AS n_card, count(*) FILTER (o = 3) AS n_phone,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) FILTER (o < 4) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) AS spans FROM s GROUP BY row)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN l USING (row)
"""


ORACLE_SQL = _sql()
