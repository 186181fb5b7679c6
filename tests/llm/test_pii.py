"""Personal data against plain loops over Python's re, and against DuckDB."""

import hashlib
import re
import time

import pytest

from stemloom.llm import pii
from tests.oracle import assert_same, duck

ODD = [
    (1, "mail a.b@c.de, or a@b.c@d.e and a@b.c_x@d.e; x@y z@w. .19@mail5.example.com"),
    (2, None),
    (3, ""),
    (4, "1.2.3.4.5.6.7.8 256.1.1.1 001.02.0003.255 1..2.3.4 9.9.9 0000000000000000000000001.1.1.1"),
    (5, "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 4111111111111111111 79927398713 0000000000000000"),
    (6, "+1 (743) 555-3824 +1234567 +12345678 +1 2 +1 (((((  +49-30-123 456 789 01234567 +123456789012345 +1234567890123456"),
    (7, "same +1 743 555 3824"),
    (7, "same +1 743 555 3824"),
    (None, "😀é a@b.co 東京 1.1.1.1 \x01 b@c.de \x02\x01"),
    (8, "IBAN DE89 3704 0044 0532 0130 00, serial GB82WEST12345698765432 and GB82WEST12345698765432. xDE89370400440532013000 DE89370400440532013001"),
    (9, "ssn 123-45-6789 and 000-12-3456; nothing near" + " far" * 20 + " 123-45-6789. Call 743-555-3824, not +1) 743-555-3824"),
    (10, "amex card 378282246310005, isbn 378282246310005" + " far" * 20 + " 378282246310005"),
    (11, "a@" * 500 + "b.c" + " 1.1.1.1" * 700 + " c@d.ee" * 300),
    (12, "@.@ a@-.- %+_@x.y 1-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 0.0.0.0 +0()0 +1\t234567890"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, i, "x", "y") for i, t in ODD], "doc_id long, text string, row long, Spans string, email string")


def passes(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


def base(text):
    out, plain = [], pii.PLAIN
    out += [("email", *m.span()) for m in re.finditer(plain["email"], text)]
    out += [("ip", *m.span()) for m in re.finditer(plain["ip"], text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(plain["digits"], text) if 16 <= len(digits(m)) <= 19 and passes(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(plain["phone"], text) if 8 <= len(digits(m)) <= 15]
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans_of_odd_rows(odd):
    got = pii.find(odd).select("row.*", "spans").toDF("doc_id", "text", "row", "S", "email", "spans").collect()
    assert len(got) == len(ODD)
    for r in got:
        want = base(r.text or "")
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE] == want, r.text
        assert all(s.score >= pii.LEAST for s in r.spans)


def test_further_spans(odd):
    found = {}
    for r in pii.find(odd).select("row.doc_id", "row.text", "spans").collect():
        found.setdefault(r.doc_id, []).extend((s.kind, r.text[s.start : s.end]) for s in r.spans if s.kind not in pii.BASE)
    assert found[8] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]  # not the one after "serial"
    assert found[9] == [("ssn", "123-45-6789"), ("tel", "743-555-3824")]
    assert found[10] == [("short_card", "378282246310005")]
    assert not any(v for k, v in found.items() if k not in (8, 9, 10))


def test_query_is_digest_of_spans_and_sql(spark, odd, tmp_path):
    odd.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op12_pii(spark, str(tmp_path))
    for r in got.join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        want = base(r.text or "")
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest() and r.spans.startswith(joined(want))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in want) for k in pii.BASE]
    con = duck("/root/testdata/sf0.001")
    con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert_same(got, con, pii.ORACLE_SQL)


def test_whole_table_against_sql(spark):
    assert_same(pii.op12_pii(spark, "/root/testdata/sf0.001"), duck("/root/testdata/sf0.001"), pii.ORACLE_SQL)


def test_empty_table(spark, odd):
    assert pii.find(odd.limit(0)).count() == 0


UNITS = ["a", "1", "1 ", "a.", "1.", "+1 ", "A", "AB12", "a@", "a@b", "a@b.c ", "1.1.1.1 ", "+1 (743) 555-3824 "]


def test_long_texts_take_linear_time(spark):
    docs = spark.createDataFrame([(n, k, u * (n // len(u))) for n in (2_000, 200_000) for k, u in enumerate(UNITS)], "n long, k long, text string").repartition(2 * len(UNITS))
    pii.find(docs.filter("n = 2000")).selectExpr("size(spans) n").collect()
    began = time.time()
    got = {(r.n, r.k): r.s for r in pii.find(docs).selectExpr("row.n", "row.k", "size(spans) s").collect()}
    assert time.time() - began < 30
    for k, unit in enumerate(UNITS):
        want = len(base(unit * (2_000 // len(unit))))
        assert got[2_000, k] == want or unit == "AB12"
        assert abs(got[200_000, k] - 100 * want) <= 100 or unit == "AB12"
