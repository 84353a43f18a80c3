import hmac
import re

from hashwood.llm import op5_pii as P

TEXTS = [
    "Mail bosbt.42@mail8.example.com or call +1 (386) 555-3733, or +1-386-555-3733. IP 25.86.162.211!",
    "card 4041894974608795, 4041 8949 7460 8795; bad 4041894974608796. ssn 123-45-6789",
    "Mrs. Anna Schmidt and Mr SCHMIDT; Mr Schmidt; Госпожа Иванова met John Smith. Κυρία Παππά",
    "IBAN GB82WEST12345698765432, not GB82WEST12345698765433",
    "2001:0db8:85a3:0000:0000:8a2e:0370:7334 (555) 123-4567 555-123-4567 BOSBT.42@mail8.example.com",
    "DE89 3704 0044 0532 0130 00, 3782 822463 10005, 2001:db8::7334, fe80::1 and 555.123.4567 or 0171 2345678; Dr. Miller, David Miller",
    "plain Text 12, 3.4.5 and 999.1.1.1 with 1234567 and a@b only. Mrs and Mr.",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, n_card string, _attempts int")


def replaced(spark, texts, key="k"):
    return [r.text for r in P.pii(frame(spark, texts), key).orderBy("doc_id").collect()]


def test_formats(spark):
    out = replaced(spark, TEXTS)
    mail, phone, again, ip = re.fullmatch(r"Mail ([a-z]{5}\.\d\d@mail\d+\.example\.(?:com|org|net)) or call (\+1 \([2-9]\d\d\) \d{3}-\d{4}), or (\+1-[2-9]\d\d-\d{3}-\d{4})\. IP (10\.\d+\.\d+\.\d+)!", out[0]).groups()
    assert re.sub(r"\D", "", phone) == re.sub(r"\D", "", again)
    plain, spaced = re.fullmatch(r"card (4\d{15}), (4\d{3} \d{4} \d{4} \d{4}); bad 4041894974608796\. ssn 9\d\d-\d\d-\d{4}", out[1]).groups()
    assert spaced.replace(" ", "") == plain and luhn(plain) and plain != "4041894974608795"
    anna, schmidt, upper, same, ivanova, smith = re.fullmatch(r"Mrs\. ([A-Z][a-z]*a) ([A-Z][a-z]+) and Mr ([A-Z]+); Mr ([A-Z][a-z]+); Госпожа ([А-Я][а-я]+) met [A-Z][a-z]*[b-z] ([A-Z][a-z]+)\. Κυρία [Α-Ω][α-ω]+", out[2]).groups()
    assert upper == schmidt.upper() and same == schmidt != smith and ivanova != "Иванова" and anna != "Anna"
    account = re.fullmatch(r"IBAN (GB\d\d[A-Z]{4}\d{14}), not GB82WEST12345698765433", out[3])[1]
    assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1 and account != "GB82WEST12345698765432"
    assert re.fullmatch(r"fd00(:[0-9a-f]{4}){7} (\([2-9]\d\d\) \d{3}-\d{4}) [2-9]\d\d-\d{3}-\d{4} " + re.escape(mail), out[4]) and "7334" not in out[4]
    iban, amex, six, link, dotted, national, doctor, david = re.fullmatch(r"(DE\d\d(?: \d{4}){4} \d\d), (3\d{3} \d{6} \d{5}), (fd00(?::[0-9a-f]{4}){7}), (fd00(?::[0-9a-f]{4}){7}) and ([2-9]\d\d\.\d{3}\.\d{4}) or (0\d{3} \d{7}); Dr\. ([A-Z][a-z]+), [A-Z][a-z]*[b-z] ([A-Z][a-z]+)", out[5]).groups()
    account = iban.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1 and luhn(amex.replace(" ", "")) and six != link
    assert doctor == david != "Miller" and not {iban, amex, dotted, national} & set(TEXTS[5].split(", "))
    assert out[6] == TEXTS[6]


def test_key_and_repeats(spark):
    assert replaced(spark, TEXTS) == replaced(spark, TEXTS)
    assert all(a != b for a, b in zip(replaced(spark, TEXTS[:6]), replaced(spark, TEXTS[:6], key="other"), strict=True))


def test_counts_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, TEXTS[0], "x"), (1, TEXTS[0], "x"), (None, None, None), (2, "", "y")], "doc_id long, text string, n_card string")
    rows = sorted(P.pii(docs, "k").collect(), key=str)
    assert [(r.doc_id, r.n_email, r.n_phone, r.n_ipv4, r.n_card) for r in rows] == [(1, 1, 2, 1, 0), (1, 1, 2, 1, 0), (2, 0, 0, 0, 0), (None, 0, 0, 0, 0)]
    assert rows[0].text == rows[1].text and [r.text for r in rows[2:]] == ["", None]
    assert P.pii(docs.limit(0), "k").count() == 0


def test_clashes_are_resolved(spark):
    texts = [f"call +1 (3{i:02}) 555-37{j:02}; again +1 (3{i:02}) 555-37{j:02}" for i in range(8) for j in range(8)]
    docs = frame(spark, texts)
    short = lambda kind, entity, attempt: f"concat('+1', pmod(xxhash64({entity}, {attempt}), 100) + 1000000000)"
    found = P.entities(P.candidates(docs))
    higher = {(r.kind, r.entity): r.attempt for r in P.attempts(found, "k", short).collect()}
    assert higher
    rows = found.collect()
    assert len(rows) == 64
    value = lambda r: spark.sql(f"SELECT {short(chr(39) + r.kind + chr(39), chr(39) + r.entity + chr(39), chr(39) + str(higher.get((r.kind, r.entity), 0)) + chr(39))} v").first().v
    values = {value(r) for r in rows}
    assert len(values) == 64 and not values & {r.entity for r in rows}


def test_attempts_reach_the_texts(spark, monkeypatch):
    docs = frame(spark, TEXTS[:2])
    before = replaced(spark, TEXTS[:2])
    chosen = spark.createDataFrame([("phone", "+13865553733", 3)], "kind string, entity string, attempt int")
    for limit in (P.BROADCAST_TEXTS, 0):
        monkeypatch.setattr(P, "BROADCAST_TEXTS", limit)
        monkeypatch.setattr(P, "attempts", lambda *_: chosen)
        after = [r.text for r in P.pii(docs, "k").orderBy("doc_id").collect()]
        assert after[1] == before[1] and after[0] != before[0]
        assert re.sub(r"\+1[^;.,]*", "", after[0]) == re.sub(r"\+1[^;.,]*", "", before[0])


def test_native(spark):
    plan = P.pii(frame(spark, TEXTS), "a key that no plan shows")._jdf.queryExecution()
    blocks = [bytes(b ^ pad for b in b"a key that no plan shows".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]
    assert not re.search("Python|Pandas|Arrow", plan.toString())
    assert not any(x[:32].lower() in plan.toString().lower() for x in ("a key that no plan shows", *blocks))


def test_every_column_of_the_caller_stays(spark):
    rows = [(1, TEXTS[0], [1], {"a": 1}, 7, "d", 9, b"k"), (2, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found array<int>, attempts map<string,int>, n_email int, digest string, kinds int, hmac_key binary")
    got = P.surrogates(docs, "k").orderBy("doc_id").collect()
    assert got[0].asDict().keys() == set(docs.columns) and tuple(got[0])[2:] == rows[0][2:] and tuple(got[1]) == rows[1]
    assert got[0].text == replaced(spark, TEXTS[:1])[0] != TEXTS[0]


def test_hmac(spark):
    """The digits that decide a surrogate are Python's HMAC."""
    long = "x" * 100
    for key in ("k", long):
        row = spark.range(1).withColumn(P.HMAC, P.key_column(spark, key)).selectExpr("'email' kind", "'a@b.example' entity", "'3' attempt", P.HMAC).selectExpr(f"{P._stream('kind', 'entity', 'attempt')} v").first()
        assert row.v == "".join(hmac.new(key.encode(), f"email|3|{b}|a@b.example".encode(), "sha256").hexdigest() for b in (0, 1))


def test_very_long_text(spark):
    text = "filler words " * 20_000 + TEXTS[0] + " more filler" * 20_000
    out = replaced(spark, [text, TEXTS[0]])
    assert out[0] == "filler words " * 20_000 + out[1] + " more filler" * 20_000
