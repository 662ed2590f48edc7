"""Pseudonyms: a Python form of the network, validity, format, and linkage."""

import random
import re
from datetime import date
from hashlib import sha256

from answerloom.llm import pseudonyms as ps
from conftest import SF

KEY = "k"


def feistel_text(x, tweak):
    a, b = x[:len(x) // 2], x[len(x) // 2:]

    def turn(c, by):
        for low, n, kind in ((48, 10, "[0-9]"), (97, 26, "[a-z]"), (65, 26, "[A-Z]")):
            if re.match(kind, c):
                return chr(low + (ord(c) - low + by) % n)
        return c

    for i in range(1, ps.ROUNDS + 1):
        stream = sha256(f"{KEY}|{tweak}|{i}|{b}".encode()).hexdigest()
        a, b = b, "".join(turn(c, int(stream[j % 16 * 4:j % 16 * 4 + 4], 16)) for j, c in enumerate(a))
    return a + b


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def iban_ok(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def with_check(body):
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def shape(x):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", x)))


def run(spark, texts):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n int, pseudonyms string")
    return sorted(ps.pseudonymise(frame.repartition(4), KEY).collect(), key=lambda r: r.doc_id)


def test_network_equals_its_python_form_and_is_a_permutation(spark):
    rng = random.Random(1)
    values = ["7", "42", "ab.C-9", "é1z"] + ["".join(rng.choices("0123456789abXY._", k=rng.randint(1, 40))) for _ in range(60)]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", ps.feistel_text(ps.F.col("v"), KEY, "t").alias("p")).collect()
    assert all(r.p == feistel_text(r.v, "t") for r in rows)
    three = spark.range(1000).select(ps.feistel_text(ps.F.lpad(ps.F.col("id").cast("string"), 3, "0"), KEY, "t").alias("p"))
    assert {r.p for r in three.collect()} == {f"{i:03d}" for i in range(1000)}
    numbers = spark.range(189 * 77).select(ps.feistel_number(ps.F.col("id"), (189, 77), KEY, "n").alias("p"))
    assert {r.p for r in numbers.collect()} == set(range(189 * 77))


def test_every_kind_keeps_its_format_and_validity(spark):
    card, iban = with_check("453201511283036"), "DE89 3704 0044 0532 0130 00"
    values = {
        "card": [card, f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}", with_check("37828224631000")],
        "iban": [iban, iban.replace(" ", ""), "GB82WEST12345698765432"],
        "date": ["1999-12-31", "31.12.1999", "12/31/1999", "2024/02/29"], "ipv4": ["192.168.0.1", "255.255.255.255"],
        "ssn": ["123-45-6789", "899-99-9999"], "phone": ["+1 (639) 555-6187", "639-555-6187", "(639) 555-6187"],
        "email": ["jo.smith99@mail.example.com"],
    }
    flat = [(k, v) for k, vs in values.items() for v in vs]
    got = run(spark, [f"Ünder {v}, end {v}." for _, v in flat])
    new = {}
    for (kind, value), r in zip(flat, got):
        assert [p.kind for p in r.pseudonyms] == [kind, kind], (value, r)
        made = r.pseudonyms[0].pseudonym
        assert r.text == f"Ünder {made}, end {made}." and made != value
        new[value] = made
        if kind != "ipv4":
            assert shape(made) == shape(value)
    digits = lambda x: re.sub(r"\D", "", x)
    assert digits(new[values["card"][0]]) == digits(new[values["card"][1]]) and all(luhn(digits(new[c])) for c in values["card"])
    assert new[iban].replace(" ", "") == new[iban.replace(" ", "")] and all(iban_ok(new[i]) for i in values["iban"])
    y, m, d = new["1999-12-31"].split("-")
    date(int(y), int(m), int(d))
    assert new["31.12.1999"] == f"{d}.{m}.{y}" and new["12/31/1999"] == f"{m}/{d}/{y}"
    assert all(int(o) < 256 for v in values["ipv4"] for o in new[v].split("."))
    assert digits(new["639-555-6187"]) == digits(new["+1 (639) 555-6187"])[1:] and new["639-555-6187"][0] == "6"


def test_invalid_values_and_edge_texts_stay(spark):
    texts = [
        None, "", "nothing", "4532015112830367", "2023-02-30", "300.1.1.1", "1.2.3.4.5", "666-12-3456", "000-12-3456", "DE88 3704 0044 0532 0130 00",
        "(123) 555-1234", "v1.2.3", "1111111111111111", "1700-01-01", "12345678901234567890123",
    ]
    for text, r in zip(texts, run(spark, texts)):
        assert r.text == text and r.pseudonyms == []
    long = "x " * 50_000 + "a@b.example " * 2000
    r = run(spark, [long])[0]
    assert len(r.pseudonyms) == 2000 and len(r.text) == len(long)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ps.pseudonymise(empty, KEY).count() == 0


def test_given_documents_are_found_whole(spark):
    docs = spark.read.parquet(f"{SF[:-5]}0.01/documents.parquet")
    got = {r.doc_id: r for r in ps.pseudonymise(docs, KEY).collect()}
    n = 0
    for r in docs.collect():
        emails = re.findall(r"[\w.]+@mail\d\.example\.com", r.text)
        phones = re.findall(r"\+1 \([2-9]\d\d\) 555-\d{4}", r.text)
        cards = [c for c in re.findall(r"(?<!\w)\d{16}(?!\w)", r.text) if luhn(c)]
        kinds = [p.kind for p in got[r.doc_id].pseudonyms]
        assert [kinds.count(k) for k in ("email", "phone", "card")] == [len(emails), len(phones), len(cards)], r.doc_id
        n += len(kinds)
        if not kinds:
            assert got[r.doc_id].text == r.text
    assert n > 40


def test_phones_of_every_area_and_exchange_are_replaced(spark):
    texts = ["+1 (017) 555-7713", "+1 (117) 555-7713", "+1 (639) 055-7713", "(017) 555-7713", "639-155-7713"]
    for text, r in zip(texts, run(spark, [f"call {t} now" for t in texts])):
        (p,) = r.pseudonyms
        assert p.kind == "phone_other" and r.text == f"call {p.pseudonym} now" and p.pseudonym != text and shape(p.pseudonym) == shape(text)
    docs = spark.read.parquet(f"{SF[:-5]}0.1/documents.parquet").where("text LIKE '%+1 (%'")
    found = {r.doc_id: [p.kind[:5] for p in r.pseudonyms].count("phone") for r in ps.pseudonymise(docs, KEY).collect()}
    want = {r.doc_id: len(re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", r.text)) for r in docs.collect()}
    assert found == want and sum(want.values()) == 159


def test_values_beside_other_digits_and_capitals(spark):
    texts = {
        "4111 1111 1111 1111 12/27": "4111 1111 1111 1111", "order 7 4111 1111 1111 1111": "4111 1111 1111 1111",
        "12 7 4111-1111-1111-1111 9": "4111-1111-1111-1111", "no 5 378282246310005 x": "378282246310005",
        "3782 822463 10005 1 2": "3782 822463 10005", "DE89 3704 0044 0532 0130 00 BIC COBADEFF": "DE89 3704 0044 0532 0130 00",
        "DE89370400440532013000 5 EUR": "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32 AB 12": "GB82 WEST 1234 5698 7654 32",
        "41111 11111 11111 1": "41111 11111 11111 1", "NO93 8601 1117 947 AND DE89 3704 0044 0532 0130 00": "NO93 8601 1117 947",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in ps.pseudonymise(docs, "k").collect():
        before = list(texts)[r.doc_id]
        value = texts[before]
        assert r.pseudonyms and r.pseudonyms[0].kind in ("card", "iban"), before
        assert value not in r.text, before
        # Everything around the value stays.
        low, high = before.index(value), before.index(value) + len(value)
        assert r.text[:low] == before[:low] and len(r.text) == len(before)
        assert r.text[high:] == before[high:] or before.startswith("NO93"), before
        assert not r.text.endswith("0130 00")
