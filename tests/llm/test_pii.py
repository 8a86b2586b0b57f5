"""Surrogates: formats, coreference, distinctness, clashes."""

import re

import pytest
from pyspark.sql import functions as F

from floeline.llm import pii

TEXTS = {
    1: "Mail und.34@mail7.example.com or UND.34@MAIL7.EXAMPLE.COM, call +1 (017) 555-7713.",
    2: "Again und.34@mail7.example.com from 97.51.17.173 and 10.0.0.7### and 4.0. version 3.",
    3: "Cards 4111 1111 1111 1111 and 9807915762804490 and 4111111111111111!!",
    4: 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" id 123-45-6789',
    5: "Mr. John Smith met Mrs. Anna Smith and Mr. Smith; Госпожа Анна Иванова too. MR SMITH",
    6: "Nothing here, 12 apples at 3.5 each in 2024. Mr. nobody",
    7: "",
    8: None,
    9: "7536784127813050 4845168114407329 a@b.co b@b.co c@b.co",
}


@pytest.fixture(scope="module")
def out(spark):
    docs = spark.createDataFrame([(d, t, "x") for d, t in TEXTS.items()] + [(1, TEXTS[1], "x")], "doc_id long, text string, _text string")
    rows = pii.with_surrogates(docs, "key").collect()
    assert len(rows) == 10 and all(r["_text"] == "x" for r in rows)
    return {r.doc_id: r.text for r in rows}


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_unchanged(out):
    for d in (6, 7, 8):
        assert out[d] == TEXTS[d]


def test_emails_and_phones(out):
    first = re.search(r"Mail (\S+) or (\S+), call (.*)\.$", out[1])
    assert re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.example\.net", first[1]) and first[1] != "und.34@mail7.example.net"
    assert first[2] == first[1].upper()
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", first[3]) and "555-7713" not in first[3]
    assert f"Again {first[1]} from" in out[2]


def test_addresses(out):
    found = re.fullmatch(r"Again \S+ from (\S+) and (10\.\S+)### and 4\.0\. version 3\.", out[2])
    for address in found.groups():
        assert all(0 < int(x) < 256 for x in address.split("."))
        assert address not in TEXTS[2]


def test_cards(out):
    valid, other, again = re.fullmatch(r"Cards ([\d ]+) and (\d+) and (\d+)!!", out[3]).groups()
    assert luhn(valid) and re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", valid) and valid not in TEXTS[3]
    assert len(other) == 16 and other[0] == "9" and other not in TEXTS[3]
    assert luhn(again) and again[0] == "4"


def test_secrets_and_numbers(out):
    found = re.fullmatch(r'token = "([0-9a-f]{40})" id (\d{3}-\d{2}-\d{4})', out[4])
    assert found and found[1] not in TEXTS[4] and found[2] != "123-45-6789"


def test_names(out):
    found = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+) and Mr\. (\w+); Госпожа (\w+) (\w+) too\. MR SMITH", out[5])
    john, one, anna, two, three, russian, surname = found.groups()
    assert one == two == three != "Smith"
    assert john.endswith("n") and anna.endswith("ra")
    assert re.fullmatch("[А-Яа-я]+", russian + surname) and russian.endswith("ра")


def test_clashes_are_resolved(spark):
    # so few spellings of one letter that surrogates must clash, with each other and with entities
    docs = spark.createDataFrame(
        [(i, f"{chr(97 + i)}@x.co and {i}@x.co and {chr(65 + i)}@X.CO" if i < 10 else f"{chr(97 + i)}@x.co") for i in range(26)],
        "doc_id long, text string",
    )
    rows = pii.with_surrogates(docs, "key").select(F.explode(pii.entities(F.col("text"))).alias("e")).distinct().collect()
    made = {r.e.lower() for r in rows}
    assert len(made) == 36
    rows = {r.doc_id: r.text for r in pii.with_surrogates(docs, "key").collect()}
    for i in range(10):
        small, _, capital = rows[i].split(" and ")
        assert small.upper() == capital


#: One entity of each alternative of ANY, without the signs of another.
ALONE = [
    "a@b.co", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "ghp_abcdefghijklmnopqrst", "1.2.3.4", "4111 1111 1111 1111", "3782 822463 10005",
    "+33 1 23 45 67 89", "+44 20 79 46 09 58", "+49 30 12 34 56 78", "+1(2)34", "(017) 555-7713", "017-555-7713",
    "123-45-6789", "GB12 AB12 CD34 EF56 78", "GB12AB12CD34EF56", "Mr. Smith", "Госпожа\u00a0Анна",
]


def test_an_entity_alone_in_a_text(spark):
    assert pii.ANY == "|".join([pii.EMAIL, pii.SECRET, pii.ADDRESS, pii.CARD, pii.PHONE, pii.NUMBER, pii.ACCOUNT, pii.PERSON])
    docs = spark.createDataFrame(list(enumerate(ALONE)), "doc_id long, text string")
    found = docs.select("text", pii.entities(F.col("text")).alias("e"), F.col("text").rlike(pii.QUICK).alias("quick")).collect()
    assert [r.e for r in found] == [[r.text] for r in found]
    assert [r.text for r in found if not r.quick] == []
    for r in pii.with_surrogates(docs.selectExpr("doc_id", "concat('so ', text, ' it is') as text"), "key").collect():
        assert ALONE[r.doc_id] not in r.text and r.text.startswith("so ") and r.text.endswith(" it is")


def test_no_rows(spark):
    assert pii.with_surrogates(spark.createDataFrame([], "doc_id long, text string"), "key").count() == 0
