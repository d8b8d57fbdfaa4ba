"""Format-preserving pseudonyms."""

import re
from datetime import date

from listenlake.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def run(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in pii.pseudonymize(docs, **options).orderBy("doc_id").collect()]


TEXTS = [
    "card 4111 1111 1111 1111 and 4111-1111-1111-1111, bare 4111111111111111.", "not a card 4111111111111112",
    "mail Ann.Lee99@mail4.example.com now", "call +1 (609) 555-7932 or 555-123-4567", "at 106.158.249.239. not 300.1.1.1 or 1.2.3.4.5",
    "on 2020-02-29, never 2021-02-29; 31.12.1999 and 12/31/1999", "ssn 123-45-6789 but 666-12-1234 and 000-12-1234",
    "DE89 3704 0044 0532 0130 00 is right, DE88 3704 0044 0532 0130 00 is not", "", None, "é4111111111111111é", "plain words only",
]


def test_valid_values_change_and_stay_valid(spark):
    got = run(spark, TEXTS)
    cards = re.findall(r"[0-9][0-9 -]{11,}[0-9]", got[0].text)
    plain = [re.sub(r"\D", "", c) for c in cards]
    assert got[0].n_card == 3 and len(set(plain)) == 1 and plain[0] != "4" + "1" * 15
    assert luhn(plain[0]) and plain[0][0] == "4" and [len(c) for c in cards] == [19, 19, 16]
    assert got[1].text == TEXTS[1] and got[1].n_card == 0
    assert re.fullmatch(r"mail [A-Z][a-z]{2}\.[A-Z][a-z]{2}\d\d@mail4\.example\.com now", got[2].text) and got[2].text != TEXTS[2]
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}", got[3].text) and got[3].n_phone == 2
    octets = re.match(r"at (\d+)\.(\d+)\.(\d+)\.(\d+)\. not 300\.1\.1\.1 or 1\.2\.3\.4\.5", got[4].text)
    assert octets and all(int(x) < 256 for x in octets.groups()) and got[4].n_ip == 1
    iso, dots, slash = re.match(r"on (\S+), never 2021-02-29; (\S+) and (\S+)", got[5].text).groups()
    date.fromisoformat(iso), date(*map(int, reversed(dots.split("."))))
    month, day, year = map(int, slash.split("/"))
    assert date(year, month, day) == date(*map(int, reversed(dots.split("."))))  # one day, one pseudonym
    assert got[6].n_ssn == 1 and got[6].text.endswith("but 666-12-1234 and 000-12-1234")
    iban = re.match(r"(DE\d\d(?: \d{4}){4} \d\d) is right", got[7].text)[1].replace(" ", "")
    assert int(iban[4:] + "1314" + iban[2:4]) % 97 == 1 and got[7].n_iban == 1 and "DE88 3704" in got[7].text
    assert got[8].text == "" and got[9].text is None and got[9].n_card == 0 and got[11].text == TEXTS[11]
    assert plain[0] in got[10].text  # linked across documents


def test_the_key_undoes_it_and_another_key_differs(spark):
    made = [r.text for r in run(spark, TEXTS)]
    assert [r.text for r in run(spark, made, inverse=True)] == TEXTS
    assert [r.text for r in run(spark, TEXTS, key="other")][0] != made[0]


def test_different_values_stay_different(spark):
    ips = [f"10.0.{i // 250}.{i % 250}" for i in range(300)]
    got = [r.text for r in run(spark, ips)]
    assert len(set(got)) == len(ips)
    dates = [r.text for r in run(spark, [f"{1990 + i}-01-{1 + i % 28:02d}" for i in range(60)])]
    assert len(set(dates)) == 60


def test_clashing_columns_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(1, TEXTS[0], 5)] * 2, "doc_id long, text string, n_card int")
    got = pii.pseudonymize(docs).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].n_card == 3
    assert pii.pseudonymize(docs.limit(0)).count() == 0


def test_an_iban_ends_where_its_country_says(spark):
    ibans = ["ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"]
    behind = [" BIC", " IBAN", " 2024-01-02", " 1234 AB", " 4111 1111 1111 1111", ""]
    texts = [f"pay {x}{y}" for x in ibans for y in behind]
    got = run(spark, texts)
    for row, text in zip(got, texts):
        assert row.n_iban == 1 and row.n_date == text.count("2024-01-02") and row.n_card == text.count("4111 "), text
    assert {r.text[4:4 + len(x)] for r, x in zip(got, [x for x in ibans for _ in behind])}.isdisjoint(ibans)
    assert [r.text for r in run(spark, [r.text for r in got], inverse=True)] == texts


def test_long_domains_and_local_parts_do_not_break_the_pattern(spark):
    """A domain of 5,000 labels once overflowed Java's stack; a 100,000-character local part was quadratic."""
    import time

    from listenlake.llm import pii

    texts = ["a@" + "b." * 5000 + "com tail", "x" * 100_000 + "@example.org", "plain text"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    started = time.time()
    out = {r["doc_id"]: r for r in pii.pseudonymize(df).collect()}
    assert time.time() - started < 120
    assert out[0]["text"].endswith("@" + "b." * 5000 + "com tail") and not out[0]["text"].startswith("a@")
    assert len(out[1]["text"]) == len(texts[1]) and out[1]["text"] != texts[1] and out[1]["text"].endswith("@example.org")
    assert out[2]["text"] == "plain text"
