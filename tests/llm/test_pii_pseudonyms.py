import datetime
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plinth.llm import pii_pseudonyms as p

KEY = b"k"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutations(size):
    f = p.Permutation(KEY, "t", size)
    images = [f(x) for x in range(size)]
    assert sorted(images) == list(range(size)) and [f.back(y) for y in images] == list(range(size))


@settings(max_examples=200, deadline=None)
@given(st.text("0123456789", min_size=12, max_size=18))
def test_cards_stay_cards(body):
    card = body + p.luhn_digit(body)
    if card.strip("0"):
        new, (found,) = p.replaced(f"pay {card}, now", KEY)
        assert found[0] == "card" and len(found[3]) == len(card) and p.luhn_digit(found[3][:-1]) == found[3][-1]
        assert new == f"pay {found[3]}, now"


def kinds(text):
    return [k for k, *_ in p.replaced(text, KEY)[1]]


def test_kinds_and_validation():
    assert kinds("4111 1111 1111 1111 and 4111111111111111 or 3782-822463-10005") == ["card", "card", "card"]
    assert kinds("4111111111111112 123-45-678 999.1.1.1 2020-13-01 31.02.2020 666-12-3456 1850-01-01 GB82WEST12345698765433") == []
    assert kinds("123-45-6789 GB82 WEST 1234 5698 7654 32 10.0.0.255 +1 (017) 555-7713 2020-02-29 29.02.2020 02/29/2020 29/02/2020 a.b9@mail7.example.com") == ["ssn", "iban", "ip", "phone", "date", "date", "date", "date", "email"]


def test_equal_values_stay_linked_and_formats_stay():
    a = p.replaced("4111 1111 1111 1111", KEY)[0]
    b = p.replaced("x 4111111111111111.", KEY)[0]
    assert a.replace(" ", "") == b[2:-1] != "4111111111111111" and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", a)
    iso, dots = p.replaced("2020-03-04", KEY)[0], p.replaced("04.03.2020", KEY)[0]
    assert iso.split("-") == dots.split(".")[::-1]
    iban = p.replaced("GB82 WEST 1234 5698 7654 32", KEY)[0]
    assert p._mod97((iban[4:] + iban[:4]).replace(" ", "")) == 1 and iban[4:9] == " WEST"
    assert p.replaced("4111111111111111", b"other")[0] != b[2:-1]
    assert re.fullmatch(r"[a-z]\.[a-z]\d@mail7\.example\.com", p.replaced("a.b9@mail7.example.com", KEY)[0])


def test_dates_in_every_spelling_are_permuted():
    """Every day of 1900 to 2099 in every spelling: the images of all spellings of one layout are as many, read in the same way and of the same lengths."""
    days = [p.DAY0 + datetime.timedelta(n) for n in range(p.DAYS)]
    slash = [f"{d.month:02d}/{d.day:02d}/{d.year}" for d in days] + [f"{d.day:02d}/{d.month:02d}/{d.year}" for d in days if d.day > 12]
    short = [f"{d.month}/{d.day}/{d.year}" for d in days if d.month < 10 or d.day < 10] + [f"{d.day}/{d.month}/{d.year}" for d in days if d.day > 12 and d.month < 10]
    dots = [f"{d.day:02d}.{d.month:02d}.{d.year}" for d in days]
    bare = [f"{d.day}.{d.month}.{d.year}" for d in days if d.month < 10 or d.day < 10]
    for texts, f in ((slash, p._mdy), (short, p._mdy), (dots, p._dmy), (bare, p._dmy), ([str(d) for d in days], p._ymd)):
        images = [f(KEY, t) for t in texts]
        assert sorted(images) == sorted(texts)  # onto themselves: none shared, none that another rule would read
        assert all([len(a) for a in re.split(r"[-./]", t)] == [len(b) for b in re.split(r"[-./]", i)] for t, i in zip(texts, images))
    assert [p._mdy(KEY, "05/24/1992").split("/")[n] for n in (1, 0, 2)] == p._mdy(KEY, "24/05/1992").split("/") == p._dmy(KEY, "24.05.1992").split(".")


def test_iban_lengths():
    assert kinds("GB82 WEST 1234 5698 7654 32") == ["iban"]
    for country, size in (("GB", 21), ("DE", 23), ("NO", 16), ("XX", 20)):
        body = "1" * (size - 4)
        made = f"{country}{98 - p._mod97(body + country + '00'):02d}{body}"
        assert kinds(made) == (["iban"] if country == "XX" else [])
    assert len(p.IBAN_LENGTHS) == 79 and all(15 <= n <= 32 for n in p.IBAN_LENGTHS.values())


def test_two_values_side_by_side():
    new, found = p.replaced("4111111111111111 5500005555555559", KEY)
    assert len(found) == 2 and len(new) == 33


def test_phones():
    assert kinds("(000) 000-0000 123-456-7890 (411) 555-0100 (292) 555-0100 (602) 911-0100 602-555") == []
    assert kinds("(602) 555-0100 602.555.0101 +1 602-555-0102 +1 (017) 555-0103") == ["phone"] * 4
    numbers = [f"({area}) {exchange}-{n:04d}" for area in ("602", "907", "312") for exchange in ("200", "999", "555") for n in range(60)]
    images = [p.replaced(n, KEY)[0] for n in numbers]
    assert len(set(images)) == len(numbers) and all(kinds(i) == ["phone"] for i in images)
    others = [p.replaced(f"+1 (017) 555-{n:04d}", KEY)[0] for n in range(100)]
    assert len(set(others)) == 100 and all(kinds(o) == ["phone"] and kinds(o[3:]) == [] for o in others)
    assert p.replaced("602.555.0101", KEY)[0].replace(".", "") == re.sub(r"\D", "", p.replaced("(602) 555-0101", KEY)[0])


def test_versions_are_no_addresses():
    assert kinds("v1.2.3.4 and release-v10.0.0.1") == [] and kinds("at 1.2.3.4, and (10.0.0.1)") == ["ip", "ip"]


def plain_luhn(digits):
    table = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(int(c) if i % 2 else table[int(c)] for i, c in enumerate(digits, len(digits) % 2)) % 10 == 0


def plain_values(text):
    """What the tables' documents hold of personal data, word by word and without the finder's pattern."""
    out, words = [], text.split()
    for i, word in enumerate(words):
        core = re.sub(r"^[^\w]+|[^\w]+$", "", word, flags=re.ASCII)
        if core.isascii() and core.isdigit() and 13 <= len(core) <= 19 and plain_luhn(core):
            out.append(core)
        elif core.count(".") == 3 and all(x.isdigit() and str(int(x)) == x and int(x) < 256 for x in core.split(".")):
            out.append(core)
        elif "@" in core and "." in core.split("@")[1]:
            out.append(core)
        elif word.endswith("+1") and i + 2 < len(words) and re.match(r"\(\d{3}\)$", words[i + 1]):
            out.append(f"+1 {words[i + 1]} {words[i + 2][:8]}")
    return sorted(out)


def test_found_values_against_a_plain_reader(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text is not null").collect()
    n = 0
    for r in rows:
        new, found = p.replaced(r["text"], KEY)
        assert sorted(r["text"][a:b] for _, a, b, _ in found) == plain_values(r["text"]), r["doc_id"]
        assert plain_values(new) == sorted(f[3] for f in found)
        n += len(found)
    assert n > 40


def test_table(spark, docs):
    df = docs((1, "call +1 (602) 555-0100"), (2, "again +1 (602) 555-0100"), (3, None), (4, ""), (5, "word " * 50000 + "10.1.2.3"), (1, "call +1 (602) 555-0100"))
    got = [r.asDict() for r in p.pseudonymize(df, key=KEY).orderBy("doc_id").collect()]
    one, same, two, three, four, five = got
    assert one == same and one["pii"][0]["pseudonym"] == two["pii"][0]["pseudonym"]
    assert (three["text"], three["pii"]) == (None, []) and (four["text"], four["pii"]) == ("", [])
    assert len(five["pii"]) == 1 and "10.1.2.3" not in five["text"]
    assert p.pseudonymize(docs(), KEY).count() == 0 and p.pseudonymize(df.withColumnRenamed("lang", "pii"), KEY).columns.count("pii") == 1
    assert p.pseudonymize(df.withColumnRenamed("lang", "_pii"), KEY).where("_pii = 'en'").count() == 6
    dotted = p.pseudonymize(df.withColumnRenamed("lang", "a.b"), KEY)
    assert "a.b" in dotted.columns and dotted.count() == 6
