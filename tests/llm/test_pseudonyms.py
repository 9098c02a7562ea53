import itertools
import random
import re

from gradeloom.llm import pseudonyms as ps
from helpers import awkward, table

MADE = ps.Pseudonyms(b"k")


def test_permutations_are_one_to_one_without_fixed_points():
    for n in (2, 3, 10, 97, 1000):
        image = [MADE.permute("t", n, x) for x in range(n)]
        assert sorted(image) == list(range(n)) and all(a != b for a, b in enumerate(image))
        assert all(MADE.permute("t", n, y, back=True) == x for x, y in enumerate(image))
    assert [ps.Pseudonyms(b"a").permute("t", 10**9, 5), ps.Pseudonyms(b"b").permute("t", 10**9, 5)] != [MADE.permute("t", 10**9, 5)] * 2


def test_formats_stay_valid_and_turn_back():
    rng = random.Random(4)
    values = {
        "card": ["4068516892505468", "4111 1111 1111 1111", "378282246310005"],
        "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
        "ssn": ["123-45-6789", "667-01-0001", "899-99-9999"],
        "phone": ["+1 (555) 555-5657", "+49 30 1234567", "(212) 555-0100"],
        "ip": ["132.201.103.247", "0.0.0.1"],
        "email": ["leelle.99@mail9.example.com", "a@b.de", "é.1@x.org"],
        "date": ["2021-02-28", "31/12/1999", "02.03.2004", "12-25-2020", "29/02/2004"],
        "secret": ["f95017526fc608ad71587f8ea5418b66ff2e6d38", "A" * 31 + "1"],
    }
    tests = {"card": ps.is_card, "iban": ps.is_iban, "ssn": ps.is_ssn, "phone": ps.is_phone, "ip": ps.is_ip, "date": lambda x: ps.read_date(x) is not None, "secret": ps.is_secret, "email": lambda x: "@" in x}
    for kind, texts in values.items():
        for text in texts:
            new = getattr(MADE, kind)(text)
            assert new != text and tests[kind](new), (kind, text, new)
            assert getattr(MADE, kind)(new, True) == text, (kind, text, new)
            if kind != "ip":
                assert re.sub(r"[0-9a-zA-Z]", "x", new) == re.sub(r"[0-9a-zA-Z]", "x", text) or kind == "email"
            around = f"{rng.choice(['(', ' ', '*** '])}{text}{rng.choice([' ', '%%%', '.'])} end"
            masked, found = ps.mask_text(around, MADE)
            assert [k for _, _, k in found] == [kind] and text not in masked and masked.endswith(" end")


def test_look_alikes_stay():
    for text in ["9739312764672899", "1.2.3.999", "1.2.3.4.5", "2021-13-45", "000-12-3456", "version 4.0", "x@y", "@home", "deadbeefdeadbeefdeadbeefdeadbeef", "12345", "DE00370400440532013000"]:
        assert ps.mask_text(f"see {text} here", MADE) == (f"see {text} here", [])


def test_values_next_to_each_other():
    text = "call +1 (826) 555-4081 190.137.223.204 or 4068516892505468 12 times, DE89370400440532013000 ABCD, +49 30 1234567 4068 5168 9250 5468 a@b.org"
    masked, found = ps.mask_text(text, MADE)
    assert [k for _, _, k in found] == ["phone", "ip", "card", "iban", "phone", "card", "email"]
    for value in ("+1 (826) 555-4081", "190.137.223.204", "4068516892505468", "DE89370400440532013000", "1234567", "4068 5168 9250 5468", "a@b.org"):
        assert value in text and value not in masked
    assert " 12 times" in masked and " ABCD," in masked


def test_dates_are_one_to_one():
    days = [f"{d:02d}/{m:02d}/{y}" for y, m, d in itertools.product((1999, 2000), range(1, 13), range(1, 29))]
    assert len({MADE.date(x) for x in days}) == len(days)


def test_table(spark):
    rows = awkward() + [(800, "mail a.b@mail.example.org or 4111111111111111", "en", "s", 1, True, 3, "q"), (801, "4111111111111111", "en", "s", 1, True, 3, "q")]
    docs = table(spark, rows)
    out = ps.mask_documents(docs, key=b"k")
    assert out.columns == docs.columns and out.count() == len(rows)
    got = {r.doc_id: r for r in out.collect()}
    card = MADE.card("4111111111111111")
    assert got[801].text == card and got[800].text.endswith(card) and got[800]["size"] == 3
    assert sum(r.text is None for r in out.collect()) == 2
    assert ps.mask_documents(table(spark, []), b"k").count() == 0


def test_short_and_named_dates_blank_phones_and_later_groups():
    for kind, text in [("date", x) for x in ("3/7/2021", "03/07/21", "31/12/99", "12/31/99", "3.7.2021", "7 March 2021", "March 7, 2021", "7th Mar 2021", "MAY 17, 1999", "29 February 2004", "03-07-21", "9 Sept. 2020")] + [("phone", "555 123 4567")]:
        new = getattr(MADE, kind)(text)
        assert new != text and getattr(MADE, kind)(new, True) == text, (text, new)
        masked, found = ps.mask_text(f"on {text} here", MADE)
        assert [k for _, _, k in found] == [kind] and masked == f"on {new} here"
        assert [k for _, _, k in ps.find_personal(new)] == [kind], new
    masked, found = ps.mask_text("ref 0000 4111 1111 1111 1111 end", MADE)
    assert [k for _, _, k in found] == ["card"] and masked.startswith("ref 0000 4") and "4111 1111" not in masked
    for text in ("31/31/21", "30 February 2020", "7 Smarch 2021", "1.2.34", "1/2/2021/4", "155 123 4567", "march 2021"):
        assert ps.find_personal(f"see {text} here") == [], text


def test_short_dates_are_one_to_one():
    days = [f"{d}/{m}/{y}" for y in range(1990, 2010) for m in range(1, 10) for d in range(1, 29)]
    named = [f"{d} {m} {y}" for y in (1999, 2000) for m in ("Jan", "Mar", "March", "May", "Sept", "Sep") for d in range(1, 29)]
    assert len({MADE.date(x) for x in days + named}) == len(days + named)
    assert all(MADE.date(MADE.date(x), True) == x for x in named)


def test_addresses_of_any_script():
    for text in ("иван@mail.ru", "李雷@example.com", "x@пример.рф", "a" * 200 + "@foo.example.com", "ῥ@x.gr", "o'neil.b+tag@sub.example.co", "५@x.in"):
        masked, found = ps.mask_text(f"to {text} now", MADE)
        assert len(found) == 1 and found[0][2] == "email", text
        new = masked[3:-4]
        assert new != text and all(a != b for a, b in [(new.split("@")[0], text.split("@")[0])]), (text, new)
        assert MADE.email(new[len(new) - (found[0][1] - found[0][0]):], True) == text[len(text) - (found[0][1] - found[0][0]):]
    masked, found = ps.mask_text("请联系li@example.com", MADE)
    assert masked.startswith("请联系") and "li@" not in masked
    assert ps.find_personal("++@example.com") == []


def test_a_day_has_one_pseudonym_in_every_format():
    rng = random.Random(9)
    import datetime

    names = "January February March April May June July August September October November December".split()
    for _ in range(300):
        d = datetime.date.fromordinal(rng.randrange(datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()))
        forms = [f"{d:%Y-%m-%d}", f"{d:%d/%m/%Y}", f"{d.day}/{d.month}/{d.year}", f"{d.day} {names[d.month - 1]} {d.year}", f"{names[d.month - 1][:3]} {d.day}, {d.year}"]
        if d.day > 12:
            forms.append(f"{d:%m-%d-%Y}")
        if d.year >= 2000:
            forms.append(f"{d:%d.%m.%y}")
        new = [ps.read_date(MADE.date(x))[0] for x in forms]
        assert len(set(new)) == 1 and new[0] != d, (forms, new)
        assert all(MADE.date(MADE.date(x), True) == x for x in forms)


def test_country_lengths():
    body = next(f"ZZ{i:02d}40440532013000123" for i in range(98) if ps.iban_remainder(f"ZZ{i:02d}40440532013000123") == 1)
    assert len(body) == 21 and ps.find_personal(f"see {body} here") == []


def plain_values(rng):
    """Values made here, by rules of this test's own."""
    digits = lambda n: [rng.randrange(10) for _ in range(n)]
    card = [4, *digits(14)]
    total = sum(sum(divmod(2 * x, 10)) if i % 2 == 0 else x for i, x in enumerate(card))
    card = "".join(map(str, [*card, -total % 10]))
    account = "".join(map(str, digits(18)))
    check = 98 - int(account + "131400") % 97
    yield card
    yield f"DE{check:02d}{account}"
    yield f"{rng.randrange(1, 600):03d}-{rng.randrange(1, 99):02d}-{rng.randrange(1, 9999):04d}"
    yield f"+1 ({rng.randrange(201, 999)}) 555-{rng.randrange(10000):04d}"
    yield ".".join(str(rng.randrange(256)) for _ in range(4))
    yield f"{rng.choice(['ann', 'bob', 'zoé', 'олег'])}{rng.randrange(100)}@{rng.choice(['mail', 'post'])}.example.org"
    yield f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"
    yield "a1" + "".join(rng.choice("0123456789abcdef") for _ in range(38))


def test_no_planted_value_stays_and_all_else_does(spark):
    rng = random.Random(12)
    rows, planted = [], {}
    for i in range(60):
        parts, own = [], []
        for v in plain_values(rng):
            parts += [prose_words(rng), v]
            own.append(v)
        rows.append((i, " ; ".join([*parts, "end"]), "en", "s", 0, None, None, None))
        planted[i] = own
    for r in ps.mask_documents(table(spark, rows), b"k").collect():
        old = next(x[1] for x in rows if x[0] == r.doc_id).split(" ; ")
        new = r.text.split(" ; ")
        assert len(old) == len(new)
        for a, b in zip(old, new):
            assert (a != b) == (a in planted[r.doc_id]), (a, b)


def prose_words(rng):
    return " ".join(f"word{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(1, 9)))


def test_time_is_in_proportion():
    import time

    text = "id 4068516892505468 and a.b@mail.example.org " * 300
    start = time.perf_counter()
    ps.mask_text(text, MADE)
    one = time.perf_counter() - start
    start = time.perf_counter()
    ps.mask_text(text * 10, MADE)
    ps.find_personal("a" * 300_000 + " " + "@" * 100_000)
    assert time.perf_counter() - start < 40 * one + 2
