import re

import pytest
from pyspark.sql import functions as F

from caseloom.llm import private

KEY = "of these tests"

TEXTS = {
    1: "Write to Jane.Doe@Mail.example.com or jane.doe@mail.example.com, card 4952 9359 0025 3052.",
    2: "Card 4952935900253052 again; phone +1 (017) 555-7713, host 169.122.221.182 and 240.56.125.154!",
    3: "Mrs Nowak met Mr John Nowak. Mr. Nowak called (212) 555-0101. SSN 123-45-6789.",
    4: "nothing here, version 2.0.1 of 2024, hash 9233A8ECF7C5B09FE5949719B6B82BC439E9329B",
    5: None,
    6: "",
    7: "Госпожа Иванова и Господин Иван Петров; IBAN DE89 3704 0044 0532 0130 00",
}


@pytest.fixture(scope="module")
def out(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in TEXTS.items()] + [(None, TEXTS[1], "y"), (1, TEXTS[1], "x")], "doc_id long, text string, entity string")
    return [tuple(r) for r in private.replace(docs, KEY, "n").collect()]


def text(out, k):
    return next(r[1] for r in out if r[0] == k)


def test_nothing_private_is_left_and_the_rest_stays(out):
    everything = " ".join(r[1] or "" for r in out)
    for secret in ("Doe", "doe", "4952935900253052", "4952 9359", "555-7713", "169.122", "240.56", "Nowak", "555-0101", "123-45-6789", "Иванова", "Петров", "3704 0044"):
        assert secret not in everything
    assert text(out, 4) == TEXTS[4] and text(out, 5) is None and text(out, 6) == ""
    assert text(out, 1).startswith("Write to ") and ", card " in text(out, 1)
    assert {r[3] for r in out if r[0] == 4} == {0} and len(out) == 9


def test_form_and_coreference(out):
    one, two, three, seven = (text(out, k) for k in (1, 2, 3, 7))
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})\.", one)[1]
    assert re.search(r"Card (\d{16}) ", two)[1] == card.replace(" ", "")
    mails = re.findall(r"\S+@\S+\.com", one)
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower()
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", two)
    assert len(set(ips)) == 2 and all(0 <= int(o) <= 255 for ip in ips for o in ip.split("."))
    assert re.search(r"phone \+\d \(\d{3}\) \d{3}-\d{4},", two)
    names = re.fullmatch(r"Mrs (\w+) met Mr (\w+) (\w+)\. Mr\. (\w+) called \(\d{3}\) \d{3}-\d{4}\. SSN \d{3}-\d{2}-\d{4}\.", three)
    assert names and names[1] == names[3] == names[4] and names[2] in private.GIVEN["m"]
    given, surname = re.search(r"Господин (\w+) (\w+);", seven).groups()
    assert given in private.GIVEN["cm"] and re.fullmatch("[А-Яа-яё]+", surname)
    assert re.search(r"IBAN [A-Z]{2}\d{2} \d{4} \d{4} \d{4} \d{4} \d{2}$", seven)
    assert sorted({r[1] for r in out if r[0] in (None, 1)}) == [one]


def test_distinct_entities_stay_distinct(spark):
    docs = spark.createDataFrame([(i, f"call 555-000-{i:04d} or Mr Abc{chr(97 + i % 26)}{chr(97 + i // 26)} Smith") for i in range(600)], "doc_id long, text string")
    rows = private.replace(docs, KEY, "n").collect()
    phones = {re.search(r"\d{3}-\d{3}-\d{4}", r.text)[0] for r in rows}
    names = {re.search(r"Mr (\S+) ", r.text)[1] for r in rows}
    assert len(phones) == 600 and len(names) == 600
    assert not phones & {f"555-000-{i:04d}" for i in range(600)}


def test_edge_cases(nasty, nothing):
    out = private.replace(nasty, KEY, "entities")
    assert out.drop("entities").columns == nasty.columns and out.count() == 11
    texts = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    assert texts(out) == texts(nasty)
    odd = nasty.select("doc_id", "text", *(F.lit(1).alias(c) for c in ("of", "whole", "woven", "changed", "cut", "new", "units")))
    assert private.replace(odd, KEY).columns == odd.columns and texts(private.replace(odd, KEY)) == texts(nasty)
    assert private.replace(nothing, KEY).count() == 0


def test_no_python_in_the_plan(nasty):
    plan = private.replace(nasty, KEY, "n")._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "ArrowEval"))


def test_real_rows(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.01/documents.parquet").select("doc_id", "text")
    new = {r.doc_id: r.text for r in private.replace(docs, KEY, "n").collect()}
    forms = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\+\d[\d ().-]{6,}\d|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{13,19}\b")
    for r in docs.collect():
        assert forms.split(r.text) == forms.split(new[r.doc_id])
        assert not set(forms.findall(r.text)) & set(forms.findall(new[r.doc_id]))
    assert docs.where(F.col("text").contains("@")).count() > 0


def test_numbers_beside_each_other_stay_their_own(spark):
    phones, card = ("+1 (826) 555-4081", "+44 20 7946 0958"), "7536784127813050"
    spaced = "7536 7841 2781 3050"
    tails = [" 190.137.223.204", " 2024"]
    texts = [*phones, *(p + tails[0] for p in phones), phones[0] + tails[1], "+49 30 1234 5678", "+49 30 1234 5678 2024", card, card + " 12", "12 " + card, spaced, spaced + " 12", "12 " + spaced, spaced.replace(" ", "-") + " 12"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = {texts[r.doc_id]: r.text for r in private.replace(docs, KEY, "n").collect()}
    for p in phones:
        both = new[p + tails[0]]
        assert new[p] != p and both.startswith(new[p] + " ")
        assert re.fullmatch(r"\d+(\.\d+){3}", both.removeprefix(new[p] + " ")) and not set(tails[0].split(".")[1:]) <= set(both.split("."))
    assert new[phones[0] + " 2024"] == new[phones[0]] + " 2024"
    assert new["+49 30 1234 5678 2024"] == new["+49 30 1234 5678"] + " 2024"
    assert new[card] != card and new[card + " 12"] == new[card] + " 12" and new["12 " + card] == "12 " + new[card]
    assert new[spaced].replace(" ", "") == new[card] and new[spaced + " 12"] == new[spaced] + " 12" and new["12 " + spaced] == "12 " + new[spaced]
    assert new[spaced.replace(" ", "-") + " 12"] == new[spaced].replace(" ", "-") + " 12"


def one(spark, text, key=KEY):
    return private.replace(spark.createDataFrame([(1, text)], "doc_id long, text string"), key).first().text


def test_names_are_carried_on_in_their_text(spark):
    text = "Ms Anna Smith wrote. Then Smith, said Anna Smith, left; Smithson and Annabel stayed. Mr Smith came."
    new = one(spark, text)
    m = re.fullmatch(r"Ms (\w+) (\w+) wrote\. Then (\w+), said (\w+) (\w+), left; Smithson and Annabel stayed\. Mr (\w+) came\.", new)
    assert m and m[1] == m[4] and m[2] == m[3] == m[5] == m[6] and "Smith" not in {m[2], m[6]} and m[1] != "Anna"
    assert one(spark, "Smith and Anna have no form of address here") == "Smith and Anna have no form of address here"


def test_other_forms(spark):
    text = "call 555 123 4567 or 030 1234567, host 2001:db8:0:1:2:3:4:5 or fe80::1ff:fe23, std::vector at 12:30:45"
    new = one(spark, text)
    assert re.fullmatch(r"call \d{3} \d{3} \d{4} or \d{3} \d{7}, host [0-9a-f]+(:[0-9a-f]+){7} or [0-9a-f]{4}::[0-9a-f]{3}:[0-9a-f]{4}, std::vector at 12:30:45", new)
    assert not {"555 123 4567", "1234567", "2001:db8", "fe80"} & {w for w in ("555 123 4567", "1234567", "2001:db8", "fe80") if w in new}


def luhn_ok(n):
    d = [int(c) for c in n[::-1]]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def test_check_digits_and_key(spark):
    cards = ["4539578763621486", "4716461583322103", "378282246310005", "4539578763621487"]
    ibans = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606"]
    new = one(spark, " ; ".join(cards + ibans)).split(" ; ")
    assert [luhn_ok(c) for c in new[:3]] == [True] * 3 and all(a != b and a[0] == b[0] and len(a) == len(b) for a, b in zip(cards, new, strict=False))
    for old, iban in zip(ibans, new[4:], strict=True):
        assert iban[:2] == old[:2] and iban != old and len(iban) == len(old)
        assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert one(spark, cards[0]) == one(spark, cards[0]) != one(spark, cards[0], "another key")


@pytest.mark.parametrize("unit", ["abcdefghij0123456789", "a.b-", "1 2 3 4 ", "ab@", "+12 ", "Mr Ab ", "字符", "a1:b2:", "(123) "])
def test_time_grows_with_the_text(spark, unit):
    import time

    text = unit * (1_000_000 // len(unit))
    df = spark.createDataFrame([(1, "warm 555-000-1234")], "doc_id long, text string")
    private.found_in(df).count()
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    private.found_in(df).count()
    assert time.perf_counter() - began < 10


def test_markers_in_the_text_are_text(spark):
    text = "\x1e a \x1e\x1e 555-000-1234 \x1f $0 \\E"
    new = one(spark, text)
    assert re.fullmatch("\x1e a \x1e\x1e \\d{3}-\\d{3}-\\d{4} \x1f \\$0 \\\\E", new) and new != text


def by_hand(texts):
    """Where entities without names stand, with the operator's shapes written for Python."""
    edge, past = r"(?<![^\W_])", r"(?![^\W_])"
    shapes = [edge + r"[^\W_](?:[^\W_]|[._%+-]){0,63}@(?:(?:[^\W_]|-){1,63}\.){1,8}[^\W\d_]{2,63}", edge + r"(?<![.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?[^\W_])", edge + r"\d{13,19}" + past, r"\+1 \(\d{3}\) \d{3}-\d{4}" + past]
    return [[m.span() for m in re.finditer("|".join(shapes), t or "")] for t in texts]


def test_spans_against_brute_force_on_real_rows(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    new = {r.doc_id: r.n for r in private.replace(spark.createDataFrame(docs), KEY, "n").collect()}
    assert {r.doc_id: len(s) for r, s in zip(docs, by_hand([r.text for r in docs]), strict=True)} == new
    assert sum(new.values()) > 10
