"""Gold tables of the column functions."""

import pytest
from pyspark.sql import functions as F

from caseloom.functions import bulletins as B
from caseloom.functions import model as M
from caseloom.functions import scoring as S
from caseloom.functions import text as T
from caseloom.functions import urls as U


def values(spark, inputs, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.out for r in rows.orderBy("i").select(make(F.col("v")).alias("out")).collect()]


MODELS = {
    "Octavia II (2006–2013)": ("octavia", "2", "2006"),
    "Octavia": ("octavia", None, None),
    "Transit MK7 2.2 TDCi (2006–2013)": ("transit", "mk7", "2006"),
    "Mondeo MK III": ("mondeo", "mk3", None),
    "Focus Mark IV": ("focus", "mk4", None),
    "Focus mark5": ("focus", "mk5", None),
    "206 / 206+": ("206", None, None),
    "Almera N16": ("almera", "n16", None),
    "Astra H": ("astra", "h", None),
    "2008": ("2008", None, None),
    "2008 (2013–2019)": ("2008", None, "2013"),
    "Škoda Superb Combi III": ("skoda superb combi", "3", None),
    "Golf FL": ("golf", None, None),
    "Golf 2015": ("golf", None, None),
    "facelift": (None, None, None),
    "C-Max": ("c max", None, None),
    "": (None, None, None),
    None: (None, None, None),
}


def test_model_split(spark):
    got = zip(*(values(spark, MODELS, f) for f in (M.model_family, M.model_generation, M.model_year)), strict=True)
    assert dict(zip(MODELS, got, strict=True)) == MODELS


def test_mileage_bands(spark):
    cases = {None: "unknown", 0: "unknown", -5: "unknown", 1: "0-100", 99_999: "0-100", 100_000: "100-150", 149_999: "100-150", 150_000: "150-200", 185_000: "150-200", 200_000: "200+", 412_000: "200+"}
    assert values(spark, cases, M.mileage_band, "int") == list(cases.values())
    assert values(spark, [None, 5], M.mileage_band_or_all, "int") == ["all", "0-100"]


def test_generation_match(spark):
    rows = [("2", None, "2", None, None, "exact"), ("2", None, "3", None, None, "other"), ("2", None, None, None, None, "unknown"), (None, "2017", None, None, "2017", "exact"), (None, "2017", None, "2017", None, "exact"), (None, "2017", "n16", None, "2016", "other"), (None, None, None, None, None, "unknown"), ("2", "2006", None, None, "2006", "exact")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, c string, d string, e string, want string")
    assert all(r.got == r.want for r in df.select("want", M.generation_match(*(F.col(c) for c in "abcde")).alias("got")).collect())


def test_weights_and_mileage(spark):
    assert values(spark, ["P0300", "p2015", "P1234", "C0001", "", None], S.code_weight) == [2.0, 2.0, 5.0, 5.0, 5.0, 5.0]
    assert values(spark, ["185000 km", " 12", "x", "", None, "-3"], S.leading_int) == [185000, 12, None, None, None, -3]
    at = lambda v: S.mileage_score(F.lit("100000"), v)
    assert values(spark, ["100000", "70000", "69999", "200000", "49999", "0", "km"], at) == [2.0, 2.0, 1.0, 1.0, 0.0, 0.0, 0.0]


def test_sums_keep_the_order_of_additions(spark):
    six = "abcdef " * 6
    q = {"model": F.lit(None).cast("string"), "engine": F.lit(None).cast("string"), "mileage": F.lit(None).cast("string"), "codes": F.array().cast("array<string>"), "symptoms": F.array().cast("array<string>"), "text": F.lit(six)}
    c = q | {"text": F.col("v")}
    assert values(spark, ["abcdef"], lambda v: S.agreement(q, c)) == [0.3 + 0.3 + 0.3 + 0.3 + 0.3 + 0.3]
    assert values(spark, ["abcdef " * 6], lambda v: S.most_score(**c)) == [6 * 0.3]


def test_ratio_gate_and_bonus(spark):
    assert values(spark, [0.0, 5.0, 10.0], lambda v: S.f1(v, F.lit(10.0), F.lit(5.0)), "double") == pytest.approx([0.0, 2 * 0.5 / 1.5, 2 * 1 * 2 / 3])
    assert values(spark, [None, 0, 1, 8, 80], S.confirmation_bonus, "int") == pytest.approx([1, 1, 1, 1.12, 1.12])
    assert values(spark, [0.8, 0.6, 0.1, None], lambda v: S.strength(v, F.lit(6.0)), "double") == ["high", "mid", "partial", "mid"]


def test_bulletin_prose(spark):
    long = "Some 2019 vehicles may show a fault in the steering column " + "and more words " * 8
    assert values(spark, [long, "Some", "x" * 170, "x " * 80 + "this bulletin provides", None], S.bulletin_prose) == [True, False, False, True, False]


def test_clamps(spark):
    text = "First sentence ends here. " * 30
    (got,) = values(spark, [text], T.clamp_for_import)
    assert got.endswith("here....") and len(got) <= 400
    assert values(spark, ["  a  b ", None], T.clamp_for_import) == ["a b", ""]
    (hard,) = values(spark, ["x" * 500], T.clamp_for_import)
    assert hard == "x" * 397 + "..."
    (word,) = values(spark, ["word " * 100], T.clamp_for_import)
    assert word.endswith("word...") and len(word) <= 400
    (seed,) = values(spark, [text], T.clamp_for_seed)
    assert seed.endswith("here.") and len(seed) <= 397


def test_similarity_and_duplicates(spark):
    pair = lambda a, b, s="", t="": {"a": {"thread_url": F.lit(s), "source_ref": F.lit(None).cast("string"), "resolution": F.lit(a)}, "b": {"thread_url": F.lit(t), "source_ref": F.lit(None).cast("string"), "resolution": F.lit(b)}}
    cases = [
        (pair("Replaced the fuel pump!", "replaced THE fuel, pump"), True),
        (pair("replaced the fuel pump relay", "replaced the water pump relay"), False),
        (pair("replaced the fuel pump relay", "replaced the water pump relay", "u", "u"), True),
        (pair("", ""), False),
        (pair("completely different", "words entirely", "u", "u"), False),
    ]
    row = spark.range(1).select(*(T.likely_duplicate(p["a"], p["b"]).alias(f"c{i}") for i, (p, _) in enumerate(cases))).first()
    assert list(row) == [w for _, w in cases]


def test_html(spark):
    page = "<title>Fault &amp; fix | Some forum</title><script>var x='<p>';</script><p>One&nbsp;two</p><div>three<br>four &#352;&#x41;</div>"
    assert values(spark, [page], T.html_to_text) == ["Fault & fix | Some forum One two\n three\nfour ŠA"]
    assert values(spark, [page, "<p>none</p>", None], T.page_title) == ["Fault & fix", "", ""]


def test_posts_and_signals(spark):
    assert values(spark, ["Quote\n  A post that is certainly long enough to be kept  \nshare", "short", None], T.clean_post) == ["A post that is certainly long enough to be kept", "", ""]
    folded = values(spark, ["[Vyřešeno] Octavia, funguje", "Prefixed problem", "SOLVED and fixed"], T.fold_words)
    assert folded == ["vyreseno octavia funguje", "prefixed problem", "solved and fixed"]
    assert values(spark, folded, lambda v: T.resolution_signal(v, F.lit("cs"))) == [2, 0, 2]


def test_buckets(spark):
    reasons = {"Too few posts (2)": "too_few_posts", "Classifier rejected: x": "classifier_reject", "Extractor returned no cases": "extractor_empty", "HTTP 503": "transient", "transient: y": "transient", "": "other", None: "other"}
    assert values(spark, reasons, T.discard_bucket) == list(reasons.values())
    notes = {"failed:same_vehicle because": "same_vehicle", "Pre-gate: short": "pre-gate", "not valid JSON": "parse-fail", None: "other"}
    assert values(spark, notes, T.failing_condition) == list(notes.values())


def test_codes_fuel_vin_time(spark):
    assert values(spark, ["p0300 and P0300, U12AB xP0301 P030", None], T.obd_codes) == [["P0300", "U12AB"], []]
    assert values(spark, ["118 kW – 1.4 TSI", "2.0 TDI", "1.5 dCi", "e-tron 55", "1.4 TSI PHEV", "V8", None], T.fuel_type) == ["petrol", "diesel", "diesel", "electric", "hybrid", None, None]
    assert values(spark, ["WVWZZZ1KZ6W000001", "short", "IOQIOQIOQIOQIOQIO"], T.valid_vin) == [True, False, False]
    times = values(spark, ["1700000000", "1700000000000", "2024-01-02T03:04:05Z", "2024-01-02", "yesterday", "2024-13-45", None], T.post_time)
    assert [t is not None for t in times] == [True, True, True, True, False, False, False] and times[0] == times[1]


def test_resolution_checks(spark):
    cases = {"": "empty", "short": "too_short", "x" * 1001: "too_long", "fix aaaaaaaa it now": "repeated_characters", "the the the the": "too_few_words", "replaced the pump": None}
    assert values(spark, cases, T.valid_resolution) == list(cases.values())


def test_urls(spark):
    cases = {
        "https://f.example.com/viewtopic.php?t=12&sid=abc#p5": "https://f.example.com/viewtopic.php?t=12",
        "https://f.example.com/threads/a.1/page-3": "https://f.example.com/threads/a.1/",
        "https://f.example.com/threads/a.1/latest": "https://f.example.com/threads/a.1/",
        "https://f.example.com/threads/a.1/page-3/post-9": "https://f.example.com/threads/a.1/",
        "https://f.example.com/topic-123-abs&sid=XX": "https://f.example.com/topic-123-abs",
        "https://f.example.com/list?p=4&utm_source=x&b=2&a=1": "https://f.example.com/list?a=1&b=2&p=4",
        "https://f.example.com/viewtopic.php?p=9&t=3": "https://f.example.com/viewtopic.php?t=3",
        "https://F.Example.com:443/x;jsessionid=12?q=a%20b": "https://f.example.com/x?q=a%20b",
        "not a url": "not a url",
        "": "",
    }
    assert values(spark, cases, U.canonical_thread) == list(cases.values())
    assert values(spark, ["https://www.a.example.com/x", "nonsense", None], U.domain) == ["a.example.com", None, None]


def test_bulletin_ids(spark):
    cases = {"TSB_ELE231_R3": "TSB_ELE231", "PIP5964C": "PIP5964", "36551.6.1 / NHTSA 10": "36551", "TJ36551.9.0-2024-08-07": "36551", "21-039-24 REV. H": "21-039-24", "LI09.41-P-078735 / NHTSA 11122233": "LI09.41-P-078735", "AB-1-2024-01-02": "AB-1", None: ""}
    assert values(spark, cases, B.base_bulletin) == list(cases.values())
    assert values(spark, ["X / NHTSA 123", "X", None], B.agency_number) == [123, 0, 0]
    assert values(spark, ["X REV. C", "A_R12_b", "A R3", "", "REVISED"], B.revision_rank) == [3, 12, 3, 0, 0]
    years = values(spark, ["Golf (2004–2008)", "Golf (2019–present)", "Golf"], B.label_years)
    assert [y and tuple(y) for y in years] == [(2004, 2008), (2019, 9999), None]
    assert values(spark, ["Škoda (US)", "Land-Rover/x!"], B.comparable) == ["SKODA", "LAND ROVER X"]


def test_out_of_scope(spark):
    rows = spark.createDataFrame([("BMW", "R1200GS", "", True), ("BMW", "320d", "1598cc", False), ("Honda", "CBR 600", "", True), ("Opel", "Astra K", "1800cc", False), ("Ford", "Tractor 5000", "", True), ("Audi", "R8", None, False)], "b string, m string, e string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", B.out_of_scope(F.col("b"), F.col("m"), F.col("e")).alias("got")).collect())


def test_json_and_quotes(spark):
    assert values(spark, ['so: {"a": 1} done', "none", "} {"], T.salvage_json) == ['{"a": 1}', None, None]
    found = values(spark, [["The pump  was replaced", "never said here", "short"]], lambda v: T.verified_quotes(v, F.lit("We think the PUMP was\nreplaced.")), "array<string>")
    assert found == [["The pump  was replaced"]]
