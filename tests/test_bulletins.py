"""What bulletins say, on small rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from caseloom.functions import bulletin_text as X
from caseloom.functions import vehicles as V
from caseloom.operators import faults, gates

SUMMARIES = [
    (" Service Action: horn - This bulletin addresses failures of the horn switch, in wagons. Replace the switch if it sticks.", "Horn switch failure.", "Replace the switch.", []),
    ("Drivers may experience rough idle issues. Reprogram the ECM to address it. Code p0300 is stored.", "Rough idle.", "Reprogram ECM.", ["P0300"]),
    ("There could be a leak at the pan. Replace or repair the gasket as needed. ", "Leak at the pan.", "Repair or replace the gasket as needed.", []),
    ("Noise in the dash. Do not replace the unit.", "Noise in the dash.", "", []),
    ("The set of following DTCs U0100, B1000, C2000 seen in the tcm.", "DTCs U0100, B1000, and C2000 detected in the transmission control module.", "", ["U0100", "B1000", "C2000"]),
    (None, "", "", []),
    ("   ", "", "", []),
    ("é - ", "é -", "", []),
]


def test_parts_of_summaries(spark):
    rows = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SUMMARIES)], "id int, summary string")
    part = X.seed_parts(F.col("summary"), gates.either(gates.SYMPTOM), gates.either(gates.ACTION), gates.either(gates.ACTION_FIRST))
    got = {r.id: r.p for r in rows.select("id", part.alias("p")).collect()}
    for i, (_, description, resolution, codes) in enumerate(SUMMARIES[:-1]):
        p = got[i]
        assert (p.description, p.resolution, p.obd_codes) == (description, resolution, codes), p
        assert p.symptoms == ([description] if description else [])
    long = spark.createDataFrame([("A stall may be encountered with heat. " * 3000,)], "summary string")
    assert long.select(part.alias("p")).first().p.description == "Heat."


def test_records_without_anything_are_discarded_or_reviewed(spark):
    rows = [(1, None, None, None, "x"), (2, "Service Bulletin/Repair Instructions", "Ford", None, "x"), (3, "Service Bulletin/Repair Instructions", "Ford", "Cars may experience an engine stall at idle. Replace the pump.", "x")]
    got = {r.id: (r.stage, r.reason, r.reason_before) for r in gates.classified_bulletins(spark.createDataFrame(rows, "id int, kind string, make string, summary string, reason_before string")).collect()}
    assert got[1][:2] == ("discarded", "communication_type") and got[3] == ("ready", "complete", "x")
    assert got[2][:2] == ("to_review", "thin_description")  # the kind itself names a repair
    clash = spark.createDataFrame(rows[2:], "id int, kind string, make string, summary string, description string")
    assert gates.classified_bulletins(clash).first().description == "An engine stall at idle."


@pytest.mark.parametrize(
    ("text", "tag"),
    [("- The window  doesn't, it does not open", "Window won't open"), ("DTC P0301", "DTC P0301"), ("Faulty U0100, u0101 and U0100", "DTCs U0100/U0101"), ("shakes while driving", "shakes"), ("one two three four five", "one two three four"), ("The lamp is inoperative now", "lamp inoperative"), (None, ""), ("  ", "")],
)
def test_symptom_tag(spark, text, tag):
    assert spark.createDataFrame([(text,)], "t string").select(X.symptom_tag(F.col("t")).alias("x")).first().x == tag


def test_tags_of_nothing(spark):
    row = spark.createDataFrame([(None, None)], "s array<string>, d string").select(
        X.symptom_tags(F.col("s"), F.col("d")).alias("a"), X.without_generic(F.col("s"), F.col("d"), F.col("d")).alias("b"), X.beside_codes(F.col("s"), F.col("d"), F.col("d")).alias("c"), X.without_codes(F.col("s"), F.col("s")).alias("e")
    )
    assert tuple(row.first()) == ([], [], [], [])


def test_codes_of_cars_without_lists(spark):
    cars = spark.createDataFrame([(1, "Tesla", None), (2, None, "2.0 TDI SCR"), (3, "Opel", "1.6")], "id int, brand string, engine_power string").withColumn("tags", V.engine_tech(F.col("brand"), F.col("engine_power")))
    lists = spark.createDataFrame([("engine", "diesel", "P2"), ("engine", "diesel", "P1"), ("common", "", "P2"), ("brand", "Peugeot", "P9")], "level string, name string, code string")
    got = {r.id: (r.tags, r.common, r.engine, r.brand_codes) for r in faults.codes_of_cars(cars, lists).collect()}
    assert got == {1: (["electric"], ["P2"], [], []), 2: (["diesel", "adblue"], ["P2"], ["P1"], []), 3: ([], ["P2"], [], ["P9"])}
    none = {r.id: (r.common, r.engine, r.brand_codes) for r in faults.codes_of_cars(cars, lists.limit(0)).collect()}
    assert none == dict.fromkeys((1, 2, 3), ([], [], []))
