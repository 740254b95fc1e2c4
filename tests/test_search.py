"""Retrieval against a scorer of plain Python over the same rows."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from caseloom.operators import search
from caseloom.plans import texts


def number(x):
    m = re.match(r"\s*([+-]?\d{1,18})", str(x)) if x is not None else None
    return int(m[1]) if m else None


def weight(code):
    return 2.0 if re.match("P[02]", code.upper()) else 5.0


def words(text):
    return [w for w in re.split(r"\s+", (text or "").lower()) if len(w) > 4]


def most(model, engine, mileage, codes, symptoms, text):
    s = (3.0 if model else 0) + (2.0 if engine else 0) + (2.0 if mileage not in (None, "", "0", 0) else 0)
    return s + sum(map(weight, codes or [])) + 1.5 * len(symptoms or []) + min(0.3 * len(words(text)), 2.0)


def agreement(q, c):
    s = (3.0 if q["model"] and q["model"] == c["vehicle_model"] else 0) + (2.0 if q["engine"] and q["engine"] == c["engine_power"] else 0)
    a, b = number(q["mileage"]), number(c["mileage"])
    if a and b and a > 0 and b > 0:
        near = min(a, b) / max(a, b)
        s += 2.0 if near >= 0.7 else 1.0 if near >= 0.5 else 0
    everything = " ".join([*(c["symptoms"] or []), *(c["obd_codes"] or []), c["description"] or ""]).lower()
    s += sum(weight(x) for x in q["codes"] or [] if x.lower() in everything) + sum(1.5 for x in q["symptoms"] or [] if x.lower() in everything)
    return s + min(2.0, sum(0.3 for w in words(q["text"]) if w in everything))


def canonical(c):
    plain = lambda t: re.sub(r"\s+", " ", t or "").strip().lower()
    codes = ",".join(sorted({re.sub(r"\s+", " ", x).strip().upper() for x in c["obd_codes"] or []} - {""}))
    return (plain(c["source_ref"]), plain(c["vehicle_brand"]), plain(c["vehicle_model"]), codes, plain(c["description"]), plain(c["resolution"]))


def answers(q, cases):
    mine = sorted((c for c in cases if c["status"] == "approved" and q["brand"] and c["vehicle_brand"] == q["brand"]), key=lambda c: (c["closed_at"] is not None, -(c["closed_at"].timestamp() if c["closed_at"] else 0), c["id"]))
    first = re.sub("[%_]", "", (q["model"] or "").split()[0]).lower() if (q["model"] or "").split() else ""
    signals = [(200, lambda c: True), (150, lambda c: set(q["codes"] or []) & set(c["obd_codes"] or [])), (100, lambda c: first and (c["vehicle_model"] or "").lower().startswith(first))]
    met = {}
    for src, (limit, holds) in enumerate(signals):
        for pos, c in enumerate([c for c in mine if holds(c)][:limit], 1):
            met.setdefault(c["id"], (src, pos, c))
    rows = []
    for src, pos, c in met.values():
        score = agreement(q, c)
        asked, held = most(q["model"], q["engine"], q["mileage"], q["codes"], q["symptoms"], q["text"]), most(c["vehicle_model"], c["engine_power"], c["mileage"], c["obd_codes"], c["symptoms"], c["description"])
        ahead, back = (score / asked if asked > 0 else 0), (score / held if held > 0 else 0)
        ratio = 2 * ahead * back / (ahead + back) if ahead + back else 0.0
        plain = re.sub(r"\s+", " ", c["description"] or "").strip()
        prose = lambda t: (len(t) >= 135 and re.match(r"(?i)(?:some|certain|various|affected|these|the following|vehicles listed|for vehicles listed)\b", t)) or (len(t) >= 160 and re.search(r"(?i)\b(?:equipped with|built on|produced from|through|model statement above|this bulletin provides|this service bulletin provides|\d{4}(?:[-–]\d{4}|my))\b", t))
        hidden = "static.nhtsa.gov/odi/tsbs/" in (c["thread_url"] or "") and (prose(plain) or any(prose(re.sub(r"\s+", " ", s).strip()) for s in c["symptoms"] or []))
        if score >= min(LEAST_SCORE, asked * SHARE) and ratio >= LEAST_RATIO and not hidden:
            fault = c["canonical_fault_id"] if c["canonical_fault_id"] not in (None, "", "other") else None
            rows.append([c, score, ratio, src, pos, fault, (c["source_ref"] or "").strip() or c["id"]])
    for r in rows:
        n = len({o[6] for o in rows if o[5] == r[5]}) if r[5] else 1
        r.append(n)
        r.append(r[2] * (1 + (min(max(n, 1), 8) - 1) / 7 * BONUS))
    rows.sort(key=lambda r: (-r[8], -r[1], -r[2], r[3], r[4]))
    taken = []
    for r in rows:
        if len(taken) < 5 and not any(canonical(t[0]) == canonical(r[0]) or (r[5] and t[5] == r[5]) for t in taken):
            taken.append(r)
    strength = lambda x: "high" if x >= 0.72 else "mid" if x >= 0.58 else "partial"
    return [(q["query_id"], k, r[0]["id"], round(r[1], 6), round(r[2], 6), r[7], strength(r[2])) for k, r in enumerate(taken, 1)]


# typed from the rules: what a candidate must reach, and what confirmations add
LEAST_SCORE, SHARE, LEAST_RATIO, BONUS = 8.0, 0.7, 0.5, 0.12


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_answers_equal_plain_python(spark, data, sf):
    d = f"{data}/{sf}"
    cases = [r.asDict(recursive=True) for r in texts._cases(spark, d).collect()]
    questions = [r.asDict(recursive=True) for r in texts._questions(spark).collect()]
    want = [a for q in questions for a in answers(q, cases)]
    got = [tuple(r) for r in texts.search_cases(spark, d).select("query_id", "rank", "id", "score", "ratio", "confirmed", "strength").orderBy("query_id", "rank").collect()]
    assert got == sorted(want) and len(got) > 3


def test_no_more_than_is_asked(spark, data):
    d = f"{data}/sf0.001"
    found = search.search(texts._cases(spark, d), texts._questions(spark), answers=1)
    assert all(r.rank == 1 for r in found.collect())


def test_candidates_of_a_large_brand_equal_their_sql(spark, tmp_path):
    """More cases of one brand, and with one code, than the newest that are kept: another code must not add any."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), (F.col("id") % 2).cast("string")).alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in texts.search_candidates(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(texts.SQL["search_candidates"]).fetchall()) and len(got) > 400
