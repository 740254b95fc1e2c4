"""Staged work that is lost, resumed and contended for."""

import pytest
from pyspark.sql import functions as F

from caseloom.operators import manifest


def brands(spark):
    return spark.createDataFrame([("Ford Transit ", 50), ("ŠKODA", 90), ("Audi", 90), ("  ", 5)], "make string, supported_rows long")


def rows(spark):
    return lambda state: spark.range(20).withColumn("brand", F.lit(state["brand"]))


def kept(least):
    return lambda spark, state, given: given.where(F.col("id") >= least)


STAGES = {"discovered": kept(5), "coarse_done": kept(8), "refined_done": kept(12)}


def test_order_of_the_ten_statuses(spark):
    table = [(f"m{k}", s, 10) for k, s in enumerate(reversed(manifest.STATUSES))] + [("b", "discovered", 99), ("a", "discovered", 99), ("x", "rejected", 999), ("y", "blocked", 1), ("z", "done", 1), ("w", "unheard of", 7)]
    got = [r.make for r in manifest.queue(spark.createDataFrame(table, "make string, status string, supported_rows long")).collect()]
    assert got == ["a", "b", "m9", "m8", "m7", "m6", "m5", "m4", "m3", "m2", "w"]


def test_lost_between_stages_and_resumed(spark, tmp_path):
    whole, lost = f"{tmp_path}/whole", f"{tmp_path}/lost"
    for root in (whole, lost):
        manifest.discover(spark, root, brands(spark))
        manifest.discover(spark, root, brands(spark))  # once only
    state = manifest.claim(spark, whole, "run")
    assert state["brand"] == "audi" and [r.brand for r in manifest.states(spark, whole).orderBy("brand").collect()] == ["audi", "ford_transit", "koda"]
    done = manifest.advance(spark, whole, state, STAGES, rows(spark))
    assert done["status"] == "deepseek_done"
    want = sorted(r.id for r in spark.read.parquet(done["output"]).collect())
    assert want == list(range(12, 20))

    def dies(spark, state, given):
        given.where("id >= 8").write.parquet(f"{lost}/audi/rows-of-a-lost-run")
        raise RuntimeError("the run is lost")

    state = manifest.claim(spark, lost, "first")
    with pytest.raises(RuntimeError):
        manifest.advance(spark, lost, state, STAGES | {"coarse_done": dies}, rows(spark))
    open(f"{lost}/audi/states/000000009.json", "w").close()  # and another one while it wrote its state
    again = manifest.claim(spark, lost, "second")
    assert (again["brand"], again["status"], again["version"]) == ("koda", "discovered", 2)  # the least advanced first
    spark.createDataFrame([("audi",)], "b string")
    state, taken = manifest._read(spark, lost, "audi")
    assert state["status"] == "coarse_done" and taken == 9 and state["owner"] is None
    assert manifest.commit(spark, lost, state | {"owner": "second", "until": 1e12}, taken)
    done = manifest.advance(spark, lost, manifest._read(spark, lost, "audi")[0], STAGES, rows(spark))
    assert done["status"] == "deepseek_done" and sorted(r.id for r in spark.read.parquet(done["output"]).collect()) == want


def test_two_runs_never_share_a_brand(spark, tmp_path):
    root = f"{tmp_path}/m"
    manifest.discover(spark, root, brands(spark))
    held = [manifest.claim(spark, root, run, 60, now=1000.0) for run in ("a", "b", "c", "d")]
    assert [h and h["brand"] for h in held] == ["audi", "koda", "ford_transit", None]
    assert manifest.claim(spark, root, "b", 60, now=1001.0)["brand"] == "koda"  # its own again
    assert manifest.claim(spark, root, "d", 60, now=2000.0)["brand"] == "audi"  # held too long ago
    assert not manifest.commit(spark, root, held[0], held[0]["version"])  # compared with what is there
    late = manifest.advance(spark, root, held[0], STAGES, rows(spark))  # "a" comes back: its work is not taken
    assert late["status"] == "discovered" and manifest._read(spark, root, "audi")[0]["owner"] == "d"


def test_stages_wait_reject_and_stop(spark, tmp_path):
    root = f"{tmp_path}/m"
    manifest.discover(spark, root, brands(spark))
    one = manifest.advance(spark, root, manifest.claim(spark, root, "r"), STAGES, rows(spark), stop_after="coarse_done")
    assert one["status"] == "coarse_done"
    two = manifest.advance(spark, root, manifest.claim(spark, root, "r"), {"discovered": lambda *_: "rejected"}, rows(spark))
    assert (two["brand"], two["status"]) == ("koda", "rejected")
    three = manifest.advance(spark, root, manifest.claim(spark, root, "r"), {"discovered": lambda *_: None}, rows(spark))
    assert (three["brand"], three["status"], three["owner"]) == ("ford_transit", "discovered", None)
