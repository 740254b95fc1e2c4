"""The state of staged work per brand: a durable manifest that runs advance by compare-and-set.

A brand's state is a line of numbered JSON files in its folder, of which the highest whole one counts.  A run writes
number n + 1 after it has read number n, by creating a file that must not exist: of two runs one fails, reads again
and finds the other's state.  A file that a lost run left without its content is passed over.  A stage reads what the
stage before it wrote, and its own rows are a table under a new name, which the state names only once it is whole: a
run that is lost anywhere is resumed from the last state, and its unnamed table is never read.

A claim is a state like any other, with an owner and a time until which no other run takes the brand.

The driver holds one state at a time; what it chooses from is a small table, a row for each brand.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The statuses in the order of the work, and those that end it.
STATUSES = ("discovered", "coarse_done", "refined_done", "deepseek_done", "second_pass_done", "awaiting_codex_review", "awaiting_codex_validate", "codex_validate_done", "dry_import_done", "live_import_done")
TERMINAL = ("dry_import_done", "live_import_done", "rejected", "blocked", "done")

STATE = "brand string, make string, status string, supported_rows long, version long, output string, owner string, until double"

Stage = Callable[[SparkSession, dict, DataFrame], "DataFrame | str | None"]


def brand_key(make: str) -> str:
    return re.sub("^_+|_+$", "", re.sub("[^a-z0-9]+", "_", re.sub(r"\s+", " ", make or "").strip().lower()))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _read(spark: SparkSession, root: str, brand: str) -> tuple[dict | None, int]:
    """(the state that counts, the highest number taken)."""
    folder, fs = _fs(spark, f"{root}/{brand}/states")
    names = sorted((f.getPath().getName() for f in fs.listStatus(folder)), reverse=True) if fs.exists(folder) else []
    names = [n for n in names if re.fullmatch(r"\d{9}\.json", n)]
    for name in names:
        stream = fs.open(_fs(spark, f"{root}/{brand}/states/{name}")[0])
        try:
            return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))), int(names[0][:9])
        except ValueError:
            continue  # left by a run that was lost while it wrote
        finally:
            stream.close()
    return None, int(names[0][:9]) if names else 0


def commit(spark: SparkSession, root: str, state: dict, taken: int) -> bool:
    """Make `state` current if nobody has written since number `taken` was the highest."""
    path, fs = _fs(spark, f"{root}/{state['brand']}/states/{taken + 1:09d}.json")
    try:
        out = fs.create(path, False)
    except Exception as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    out.write(bytearray(json.dumps(state | {"version": taken + 1}).encode()))
    out.close()
    return True


def discover(spark: SparkSession, root: str, brands: DataFrame) -> None:
    """A first state for each of `brands` (make, supported_rows) that has none; a row for each brand."""
    for r in brands.select("make", "supported_rows").toLocalIterator():
        brand = brand_key(r["make"])
        if brand and _read(spark, root, brand)[1] == 0:
            commit(spark, root, {"brand": brand, "make": r["make"], "status": "discovered", "supported_rows": r["supported_rows"], "output": None, "owner": None, "until": 0.0}, 0)


def states(spark: SparkSession, root: str) -> DataFrame:
    """The state of every brand."""
    rows = spark.read.schema(STATE).option("mode", "DROPMALFORMED").json(f"{root}/*/states/*.json").where("version is not null")
    latest = Window.partitionBy("brand").orderBy(F.desc("version"))
    return rows.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")


def order(status: Column, rows: Column, make: Column) -> list[Column]:
    """What is worked on first: the least advanced, then most rows, then the first by name."""
    place = F.array_position(F.array(*map(F.lit, STATUSES)), status)
    return [F.when(place > 0, place - 1).otherwise(99), F.coalesce(rows, F.lit(0)).desc(), F.regexp_replace(F.trim(make), r"\s+", " ")]


def queue(brands: DataFrame) -> DataFrame:
    """`brands` (make, status, supported_rows) that are not done, in order."""
    return brands.where(~F.col("status").isin(*TERMINAL)).orderBy(*order(F.col("status"), F.col("supported_rows"), F.col("make")))


def claim(spark: SparkSession, root: str, run: str, seconds: float = 3600.0, now: float | None = None) -> dict | None:
    """The next brand that no other run holds, now held by `run`; None if there is none."""
    now = time.time() if now is None else now
    free = states(spark, root).where(F.col("owner").isNull() | (F.col("owner") == run) | (F.col("until") < now))
    for r in queue(free).select("brand").toLocalIterator():
        state, taken = _read(spark, root, r["brand"])
        held = state["owner"] not in (None, run) and state["until"] >= now
        if state["status"] not in TERMINAL and not held and commit(spark, root, state | {"owner": run, "until": now + seconds}, taken):
            return _read(spark, root, r["brand"])[0]
    return None


def advance(spark: SparkSession, root: str, state: dict, stages: dict[str, Stage], rows: Callable[[dict], DataFrame], stop_after: str | None = None) -> dict:
    """Work on a claimed brand from its status on; the last state written.

    `stages` names, for a status, what is done next: it gets the rows of the stage before (at first those of `rows`) and
    returns its own, or the name of a status that ends the work, or None to wait.  The brand is let go at the end, also
    of a stage that fails.
    """
    run, last = state["owner"], state

    def write(**change) -> bool:
        nonlocal last
        now, taken = _read(spark, root, state["brand"])
        if now["owner"] != run or not commit(spark, root, now | change, taken):
            return False  # another run has taken over
        last = now | change | {"version": taken + 1}
        return True

    try:
        while last["status"] in stages and last["status"] not in TERMINAL and last["status"] != stop_after:
            given = spark.read.parquet(last["output"]) if last["output"] else rows(last)
            made = stages[last["status"]](spark, last, given)
            if made is None:
                break
            if isinstance(made, str):
                if not write(status=made):
                    return last
                continue
            output = f"{root}/{last['brand']}/rows-{uuid.uuid4().hex}"
            made.write.parquet(output)
            following = STATUSES[STATUSES.index(last["status"]) + 1]
            if not write(status=following, output=output):
                return last
    finally:
        write(owner=None, until=0.0)
    return last
