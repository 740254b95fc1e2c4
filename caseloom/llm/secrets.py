"""Operator 1, secret scans: an incremental blob ledger.

Every version of a text is a *blob*, addressed by the SHA-256 of its bytes.  The ledger is a Parquet
table in a shared folder, of (blob, rules, findings): a blob that this rule version has seen is never
scanned again.  A run

1. addresses every row and keeps one row per blob (partial aggregation first, so thousands of copies
   shuffle once per task) whose (blob, rules) pair the ledger lacks (anti join),
2. scans only those, whole, and appends the outcome to the ledger,
3. joins the ledger's findings back to every path, here every row, that holds the blob.  A table with
   every historical version of a path as a row of its own is covered version by version.

A run that is lost before its append leaves the ledger as it was; two runs at once may append a blob
twice, which readers count once.

Edge cases: a null text is the empty blob; rows with equal texts share one scan and get equal
findings; a null or repeated ``doc_id`` is carried through unchanged, one result row per input row;
an empty table gives an empty result; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import blank, durable

#: The kinds of secret in the order in which spans at one start are listed,
#: the base pattern of each and the least length of what it must hold.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run begins where its first 16 do
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
#: The words of ASSIGN, any of which must be in a text before the slower pattern is tried.
HINT = re.compile(r"[wW][oO][rR][dD]|[wW][dD]|[eE][tT]|[kK][eE][nN]|[kK][eE][yY]")
#: Further kinds that the method adds to the base ones.
EXTRA = {
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    "forge": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
}
RULES = "base-1+extra-1"

FINDINGS = "blob string, rules string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every finding, base kinds and extra ones; whole text, code points."""
    found = []
    # every assignment has ':' or '=' behind its word: without either there is nothing to match
    if ("=" in text or ":" in text) and HINT.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for kind, pattern in EXTRA.items():
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    order = {k: i for i, k in enumerate((*KINDS, *EXTRA))}
    return sorted(found, key=lambda x: (x[0], order[x[2]], x[1]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for blob, text in zip(pdf["blob"], pdf["blob_text"], strict=True):
            spans = find(text)
            base = [s for s in spans if s[2] in KINDS]
            n = [sum(s[2] == kind for s in base) for kind in KINDS]
            rows.append((blob, RULES, *n, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in FINDINGS.split(", ")])


def addressed(docs: DataFrame) -> DataFrame:
    """blob and blob_text of every row."""
    text = blank("text")
    return docs.select(F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("blob_text"))


def ledger_at(spark: SparkSession, path: str) -> DataFrame:
    """The ledger in folder `path`, empty before the first run."""
    try:
        return spark.read.schema(FINDINGS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FINDINGS)


def seen_in(ledger: DataFrame) -> DataFrame:
    """The findings of each blob under the present rules."""
    return ledger.where(F.col("rules") == RULES).dropDuplicates(["blob"])


def scan_unseen(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """New ledger rows: one for each blob of `docs` that `ledger` lacks under the present rules."""
    seen = ledger.where(F.col("rules") == RULES).select("blob")
    # copies go first, in each task by itself, so that a text that very many rows hold is shuffled once per task
    return addressed(docs).dropDuplicates(["blob"]).join(seen, "blob", "left_anti").mapInPandas(_scan, FINDINGS)


def extend(docs: DataFrame, path: str) -> DataFrame:
    """The ledger in folder `path` after a scan of what `docs` has that it lacks."""
    spark = docs.sparkSession
    scan_unseen(docs, ledger_at(spark, path)).write.mode("append").parquet(path)
    return ledger_at(spark, path)


def scan_paths(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, blob and findings of every row of `docs`; the ledger in `path` is read and extended."""
    paths = docs.select("doc_id", F.sha2(blank("text").cast("binary"), 256).alias("blob"))
    # a table of its own: Spark knows its size, and can split a blob that very many paths hold
    return paths.join(durable(seen_in(extend(docs, path))), "blob", "left")


def redact(docs: DataFrame, path: str, marker: str = "[secret]") -> DataFrame:
    """`docs` with every finding's span replaced by `marker`; clean rows stay byte for byte.

    Overlapping spans are merged first.  ``n_chars`` follows the text where that column exists.
    Only rows whose blob has findings go through Python.  The ledger in `path` is read and extended.
    """
    found = seen_in(extend(docs, path)).where(F.col("spans") != "")
    dirty = durable(found.select(F.col("blob").alias("dirty"), "spans"))  # its size tells Spark how to join
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    keyed = docs.select(whole, F.sha2(blank("text").cast("binary"), 256).alias("blob"))
    marked = keyed.join(dirty, F.col("blob") == F.col("dirty"), "left")
    text = F.when(F.col("spans").isNull(), F.col("whole.text")).otherwise(_cut(F.col("whole.text"), F.col("spans"), F.lit(marker)))
    out = marked.withColumn("new", text)
    columns = {c: F.col("whole").getField(c) for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("spans").isNull(), F.col("whole.n_chars")).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType))
    return out.select(*(columns[c].alias(c) for c in docs.columns))


@F.pandas_udf(StringType())
def _cut(text: pd.Series, spans: pd.Series, marker: pd.Series) -> pd.Series:
    def one(t, s, m):
        if not s:
            return t
        out, at = [], 0
        for span in s.split(","):
            _, start, end = span.split(":")
            if int(start) >= at:
                out += [t[at : int(start)], m]
            at = max(at, int(end))
        return "".join([*out, t[at:]])

    return pd.Series([one(*x) for x in zip(text, spans, marker, strict=True)], dtype=object)
