"""Operator 2, best-fit packing by exact-complement hashing.

Texts become ids, each document's ids end with END, and documents longer than a sequence are cut
into whole sequences and a rest.  What is planned is the histogram of piece lengths, never the
pieces: at most `capacity` counts reach the driver, whatever the corpus.  `plan` indexes lengths,
and sums of pairs of lengths; for each length, longest first, it looks up a single, a pair or a
triple of lengths that fills the gap exactly, and uses that combination as often as the counts
allow.  What is left is packed best-fit, longest first, equal sequences being handled together.
A recipe is used up by running out of one of its lengths, so a plan has O(capacity) recipes.

Pieces are then ranked within their length: they are salted, counted per (length, salt), ranked
within that, and offset by the counts before, so a length that a third of all pieces share never
meets in one task.  Pieces that are equal throughout are counted before any shuffle and stand as
chunks of at most CHUNK with their count, each with a salt of its own, until they are ranked, so
that neither do a third of all pieces that are the same.  The rank in a length gives recipe, sequence and offset by a binary search in
the plan, which is broadcast (its size depends on `capacity` alone).

Edge cases: null and empty texts are one END; equal rows are interchangeable; a null or repeated
doc_id is carried through; an empty table gives no pieces; other columns are ignored; texts of any
length are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blank, durable

CAPACITY = 4096
END = 1
SALTS = 256  # at least
SALT_ROWS = 1 << 22  # rows for which there is another
CHUNK = 1 << 12  # equal pieces that stand as one row
VOCABULARY = "word_bpe_49k.json"
#: Characters for which the vocabulary's normalizer is str.lower(), and white space str.split()'s.
UNUSUAL = re.compile("[^\x00-\x1b\x20-įı-ɏ]")
#: Fixed values of the vocabulary: the pieces its pre-tokenizer cuts, its mark of a word's end, and
#: how its special tokens begin.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
END_OF_WORD = "</w>"
SPECIAL = "<|"
LONGEST = 64  # characters of the words that are remembered
REMEMBERED = 1 << 18

Recipe = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many in a sequence), ...), sequences


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def merge_ranks(path: str) -> tuple[dict[bytes, int], list[int]]:
    """(id of each byte string, ids that end a word) of a byte-level vocabulary with word ends.

    In the file a byte stands as a printable character and a word's end as END_OF_WORD, which is
    written as a line feed here: no word has one.
    """
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    ranks, ends = {}, []
    for token, i in vocab.items():
        if token.startswith(SPECIAL):
            continue
        end = token.endswith(END_OF_WORD) and token != END_OF_WORD
        ranks[bytes(byte_of[c] for c in token.removesuffix(END_OF_WORD if end else "")) + b"\n" * end] = i
        ends += [i] * end
    return ranks, ends


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes, the same as the tokenizer's own.

    No token spans white space, so a text's ids are its words' ids in a row; words recur, so their
    ids are remembered.  New words in usual characters are cut as the vocabulary's pre-tokenizer cuts
    them and merged by tiktoken under the same ranks, some ten times faster; words in unusual ones,
    and texts that name a special token, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ranks, ends = merge_ranks(path)
        self.merges = tiktoken.Encoding("words", pat_str=r"[^\n]*\n", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[ends] = True
        self.words: dict[str, bytes] = {}

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of `words`, remembered unless a word is long or too many are."""
        new = {w: self._direct(w) for w in words if UNUSUAL.search(w)}
        usual = [w for w in words if w not in new]
        if usual:
            cut = [PIECE.findall(w) for w in usual]
            ids = np.array(self.merges.encode_ordinary("".join(p + "\n" for pieces in cut for p in pieces)), "<u4")
            stop = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))
            at = stop[np.cumsum([0, *map(len, cut)])].tolist()
            data = ids.tobytes()
            new |= {w: data[4 * a : 4 * b] for w, a, b in zip(usual, at, at[1:], strict=False)}
        if len(self.words) + len(new) > REMEMBERED:
            self.words.clear()
        self.words.update((w, ids) for w, ids in new.items() if len(w) <= LONGEST)
        return new

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            return self._direct(text)
        if UNUSUAL.search(text):
            words = [w for w in self.tokenizer.normalizer.normalize_str(text).split(" ") if w]
        else:
            words = text.lower().split()
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            known = {w: self.words[w] for w in set(words) if w in self.words}
            known |= self._learn({w for w in words if w not in known})
            return b"".join(map(known.__getitem__, words))


_ENCODERS: dict[str, Encoder] = {}


def _pieces(batches: Iterator[pd.DataFrame], path: str, capacity: int, keep: bool) -> Iterator[pd.DataFrame]:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    encoder, end = _ENCODERS[path], np.array([END], "<u4").tobytes()
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
            ids = encoder.encode(text) + end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if keep else None))
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out if keep else out.drop(columns="ids")


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the ids themselves if `keep`."""
    path = path or vocabulary_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank("text").alias("text")).mapInPandas(lambda it: _pieces(it, path, capacity, keep), schema)


class _Sums:
    """Which lengths are left, and a pair of them for each sum, looked up anew when it has run out."""

    def __init__(self, left: np.ndarray):
        self.left = left
        self.pair = np.zeros(len(left), np.int64)  # the longer of a pair with that sum; -1: none is left
        for total in range(2, len(left)):
            self._renew(total)

    def _renew(self, total: int) -> int:
        half = total // 2
        longer = self.left[total - half : total] > 0  # lengths total-half .. total-1
        found = np.flatnonzero(longer & (self.left[half:0:-1] > 0))
        if total % 2 == 0 and found.size and found[0] == 0 and self.left[half] < 2:
            found = found[1:]
        self.pair[total] = total - half + found[-1] if found.size else -1
        return int(self.pair[total])

    def _pair(self, total: int) -> tuple[int, int] | None:
        a = int(self.pair[total])
        if a > 0 and not (self.left[a] and self.left[total - a] and (2 * a != total or self.left[a] > 1)):
            a = self._renew(total)
        return (a, total - a) if a > 0 else None

    def filling(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that are left and sum to `gap`."""
        if self.left[gap]:
            return (gap,)
        if gap > 1 and (two := self._pair(gap)):
            return two
        for a in (np.flatnonzero((self.left[1 : gap - 1] > 0) & (self.pair[gap - 1 : 1 : -1] > 0)) + 1)[::-1].tolist() if gap > 2 else ():
            self.left[a] -= 1
            two = self._pair(gap - a)
            self.left[a] += 1
            if two:
                return (a, *two)
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Recipe]:
    """Recipes that use every piece once; a recipe's lengths stand in a sequence in that order."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    recipes: list[Recipe] = []

    def use(parts: tuple[int, ...]) -> None:
        need = Counter(parts)
        times = int(min(left[x] // k for x, k in need.items()))
        for x, k in need.items():
            left[x] -= k * times
        recipes.append((tuple(sorted(need.items(), reverse=True)), times))

    if left[capacity]:
        use((capacity,))
    sums = _Sums(left)
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            left[length] -= 1
            parts = sums.filling(capacity - length)
            left[length] += 1
            if parts is None:
                break
            use((length, *parts))
    # best fit for the rest; sequences of one content are one group
    groups: dict[int, list[tuple[Counter, int]]] = {}
    has = np.zeros(capacity + 1, bool)

    def put(gap: int, parts: Counter, n: int) -> None:
        groups.setdefault(gap, []).append((parts, n))
        has[gap] = True

    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(has[length:])
            if not fits.size:
                k = capacity // length
                full, rest = divmod(n, k)
                if full:
                    put(capacity - k * length, Counter({length: k}), full)
                if rest:
                    put(capacity - rest * length, Counter({length: rest}), 1)
                break
            gap = length + int(fits[0])
            parts, many = groups[gap].pop()
            taken = min(many, n)
            if many > taken:
                groups[gap].append((parts, many - taken))
            has[gap] = bool(groups[gap])
            put(gap - length, parts + Counter({length: 1}), taken)
            n -= taken
    recipes += [(tuple(sorted(parts.items(), reverse=True)), n) for same in groups.values() for parts, n in same]
    return recipes


def slots(recipes: list[Recipe]) -> np.ndarray:
    """Rows (length, first rank, sequences, first sequence, offset), in order of length and rank."""
    cursor: Counter = Counter()
    rows, first = [], 0
    for parts, times in recipes:
        offset = 0
        for length, k in parts:
            rows.append((length, cursor[length], times, first, offset))
            cursor[length] += times * k
            offset += length * k
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def chunked(cut: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Equal pieces as rows of at most `chunk`: the columns of `cut` with __chunk and __n."""
    same = cut.groupBy(*cut.columns).agg(F.count(F.lit(1)).alias("__all"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__all") - 1, F.lit(chunk).cast("long"))).alias("__chunk")
    return same.select("*", starts).select(*cut.columns, "__chunk", F.least(F.col("__all") - F.col("__chunk"), F.lit(chunk)).alias("__n"))


def placed(cut: DataFrame, capacity: int = CAPACITY, chunk: int = CHUNK) -> DataFrame:
    """`cut` (pieces) with sequence_id and offset."""
    chunks = durable(chunked(cut, chunk))
    salts = max(SALTS, chunks.count() // SALT_ROWS)  # a count of a table just written reads no rows
    salted = chunks.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "__chunk"), F.lit(salts)))
    counts = durable(salted.groupBy("length", "__salt").agg(F.sum("__n").alias("__n")))
    histogram = counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()  # at most `capacity` rows
    table = slots(plan({r["length"]: r["n"] for r in histogram}, capacity))
    model = cut.sparkSession.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32", "__chunk").rowsBetween(Window.unboundedPreceding, -1)
    ranked = salted.withColumn("__rank", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(offsets, ["length", "__salt"])
    first = F.col("__rank") + F.col("__before")
    ranked = ranked.select(*cut.columns, F.explode(F.sequence(first, first + F.col("__n") - 1)).alias("__rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = model.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf["__rank"].to_numpy()
            row = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            turn = rank - row[:, 1]
            pdf = pdf.drop(columns="__rank")
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            pdf["sequence_id"] = row[:, 3] + turn % row[:, 2]
            pdf["offset"] = row[:, 4] + turn // row[:, 2] * length
            yield pdf

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInPandas(place, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep: bool = False) -> DataFrame:
    """One row per piece with its place; with its ids if `keep`."""
    return placed(pieces(docs, path, capacity, keep), capacity)
