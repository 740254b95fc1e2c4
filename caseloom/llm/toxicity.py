"""Operator 11, toxicity: Levenshtein automata on a trie of learned terms, weighed by their context.

The lexicon is learned from labelled texts: words, and beginnings of words, that stand in toxic texts far
more often than in others.  Its entries form a trie.  A token becomes a Levenshtein automaton, a bit per
place in the token and a word of bits per number of errors, which is run along the edges of the trie: a
branch ends where no state is left, so that all entries are tried together and misspelled ones are
caught.  Short entries allow no error, longer ones one or two.  Each entry has a weight for each number
of errors, shrunk to its exact form's: variants that clean texts hold as well lose theirs.  Before
the automaton runs, a token must hold a piece of an entry about where the entry has it (of k + 1 pieces
one survives k errors).

Each place found gets a quotation score from the tokens around it: quote marks that enclose it and words
of reporting speak for a quotation, the second person, an exclamation and further terms for abuse.
The labels hold no quotations to learn these from, so their weights are fixed.  A text's evidence is what
is left of its terms' weights; a logistic regression on it gives the score.

Fitted on at most `rows` labelled documents, those of least hash of doc_id, among those whose
crc32(doc_id as text) mod 5 is not 0.  Every document is scored, by its whole text alone.

Edge cases: null and empty texts have no evidence and get the score of such texts; a null doc_id is
neither held out nor trained on; toxic other than 0 and 1 teaches nothing; a doc_id labelled several times is
toxic if one label says so, and of several texts under one doc_id the first in order teaches; without
labels of both kinds the score is the share of toxic ones, 0 if there are none; repeated rows score
alike; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank, durable

ROWS = 8_000
ENTRIES = 1_000
CANDIDATES = 1 << 16
BEGINNINGS = range(3, 10)  # letters
LEAST = 4  # toxic texts with an entry, and tokens that it follows in them
SURE = 18.0  # likelihood ratio statistic of an entry
RATIO = 6.0  # of its rate in toxic texts to that in others
HELD = 1 << 17  # forms, or tokens, remembered by a task
SHORT = 64  # characters of a token that is remembered
SHRINK = 4.0  # texts with a variant at which half its weight is its own
LESS = 0.85  # of the weight for each error, before any variant is seen
DAMPING = 0.05
LONGEST = 1 << 40

#: Marks that are cut from a token's ends, and quotes among them.
MARKS = ".,;:!?…()[]{}<>|*_~#-–—\"'`´«»„“”‘’‚‹›¡¿"
QUOTES = "\"'`´«»„“”‘’‚‹›"
#: Digits and signs in place of letters.
LETTERS = str.maketrans("013457@$!|€", "oieastasile")
#: Words of reporting, and the second person, in four languages.
REPORTING = frozenset("said says say wrote writes called calling quote quoted quotes word words term insult slur sagte sagt schrieb nannte zitat wort begriff dit disait écrit appelé citation mot terme dijo dice escribió llamó cita palabra término".split())
SECOND = frozenset("you you're youre your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta vous votre tú eres usted ustedes vosotros".split())
WINDOW = 6  # tokens on either side
#: The quotation score's log odds.
BASE, ENCLOSED, REPORTED, ADDRESSED, SHOUTED, TOGETHER = -2.0, 2.5, 1.0, -1.0, -0.5, -1.0
QUOTED = 0.8  # of a term's weight is lost in a certain quotation


def errors_allowed(entry: str, beginning: bool) -> int:
    """Two in long words, one in shorter ones and in longer beginnings, none in short ones."""
    n = len(entry)
    return int(n > 5) if beginning else 0 if n < 5 else 1 if n < 8 else 2


class Lexicon:
    """A trie of entries; a trailing * marks the beginning of a word."""

    def __init__(self, entries: list[str]):
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, bool, int]]] = [[]]  # entry, beginning, errors allowed
        self.most = [0]  # errors that some entry below a node allows
        self.longest = 0  # characters of a token that decide: one more than any entry with its errors has
        self.pieces = ahocorasick.Automaton()
        pieces: dict[str, set[tuple[int, int, int, int]]] = defaultdict(set)
        for e, entry in enumerate(entries):
            beginning, bare = entry.endswith("*"), entry.rstrip("*")
            k = errors_allowed(bare, beginning)
            self.longest = max(self.longest, len(bare) + k + 1)
            at = 0
            for c in bare:
                self.most[at] = max(self.most[at], k)
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                at = self.children[at][c]
            self.most[at] = max(self.most[at], k)
            self.ends[at].append((e, beginning, k))
            cuts = [len(bare) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                # where the piece may end, and how long a token may be
                pieces[bare[a:b]].add((b - 1 - k, b - 1 + k, len(bare) - k, LONGEST if beginning else len(bare) + k))
        for piece, where in pieces.items():
            self.pieces.add_word(piece, tuple(where))
        if pieces:
            self.pieces.make_automaton()
        self.known: dict[str, tuple[int, int] | None] = {}

    def _may_match(self, word: str, n: int) -> bool:
        """Whether a piece of an entry stands about where it stands in the entry, in a token of its length."""
        if n and self.entries:
            for end, where in self.pieces.iter(word):
                for first, last, least, most in where:
                    if first <= end <= last and least <= n <= most:
                        return True
        return False

    def nearest(self, word: str) -> tuple[int, int] | None:
        """(errors, entry) of the nearest entry within its own allowance; the first of equally near ones."""
        word = word[: self.longest]
        n = len(word)
        if not self._may_match(word, n):
            return None
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        full, last = (2 << n) - 1, 1 << n
        best = None
        k = self.most[0]
        stack = [(0, tuple((2 << e) - 1 & full for e in range(k + 1)))]  # after e errors, up to e letters are skipped
        while stack:
            node, states = stack.pop()
            for entry, beginning, allowed in self.ends[node]:
                for e in range(min(allowed, len(states) - 1) + 1):
                    if states[e] if beginning else states[e] & last:
                        if best is None or (e, entry) < best:
                            best = (e, entry)
                        break
            for c, child in self.children[node].items():
                same, some = at.get(c, 0), 0
                after = []
                for e in range(min(len(states), self.most[child] + 1)):
                    now = (states[e] & same) << 1
                    if e:
                        now |= states[e - 1] | states[e - 1] << 1 | after[-1] << 1
                    now &= full
                    after.append(now)
                    some |= now
                if some:
                    stack.append((child, tuple(after)))
        return best

    def look(self, token: str) -> tuple[int, int] | None:
        """(errors, entry) for a token of a text: stripped, lower case; signs for letters and drawn-out letters are an error."""
        try:
            return self.known[token]
        except KeyError:
            pass
        word = token.strip(MARKS).lower()
        found = self.nearest(word)
        if (found is None or found[0]) and not (word.isalpha() and not _DRAWN.search(word)):
            plain = _DRAWN.sub(r"\1", token.strip(QUOTES + ".,;:?").lower().translate(LETTERS).strip(MARKS))
            other = self.nearest(plain) if plain != word else None
            if other is not None and (found is None or other[0] + 1 < found[0]):
                found = (min(other[0] + 1, 2), other[1])
        if len(token) <= SHORT and len(self.known) < HELD:
            self.known[token] = found
        return found


_DRAWN = re.compile(r"(.)\1{2,}")


def quotation(tokens: list[str], at: int, terms: set[int]) -> float:
    """How likely the term at place `at` is quoted, from the tokens around it."""
    start, stop = max(0, at - WINDOW), min(len(tokens), at + WINDOW + 1)
    opened = closed = False
    for i in range(at, start - 1, -1):
        if tokens[i][0] in QUOTES:
            opened = True
            break
        if i < at and tokens[i].rstrip(".,;:!?")[-1:] in tuple(QUOTES):
            break
    for i in range(at, stop):
        if tokens[i].rstrip(".,;:!?)")[-1:] in tuple(QUOTES):
            closed = True
            break
        if i > at and tokens[i][0] in QUOTES:
            break
    words = [tokens[i].strip(MARKS).lower() for i in range(start, stop) if i != at]
    odds = BASE + ENCLOSED * (opened and closed)
    odds += REPORTED * min(2, sum(w in REPORTING for w in words))
    odds += ADDRESSED * any(w in SECOND for w in words) + SHOUTED * ("!" in tokens[at])
    odds += TOGETHER * min(2, sum(i in terms for i in range(start, stop) if i != at))
    return float(1 / (1 + np.exp(-odds)))


def found_in(text: str, lexicon: Lexicon) -> tuple[int, dict[tuple[int, int], tuple[int, float]]]:
    """(tokens, (entry, errors) -> (places, sum of what its places keep of their weight))."""
    tokens = text.split()
    known, look = lexicon.known, lexicon.look
    met = {}
    for t in set(tokens):
        got = known[t] if t in known else look(t)
        if got is not None:
            met[t] = got
    out: dict[tuple[int, int], tuple[int, float]] = {}
    if met:
        places = [i for i, t in enumerate(tokens) if t in met]
        terms = set(places)
        for i in places:
            errors, entry = met[tokens[i]]
            n, kept = out.get((entry, errors), (0, 0.0))
            out[entry, errors] = (n + 1, kept + 1 - QUOTED * quotation(tokens, i, terms))
    return len(tokens), out


FEATURES = 5


def evidence(tokens: int, found: dict[tuple[int, int], tuple[int, float]], weights: np.ndarray) -> list[float]:
    """What the regression sees of a text: strongest term, all terms, places, their density, length."""
    strengths = [weights[key] * kept / n for key, (n, kept) in found.items()]
    places = sum(kept for key, (_, kept) in found.items() if weights[key] > 0)
    return [max(strengths, default=0.0), sum(strengths), float(np.log1p(places)), min(5.0, 100 * places / max(tokens, 20)), float(np.log1p(tokens)) / 10]


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, slope: np.ndarray, bias: float):
        self.lexicon, self.weights, self.slope, self.bias = lexicon, weights, slope, bias

    def score(self, text: str) -> tuple[float, int, float]:
        """(score, places of terms, places that read as quoted)."""
        tokens, found = found_in(text, self.lexicon) if len(self.slope) else (0, {})
        odds = self.bias + float(np.dot(self.slope, evidence(tokens, found, self.weights))) if len(self.slope) else self.bias
        n = sum(c for c, _ in found.values())
        return float(1 / (1 + np.exp(-np.clip(odds, -500, 500)))), n, (n - sum(kept for _, kept in found.values())) / QUOTED


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc, toxic and text of at most `rows` labelled documents of the training folds, chosen by hash."""
    marked = labels.where(F.col("toxic").isin(0, 1) & (fold() != 0)).groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), blank("text").alias("text"))
    have = marked.join(texts.select("id").distinct(), F.col("doc") == F.col("id"), "left_semi")
    chosen = have.orderBy(F.xxhash64("doc"), "doc").limit(rows)
    met = texts.join(F.broadcast(chosen), F.col("id") == F.col("doc"))  # `rows` rows of two numbers
    return met.groupBy("doc", "toxic").agg(F.min("text").alias("text"))


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """form, toxic, n: in how many texts each word and each beginning of a word stands."""
    held: tuple[Counter, Counter] = (Counter(), Counter())

    def out(kind: int) -> pd.DataFrame:
        return pd.DataFrame({"form": list(held[kind]), "toxic": kind, "n": list(held[kind].values())})

    for pdf in batches:
        for toxic, text in zip(pdf["toxic"], pdf["text"], strict=True):
            words = {t.strip(MARKS).lower() for t in set(text.split())}
            forms = {w for w in words if len(w) >= BEGINNINGS[0]}
            forms |= {w[:n] + "*" for w in words for n in BEGINNINGS if n < len(w)}
            held[toxic].update(forms)
            if len(held[toxic]) > HELD:
                yield out(toxic)
                held[toxic].clear()
    yield out(0)
    yield out(1)


def _followed(batches: Iterator[pd.DataFrame], places: dict[str, int]) -> Iterator[pd.DataFrame]:
    """place, before: which tokens each form follows."""
    met: set[tuple[int, int]] = set()
    for pdf in batches:
        for text in pdf["text"]:
            before = ""
            for token in text.split():
                word = token.strip(MARKS).lower()
                for form in (word, *(word[:n] + "*" for n in BEGINNINGS if n < len(word))):
                    if form in places:
                        met.add((places[form], zlib.crc32(before.encode("utf-8", "surrogatepass"))))
                before = word
        if len(met) > HELD:
            yield pd.DataFrame(sorted(met), columns=["place", "before"])
            met.clear()
    yield pd.DataFrame(sorted(met), columns=["place", "before"])


def learn(texts: DataFrame) -> list[str]:
    """The entries that tell toxic texts from others, strongest first.

    Texts that are near copies share all their words.  So a form counts for no more toxic texts than there are tokens
    that it follows in them: a term stands behind many, the words of copies each behind the same.
    """
    counts = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    clean, toxic = counts.get(0, 0), counts.get(1, 0)
    if not clean or not toxic:
        return []
    forms = texts.select("toxic", "text").mapInPandas(_forms, "form string, toxic int, n long")
    forms = forms.groupBy("form").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    ratio = lambda t, c: (t + 0.5) / (toxic + 1.0) / ((c + 0.5) / (clean + 1.0))
    strong = forms.where((F.col("t") >= LEAST) & (ratio(F.col("t"), F.col("c")) >= RATIO))
    # the model keeps the CANDIDATES of the highest rate at most
    found = strong.orderBy((F.col("t") / (F.col("c") + 1)).desc(), "form").limit(CANDIDATES).toPandas()
    places = {f: i for i, f in enumerate(found["form"])}
    followed = texts.where("toxic = 1").select("text").mapInPandas(lambda it: _followed(it, places), "place int, before long")
    distinct = followed.distinct().groupBy("place").agg(F.count(F.lit(1)).alias("n")).toPandas().set_index("place")["n"]
    t = np.minimum(found["t"].to_numpy(float), distinct.reindex(range(len(found))).fillna(0).to_numpy(float))
    c = found["c"].to_numpy(float)
    share = np.maximum(t + c, 1) / (clean + toxic)
    gain = 2 * (t * np.log(np.maximum(t, 1) / (share * toxic)) + c * np.log(np.maximum(c, 1) / (share * clean)))
    sure = (t >= LEAST) & (gain >= SURE) & (ratio(t, c) >= RATIO)
    ranked = sorted((-round(g, 6), f.endswith("*"), -len(f), f) for g, f, ok in zip(gain, found["form"], sure, strict=True) if ok)
    taken: dict[str, None] = {}
    covered: set[str] = set()  # beginnings of what is taken
    for *_, form in ranked:
        bare = form.rstrip("*")
        beginnings = {bare[:n] + "*" for n in range(1, len(bare) + 1)}
        if form not in covered and not any(b in taken for b in beginnings):
            taken[form] = None
            covered |= beginnings
    return list(taken)[:ENTRIES]


def _marked(batches: Iterator[pd.DataFrame], entries: list[str]) -> Iterator[pd.DataFrame]:
    lexicon = Lexicon(entries)
    for pdf in batches:
        out = []
        for doc, toxic, text in zip(pdf["doc"], pdf["toxic"], pdf["text"], strict=True):
            tokens, found = found_in(text, lexicon)
            out += [(doc, toxic, tokens, e, d, n, kept) for (e, d), (n, kept) in found.items()] or [(doc, toxic, tokens, -1, 0, 0, 0.0)]
        yield pd.DataFrame(out, columns=["doc", "toxic", "tokens", "entry", "errors", "n", "kept"])


def regression(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes that never speak against toxicity (length apart) and a bias, by Newton steps with damping."""
    spread = np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([x / spread, np.ones(len(x))])
    free = np.ones(z.shape[1], bool)
    beta = np.zeros(z.shape[1])
    beta[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    ridge = np.append(np.full(x.shape[1], DAMPING * len(x) ** 0.5), 1e-6)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        zf = z[:, free]
        hess = (zf * (p * (1 - p))[:, None]).T @ zf + np.diag(ridge[free] + 1e-9)
        step = np.linalg.solve(hess, zf.T @ (y - p) - (ridge * beta)[free])
        beta[free] += np.clip(step, -2, 2)
        against = free.copy()
        against[FEATURES - 1 :] = False
        against &= beta < 0
        if against.any():
            beta[against], free = 0.0, free & ~against
        elif np.abs(step).max() < 1e-8:
            break
    return beta[:-1] / spread, float(beta[-1])


def weigh(rows: pd.DataFrame, entries: int, clean: int, toxic: int) -> np.ndarray:
    """(entries, 3): the weight of each entry with 0, 1 and 2 errors."""
    n = np.zeros((2, entries, 3))
    hit = rows[rows["entry"] >= 0]
    np.add.at(n, (hit["toxic"].to_numpy(), hit["entry"].to_numpy(), hit["errors"].to_numpy()), 1)
    own = np.log((n[1] + 0.5) / (toxic + 1)) - np.log((n[0] + 0.5) / (clean + 1))
    out = np.empty((entries, 3))
    out[:, 0] = own[:, 0]
    for d in (1, 2):
        seen = n[:, :, d].sum(axis=0)
        out[:, d] = (SHRINK * LESS**d * out[:, 0] + seen * own[:, d]) / (SHRINK + seen)
    return np.maximum(out, 0.0)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    texts = durable(sample(docs, labels, rows))
    entries = learn(texts)
    marked = texts.mapInPandas(lambda it: _marked(it, entries), "doc long, toxic int, tokens long, entry int, errors int, n long, kept double")
    found = marked.toPandas().sort_values(["doc", "entry", "errors"])  # at most `rows` documents
    per = found.drop_duplicates("doc")
    y = per["toxic"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(Lexicon([]), np.zeros((0, 3)), np.zeros(0), -500.0 if share == 0 else 500.0)
    weights = weigh(found, len(entries), int((y == 0).sum()), int(y.sum()))
    of: dict[int, dict] = defaultdict(dict)
    for r in found[found["entry"] >= 0].itertuples():
        of[r.doc][r.entry, r.errors] = (r.n, r.kept)
    x = np.array([evidence(t, of.get(d, {}), weights) for d, t in zip(per["doc"], per["tokens"], strict=True)])
    return Model(Lexicon(entries), weights, *regression(x, y))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_terms and n_quoted; one row per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            got = [shared.value.score(t) for t in pdf["text"]]
            score = np.array([g[0] for g in got], float)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "score": score, "predicted": (score >= 0.5).astype(np.int32), "n_terms": [g[1] for g in got], "n_quoted": [g[2] for g in got]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), blank("text").alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, n_terms long, n_quoted double")


def detect(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    return predict(docs, fit(docs, labels, rows))
