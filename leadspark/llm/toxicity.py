"""Toxicity scores: a lexicon trie met with Levenshtein automata, and context windows around what they find.

``learn`` takes a bounded sample of labelled rows (``FIT_ROWS``, by hash of the id) and draws from it, with no further bound,

* a lexicon of words and of stems that toxic texts hold in many different surroundings and clean ones hardly ever do
  (counting surroundings, not texts, keeps the words of one much-copied text out);
* variants that stand within the allowed edits of a term but occur in clean texts, to be let pass;
* a logistic model over what the matcher and the context windows find.

The matcher is the product of the trie and the Levenshtein automata of its terms, made deterministic as states come up:
a state is a set of (trie node, edits so far), and most words leave it after a few letters. Whole words of under 5
letters must match exactly, those of 5 to 8 letters allow one edit, longer ones two. A stem accepts any ending; it allows
one edit from 7 letters on and none below. Learnt words that a stem covers stay in the trie beside it, so that their
misspellings are met; what they match counts for the stem.

Each match is looked at in a window of words: inside quotation marks or beside a word of reporting it counts as
quotation, beside a word of address it counts as abuse.

Defined cases: null and empty texts have no match and get the model's score of no match; without toxic or without clean
labelled rows there is no lexicon, and the score of every text is the share of toxic among labelled rows, below 0.5;
null labels and ids are left out of learning, an id labelled twice counts as toxic if either says so; repeated documents
are scored each on its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, spread, tune, written

#: Labelled rows that learning may take.
FIT_ROWS = 8000
#: Surroundings and toxic texts that a term needs, and the largest probability that its texts are toxic by chance.
LEAST_SUPPORT, MOST_CHANCE = 5, 1e-6
#: Letters of a stem.
STEM = range(4, 8)
#: Words on each side of a match.
WINDOW = 8

# Words of reporting, and words of address, in the languages of the corpus.
REPORTING = frozenset("said says called quoted quote wrote according reported term word sagte nannte zitat laut wort dit cite selon mot dijo cita según palabra".split())
ADDRESS = frozenset("you your youre yourself u du dich dein ihr euch tu toi vous ton tú usted ustedes eres".split())
QUOTES = "\"“”„«»‹›‘’"

_SEPARATE = {b: " " for b in range(128) if not chr(b).isalnum()}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[str]:
    return text.lower().translate(_SEPARATE).split() if text else []


def edits_allowed(term: str, stem: bool) -> int:
    return 0 if len(term) < (7 if stem else 5) else 1 if len(term) < 9 or stem else 2


class Matcher:
    """The lexicon trie met with the Levenshtein automata of its terms, determinised on the way."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, bool, int]]] = [[]]  # (allowed edits, stem, term)
        self.reach = [-1]  # the most edits that a term below allows
        self.terms = terms
        stems = {t: k for k, (t, stem) in reversed(list(enumerate(terms))) if stem}
        #: The term that a match counts for: a whole word's shortest stem, if there is one.
        self.counts_for = [k if stem else next((stems[t[:n]] for n in range(1, len(t) + 1) if t[:n] in stems), k) for k, (t, stem) in enumerate(terms)]
        for k, (term, stem) in enumerate(terms):
            d, at = edits_allowed(term, stem), 0
            self.reach[0] = max(self.reach[0], d)
            for c in term:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.reach.append(-1)
                at = self.child[at][c]
                self.reach[at] = max(self.reach[at], d)
            self.ends[at].append((d, stem, k))
        self.number: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.go: list[dict[str, int]] = []
        self.known: dict[str, tuple[int, int] | None] = {}
        self.start = self._state({0: 0}) if terms else -1

    def _state(self, at: dict[int, int]) -> int:
        """Closes a set of node: fewest edits under leaving out letters of a term; -1 if it is empty."""
        todo = list(at)
        while todo:
            n = todo.pop()
            for c in self.child[n].values():
                e = at[n] + 1
                if e <= self.reach[c] and e < at.get(c, 9):
                    at[c] = e
                    todo.append(c)
        key = frozenset(at.items())
        if not key:
            return -1
        if key not in self.number:
            if len(self.sets) > 50_000:  # start over rather than grow without end
                self.number.clear()
                self.sets, self.go = [], []
                self.start = self._state({0: 0})
            self.number[key] = len(self.sets)
            self.sets.append(at)
            self.go.append({})
        return self.number[key]

    def _step(self, s: int, c: str) -> int:
        new: dict[int, int] = {}
        for n, e in self.sets[s].items():
            hit = self.child[n].get(c)
            if hit is not None and e <= self.reach[hit] and e < new.get(hit, 9):
                new[hit] = e
            if e + 1 <= self.reach[n] and e + 1 < new.get(n, 9):
                new[n] = e + 1
            for k in self.child[n].values():
                if e + 1 <= self.reach[k] and e + 1 < new.get(k, 9):
                    new[k] = e + 1
        before = len(self.sets)
        t = self._state(new)
        if len(self.sets) >= before:
            self.go[s][c] = t
        return t

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the best term, or None; fewest edits first, then the longer term."""
        if word in self.known:
            return self.known[word]
        s, best = self.start, None
        if s < 0:  # no terms
            return None
        for i, c in enumerate(word):
            t = self.go[s].get(c)
            s = self._step(s, c) if t is None else t
            if s < 0:
                break
            last = i == len(word) - 1
            for n, e in self.sets[s].items():
                for d, stem, k in self.ends[n]:
                    if e <= d and (stem or last):
                        rank = (e, -len(self.terms[k][0]), k)
                        best = rank if best is None or rank < best else best
        if len(self.known) > 300_000:
            self.known.clear()
        out = self.known[word] = None if best is None else (self.counts_for[best[2]], best[0])
        return out


@dataclass
class Model:
    terms: list[tuple[str, bool]] = field(default_factory=list)
    clean: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=lambda: [0.0] * 7)
    constant: float | None = 0.0

    def score(self, x: list[float]) -> float:
        if self.constant is not None:
            return self.constant
        z = sum(a * b for a, b in zip(self.weights, [1.0, *x], strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(text: str | None, matcher: Matcher, clean: frozenset[str]) -> tuple[list[float], list[tuple[str, int, int, bool]]]:
    """(exact, inexact, quoted, addressed, hits per 100 words, different terms), and the matches (word, term, edits, quoted)."""
    words = words_of(text)
    found = {}
    for w in set(words):
        if (m := matcher.match(w)) is not None and (m[1] == 0 or w not in clean):
            found[w] = m
    if not found:
        return [0.0] * 6, []
    low = text.lower()
    at = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(low)]
    exact = inexact = quoted = addressed = 0.0
    hits = []
    for i, (a, b, w) in enumerate(at):
        if w not in found:
            continue
        term, edits = found[w]
        near = {x[2] for x in at[max(0, i - WINDOW) : i]} | {x[2] for x in at[i + 1 : i + 1 + WINDOW]}
        left = low[at[max(0, i - WINDOW)][0] : a]
        right = low[b : at[min(len(at) - 1, i + WINDOW)][1]]
        is_quoted = (any(q in left for q in QUOTES) and any(q in right for q in QUOTES)) or not REPORTING.isdisjoint(near)
        is_abuse = not ADDRESS.isdisjoint(near)
        value = 0.3 if is_quoted and not is_abuse else 1.0
        exact, inexact = exact + value * (edits == 0), inexact + value * (edits > 0)
        quoted, addressed = quoted + is_quoted, addressed + is_abuse
        hits.append((w, term, edits, is_quoted))
    return [math.log1p(exact), math.log1p(inexact), math.log1p(quoted), math.log1p(addressed), min(1.0, 10 * (exact + inexact) / len(at)), math.log1p(len({h[1] for h in hits}))], hits


def _feature_names(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEM if n < len(word))]


def learn(docs: DataFrame, labels: DataFrame, fold: F.Column | None = None, fit_rows: int = FIT_ROWS) -> Model:
    """A model from labelled rows with ids in the fold that may be learnt from (all by default)."""
    tune(docs.sparkSession)
    spark = docs.sparkSession
    given = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null")
    if fold is not None:
        given = given.filter(fold)
    given = given.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # fit_rows ids and labels go out; their texts are kept as a small table, so the corpus is read once
    rows = docs.select("doc_id", "text").join(F.broadcast(given), "doc_id")
    rows = written(rows.select("text", "toxic", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(2)).alias("half")).repartition(8))

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            for t in b.column(0).to_pylist():
                ws = words_of(t)
                for p, w, n in zip(["", *ws], ws, [*ws[1:], ""], strict=False):
                    if len(w) > 2:
                        near = hash_of(p, n)
                        seen.update((f, near) for f in _feature_names(w))
        names, near = zip(*seen, strict=True) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(near, pa.int64())], names=["f", "near"])

    toxic = rows.filter("toxic = 1").select("text")
    counted = toxic.mapInArrow(surroundings, "f string, near long").distinct().groupBy("f").agg(F.count("*").alias("n"))
    sizes = {int(r.toxic): r.n for r in given.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    if not n_toxic or not n_clean:
        return Model(constant=min(0.49, n_toxic / (n_toxic + n_clean)) if n_toxic + n_clean else 0.0)
    least = max(LEAST_SUPPORT, round(0.005 * n_toxic))

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.update((f, int(y == 1)) for f in {f for w in set(words_of(t)) if len(w) > 2 for f in _feature_names(w)})
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], names=["f", "y", "n"])

    texts_with = rows.mapInArrow(presence, "f string, y int, n long").groupBy("f").agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("pos"), F.sum(F.expr("if(y = 1, 0, n)")).alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n_toxic + 1)) - F.log((F.col("neg") + 0.5) / (n_clean + 1))
    features_ = texts_with.filter((F.col("pos") >= least) & (F.col("neg") * 10 <= F.col("pos")) & (odds >= 2.5)).join(counted.filter(F.col("n") >= least), "f", "left_semi")
    # features of toxic texts only: as many as the fit_rows texts of the sample bear out
    ranked = [(-r.pos, r.f.endswith("*"), -len(r.f), r.f) for r in features_.collect() if by_chance(r.pos, r.pos + r.neg, n_toxic / (n_toxic + n_clean)) < MOST_CHANCE]
    chosen = lexicon([f for *_, f in sorted(ranked)])
    model = Model(terms=sorted(chosen))
    held_terms = model.terms

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, none = Matcher(held_terms), frozenset()
        for b in batches:
            hits = [features(t, matcher, none)[1] if y != 1 else [] for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([sorted({h[0] for h in found if h[2]}) for found in hits], pa.list_(pa.string()))], names=["variants"])

    # variants come from one half of the sample and the weights from the other, so that variants yet unseen get a fair weight
    clean = rows.filter("half = 0").mapInArrow(variants, "variants array<string>").select(F.explode("variants").alias("v")).distinct()
    model.clean = frozenset(r.v for r in clean.collect())
    passing = model.clean

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(held_terms)
        for b in batches:
            x = [[float(y == 1), *features(t, matcher, passing)[0]] for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64()))], names=["x"])

    data = np.array([r.x for r in rows.filter("half = 1").mapInArrow(final, "x array<double>").collect()])  # fit_rows rows of 7 numbers
    if len(data):
        model.weights, model.constant = fitted(data[:, 1:], data[:, 0]), None
    return model


def lexicon(ranked: list[str]) -> list[tuple[str, bool]]:
    """(term, is it a stem) from features, the widest first: what a chosen stem covers, or what adds nothing to chosen terms, is no
    term of its own; of the words that chosen stems cover, those that allow edits stand beside them."""
    terms: list[tuple[str, bool]] = []
    stems: set[str] = set()
    begun: set[str] = set()  # all that a chosen term begins with, itself included
    for f in ranked:
        t, stem = f.rstrip("*"), f.endswith("*")
        if not any(t[:n] in stems for n in range(1, len(t) + 1)) and not (stem and t in begun):
            terms.append((t, stem))
            begun.update(t[:n] for n in range(1, len(t) + 1))
            if stem:
                stems.add(t)
    return terms + [(f, False) for f in ranked if not f.endswith("*") and edits_allowed(f, False) and any(f[:n] in stems for n in STEM)]


def by_chance(k: int, n: int, p: float) -> float:
    """Probability of k or more of n when each comes with probability p."""
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    return sum(map(math.exp, log))


def hash_of(a: str, b: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{a} {b}".encode()) >> 1


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> list[float]:
    """Logistic regression by Newton steps; the ridge keeps separable data finite."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return [float(v) for v in w]


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, n_matches, matches) of each text."""
    tune(docs.sparkSession)
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms)
        for b in batches:
            scores, found = [], []
            for t in b.column(1).to_pylist():
                x, hits = features(t, matcher, model.clean)
                scores.append(model.score(x))
                found.append(sorted({h[0] for h in hits}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([len(f) for f in found], pa.int64()), pa.array(found, pa.list_(pa.string()))], names=["k", "score", "n_matches", "matches"])

    return spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInArrow(run, f"k {kind}, score double, n_matches long, matches array<string>").withColumnRenamed("k", key)


def judged(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """The contract's columns: learnt from rows outside fold 0, told for all rows."""
    model = learn(docs, labels, crc_bucket("doc_id", folds) != 0)
    return score(docs, model).select("doc_id", F.coalesce(crc_bucket("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")


def clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores below the limit."""
    tune(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms)
        for b in batches:
            yield b.filter(pa.array([model.score(features(t, matcher, model.clean)[0]) < limit for t in b.column(at).to_pylist()], pa.bool_()))

    return spread(docs).mapInArrow(run, docs.schema)
