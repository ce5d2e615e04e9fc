"""Language-model scores by a weighted backoff automaton, learnt and applied across the cluster.

The model: p(w) = (c(w) + a) / (N + a (V + 1)), and p(w | h) = (c(h w) + K p(w | h')) / (c(h) + K), h' being h without its
first word. As an automaton (``BackoffAutomaton``): each history that was seen is a state; a seen n-gram is an arc with its
weight; every state has a failure arc of weight log K / (c(h) + K) to the state of h'. A text is walked once, left to
right, with one state to carry: while the state has no arc for the word its failure arc is taken, and the weights add up
to the text's log-probability.

The whole machine is too large to send to every task, so each task gets the part that its own texts can reach.
Documents are bundled into packs of a few MB; each pack sends its distinct n-grams with their training counts through an
``Exchange`` and gets the corpus' totals back for just these, from which it makes the states, arcs and failure arcs that
its texts meet. What is moved is one entry for each distinct n-gram of a pack, so frequent words weigh as little as rare
ones. N-grams are told apart by 64 bits of hash beside their family, which other bits deal.

Defined cases: a null text is the empty one, whose only token is the end; repeated rows count each; rows of a null id
are learnt from; without training rows all counts are 0 and every token has probability 1; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bundled, crc_bucket, mix, tune, unbundled, written
from .exchange import Exchange, stats_of, totals

#: Additive smoothing of single tokens; weight of the shorter history; words of an n-gram; bytes of a pack's texts, about.
ADD, PRIOR, ORDER, PACK_BYTES = 0.1, 100.0, 2, 3_000_000
#: Least bytes of a token and its separator on average, to foresee the number of n-grams.
TOKEN_BYTES = 5

_START, _END = 0, 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Grams:
    """The n-grams of some texts up to an order, numbered order by order; a text is its start, its words and its end."""

    def __init__(self, texts: list[str | None], learnt: np.ndarray, order: int = ORDER):
        numbers = _Numbers({None: _START, b"": _END})
        parts = [np.fromiter(map(numbers.__getitem__, (t or "").encode().lower().split()), np.int64) for t in texts]
        self.order, self.learnt, self.kinds = order, learnt, len(numbers)
        self.n = np.array([len(p) + 1 for p in parts], np.int64)  # tokens: the words and the end
        stop = np.cumsum(self.n + 1)
        self.words = np.full(int(stop[-1]) if len(stop) else 0, _END, np.int64)
        for p, z in zip(parts, stop.tolist(), strict=True):
            self.words[z - len(p) - 1 : z - 1] = p
        self.starts = stop - self.n - 1
        self.words[self.starts] = _START
        hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b"\n" if w is None else w) for w in numbers), ">u8").astype(np.uint64).reshape(-1, 2)
        within = np.arange(len(self.words)) - np.repeat(self.starts, self.n + 1)
        in_training = np.repeat(learnt, self.n + 1)
        #: By order: number of the n-gram without its last word, its last word, number of the n-gram without its first word.
        self.prefix, self.word, self.suffix = [None], [np.arange(self.kinds)], [None]
        self.counts = [np.bincount(self.words[in_training], minlength=self.kinds)]
        self.keys, self.deal = [hashes[:, 0]], [hashes[:, 1]]
        last, there = self.words, None
        for n in range(2, order + 1):
            place = np.flatnonzero(within >= n - 1)
            before = last[place - 1] if there is None else last[np.searchsorted(there, place - 1)]
            shorter = last[place] if there is None else last[np.searchsorted(there, place)]
            code, number = np.unique(before * self.kinds + self.words[place], return_inverse=True)
            self.prefix.append(code // self.kinds), self.word.append(code % self.kinds)
            suffix = np.empty(len(code), np.int64)
            suffix[number] = shorter
            self.suffix.append(suffix)
            self.counts.append(np.bincount(number[in_training[place]], minlength=len(code)))
            for made, single in ((self.keys, hashes[:, 0]), (self.deal, hashes[:, 1])):
                made.append(mix(made[-1][self.prefix[-1]] * _A + single[self.word[-1]] * _B + np.uint64(n)))
            last, there = number, place

    def sent(self, of_words: Exchange, of_longer: Exchange, unit: int) -> Iterator[pa.RecordBatch]:
        """The messages with the counts of the words, the start left out, and of the longer n-grams."""
        yield from of_words.messages(unit, self.keys[0][1:], self.deal[0][1:], self.counts[0][1:])
        if self.order > 1:
            yield from of_longer.messages(unit, *(np.concatenate(x[1:]) for x in (self.keys, self.deal, self.counts)))

    def heard(self, of_words: Exchange, of_longer: Exchange, told: dict[int, bytes]) -> list[np.ndarray]:
        """The corpus' counts by order, from the answers; texts start as often as they end."""
        words = of_words.totals_of(self.keys[0][1:], self.deal[0][1:], told)
        out = [np.concatenate((words[_END - 1 : _END], words))]
        if self.order > 1:
            longer = of_longer.totals_of(np.concatenate(self.keys[1:]), np.concatenate(self.deal[1:]), told)
            out += np.split(longer, np.cumsum([len(k) for k in self.keys[1:]])[:-1])
        return out


class BackoffAutomaton:
    """States, arcs and failure arcs over the n-grams of some texts.

    State 0 has no history; it has an arc for every word. counts: of each n-gram in training, by order; tokens and kinds: of
    the training words in all.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: int, kinds: int, add: float = ADD, prior: float = PRIOR):
        g, order = grams, grams.order
        weight = np.log10((counts[0] + add) / (tokens + add * (kinds + 1))) if tokens else np.zeros(g.kinds)
        first = np.cumsum([1] + [len(c) for c in counts[: order - 1]])  # state of an n-gram that is a history: first[n - 1] + its number

        def state(n: int, number: np.ndarray) -> np.ndarray:
            """The state of n-grams, 0 for those that no training text goes on from."""
            return np.where((counts[n - 1][number] > 0) & (g.word[n - 1][number] != _END), first[n - 1] + number, 0)

        self.kinds, self.root_weight = g.kinds, weight.tolist()
        self.root_next = (state(1, np.arange(g.kinds)) if order > 1 else np.zeros(g.kinds, np.int64)).tolist()
        self.start = self.root_next[_START]
        self.fail, self.fail_weight = np.zeros(int(first[order - 1]), np.int64), np.zeros(int(first[order - 1]))
        self.arc: dict[int, int] = {}
        weights, targets = [], []
        for n in range(1, order):
            own = first[n - 1] + np.arange(len(counts[n - 1]))
            self.fail_weight[own] = np.log10(prior / (counts[n - 1] + prior))
            if n > 1:
                self.fail[own] = state(n - 1, g.suffix[n - 1])
            # the arcs of these states: n-grams one word longer
            seen = np.flatnonzero(counts[n] > 0)
            before, word, shorter = g.prefix[n][seen], g.word[n][seen], g.suffix[n][seen]
            longer_weight = np.zeros(len(counts[n]))
            longer_weight[seen] = np.log10((counts[n][seen] + prior * 10.0 ** weight[shorter]) / (counts[n - 1][before] + prior))
            weight = longer_weight
            self.arc.update(zip((state(n, before) * g.kinds + word).tolist(), range(len(weights), len(weights) + len(seen)), strict=True))
            weights += weight[seen].tolist()
            targets += (state(n + 1, seen) if n + 1 < order else state(n, shorter)).tolist()
        self.fail, self.fail_weight, self.weight, self.target = self.fail.tolist(), self.fail_weight.tolist(), weights, targets

    def walk(self, words: list[int]) -> list[float]:
        """The log10 probability of each of the texts whose words, each text with its start and end, stand one after another."""
        arc, weight, target, fail, fail_weight, root_weight, root_next, kinds = self.arc.get, self.weight, self.target, self.fail, self.fail_weight, self.root_weight, self.root_next, self.kinds
        out, state, total = [], 0, 0.0
        for w in words:
            if w == _START:
                state, total = self.start, 0.0
                continue
            while state:
                if (a := arc(state * kinds + w)) is not None:
                    total += weight[a]
                    state = target[a]
                    break
                total += fail_weight[state]
                state = fail[state]
            else:
                total += root_weight[w]
                state = root_next[w]
            if w == _END:
                out.append(total)
        return out


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def scores(docs: DataFrame, folds: int = 10, add: float = ADD, prior: float = PRIOR, order: int = ORDER, pack_bytes: int = PACK_BYTES, fan_in: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); rows of fold 0 are not learnt from."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.coalesce(crc_bucket("doc_id", folds) != 0, F.lit(True)).alias("learnt"))
    packs = written(bundled(rows, pack_bytes))
    n_packs, size = packs.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    limits = {"fan_in": fan_in} if fan_in else {}
    of_longer = Exchange.of(n_packs, size // TOKEN_BYTES * (order - 1), **limits)
    of_words = Exchange.of(n_packs, size // (2 * TOKEN_BYTES), of_longer.families, **limits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = unbundled(data.as_py())
                yield from Grams(rows["text"].to_pylist(), np.asarray(rows["learnt"]), order).sent(of_words, of_longer, pack)

    sent = packs.select("pack", "data").mapInArrow(count, "cell long, unit long, keys binary, counts binary")
    told = written(totals(sent, of_longer, **limits))
    kinds, tokens = stats_of(told, of_words.first, of_words.families)

    def walk(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = unbundled(left["data"][0].as_py())
        g = Grams(rows["text"].to_pylist(), np.asarray(rows["learnt"]), order)
        counts = g.heard(of_words, of_longer, dict(zip(right["family"].to_pylist(), right["data"].to_pylist(), strict=True)))
        machine = BackoffAutomaton(g, counts, tokens, kinds, add, prior)
        seen, base = counts[0] > 0, np.array(machine.root_weight)
        seen[_START], base[_START] = False, 0.0
        return pa.table(
            {
                "doc_id": rows["id"], "held_out": pa.array(~g.learnt), "n_tokens": g.n, "n_known": np.add.reduceat(seen[g.words], g.starts, dtype=np.int64), "train_tokens": np.full(len(g.n), tokens, np.int64),
                "base_score": np.add.reduceat(base[g.words], g.starts), "score": np.array(machine.walk(g.words.tolist())),
            },
            schema=_SCORES,
        )

    answers = told.select(F.col("unit").alias("pack"), "family", "data")
    return packs.select("pack", "data").groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(walk, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
