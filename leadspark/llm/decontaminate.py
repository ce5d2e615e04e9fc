"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The items' normalised words are put into one suffix automaton (each item from the initial state, so no match runs over
an item's end). A document's words stream through it; state and matching length after each word tell the longest
suffix that occurs in some item. Where that length reaches the window, all words of the match are hit. Runs of words
that occur in no item, or are shorter than the shortest window, can't hold an occurrence and never enter the automaton.

Items are dealt into blocks of a bounded number of words. One block is sent out and met by the documents in one pass. With
more, the documents are bundled once, and each block has a pass of its own, which writes the marks of those documents that
it hits before the next block is collected, so driver and workers hold one block at a time however large the benchmark is
(a single item is never split, so the bound is one block plus the longest item).

``clean`` drops contaminated documents; ``without_spans`` cuts hit spans out of texts by limits of length and coverage.

Defined cases: null texts and items have no words and neither hit nor are hit; rows of an equal item_id are windows of
the same item; items with a null id hit words like others but have no name to be listed or counted by; repeated documents
are judged each on its own; an empty benchmark leaves every document clean; columns to carry may have any names.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, bundled, nullable, spread, tune, unbundled, written

#: Words of an item that count as one window.
WINDOW = 13
#: Words of the items in one automaton.
BLOCK_WORDS = 200_000
#: Bytes of a pack's texts, about, where the items come in several blocks.
PACK_BYTES = 3_000_000
#: The rule for a whole document.
CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the items whose windows end in each state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.words, self.shortest = window, {}, window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int]] = []
        whole: list[tuple[int, int, int]] = []
        self.items = sorted({name for name, words in items if words}, key=lambda name: (name is None, name or ""))
        number = {name: i for i, name in enumerate(self.items)}
        for name, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.words.setdefault(w, len(self.words) + 1))
                ends.append((last, number[name]))
            if 0 < len(words) < window:
                self.shortest = min(self.shortest, len(words))
                whole.append((last, len(words), number[name]))
        self._own(ends, whole)

    def _extend(self, p: int, c: int) -> int:
        q = self.next[p].get(c)
        if q is not None:  # a prefix that an earlier item has made
            return q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[p] + 1)
        self.link.append(0)
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        r = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = r
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = r
            p = self.link[p]
        return r

    def _own(self, ends: list[tuple[int, int]], whole: list[tuple[int, int, int]]) -> None:
        """Per state: items in which its strings occur, kept where a full window ends; short items that end there."""
        own: dict[int, set[int]] = {}
        for v, i in ends:
            while v > 0 and self.length[v] >= self.window:  # up to the state that holds the window's words
                held = own.setdefault(v, set())
                if i in held:
                    break
                held.add(i)
                v = self.link[v]
        self.window_state: dict[int, int] = {}
        self.items_at = {v: frozenset(s) for v, s in own.items() if self.length[self.link[v]] < self.window}
        self.short_at: dict[int, list[tuple[int, int]]] = {}
        for v, n, i in whole:
            self.short_at.setdefault(v, []).append((n, i))
        top = [0] * len(self.next)  # the nearest state at or above with short items
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            top[v] = v if v in self.short_at else top[self.link[v]]
        self.short_top = top

    def run(self, codes: list[int], at: int, delta: np.ndarray, found: set[int]) -> None:
        """Streams words; adds +1/-1 at the edges of each hit span and the numbers of the items that occur."""
        step, link, length, window, top = self.next, self.link, self.length, self.window, self.short_top
        v = n = 0
        for i, c in enumerate(codes, at):
            go = step[v].get(c)
            while go is None and v:
                v = link[v]
                n = length[v]
                go = step[v].get(c)
            if go is None:
                n = 0
                continue
            v, n = go, n + 1
            if n >= window:
                delta[i - n + 1] += 1
                delta[i + 1] -= 1
                u = self.window_state.get(v)
                if u is None:
                    u = v
                    while length[link[u]] >= window:
                        u = link[u]
                    self.window_state[v] = u
                found |= self.items_at[u]
            u = top[v]
            while u:
                for size, item in self.short_at[u]:
                    if size <= n:
                        delta[i - size + 1] += 1
                        delta[i + 1] -= 1
                        found.add(item)
                u = top[link[u]]

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """A mark for each word, and the names (none for null) of the items with an occurring window."""
        n = len(words)
        mask = np.zeros(n, bool)
        if n < self.shortest or not self.items:
            return mask, set()
        codes = np.fromiter(map(self.words.get, words, repeat(0)), np.int64, n)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], codes != 0, [0])).astype(np.int8)))
        starts, stops = edge[::2], edge[1::2]
        long = stops - starts >= self.shortest
        if not long.any():
            return mask, set()
        delta, found = np.zeros(n + 1, np.int64), set()
        for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            self.run(codes[a:b].tolist(), a, delta, found)
        return np.cumsum(delta)[:n] > 0, {self.items[i] for i in found} - {None}


def spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _found(marks: list[tuple[int, np.ndarray, list[str]]]) -> list[pa.Array]:
    """The columns n_words, n_hit, items and hit_spans of some documents' (number of words, mask, items)."""
    told = [[{"start": a, "end": z} for a, z in spans(mask)] for _, mask, _ in marks]
    return [pa.array([n for n, _, _ in marks], pa.int64()), pa.array([int(m.sum()) for _, m, _ in marks], pa.int64()), pa.array([i for _, _, i in marks], pa.list_(pa.string())), pa.array(told, _SPANS)]


def scan(docs: DataFrame, bench: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, carry: list[str] | None = None) -> DataFrame:
    """(key, n_words, n_hit, items, hit_spans, contaminated) of each document, and columns to carry along as a struct ``row``.

    hit_spans are word ranges [start, end).
    """
    tune(docs.sparkSession)
    items = bench.select(F.col(item).cast("string").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).distinct()
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total // (block_words * 4)))
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"), *([F.struct(*carry).alias("row")] if carry else []))
    row = f", row {rows.schema['row'].dataType.simpleString()}" if carry else ""
    names = ["k", "n_words", "n_hit", "items", "hit_spans", *["row"] * bool(row)]
    ddl = f"k {rows.schema['k'].dataType.simpleString()}, n_words long, n_hit long, items array<string>, hit_spans array<struct<start:int,end:int>>{row}"

    def sent(part: DataFrame) -> tuple[Broadcast, str]:
        """A block's items, of bounded size, for all workers."""
        data = pickle.dumps(sorted(((r.i, alnum_words(r.t)) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or "", x[1])))
        return sc.broadcast(data), hashlib.sha256(data).hexdigest()

    if blocks == 1:
        held, name = sent(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _built(name, held, window)
            for b in batches:
                marks = []
                for t in b.column(1).to_pylist():
                    words = alnum_words(t)
                    mask, found = automaton.hits(words)
                    marks.append((len(words), mask, sorted(found)))
                yield pa.RecordBatch.from_arrays([b.column(0), *_found(marks), *b.columns[2:]], names=names)

        out = spread(rows).mapInArrow(run, ddl)
        return out.withColumn("contaminated", F.expr(CONTAMINATED)).withColumnRenamed("k", key)

    packs = written(bundled(rows, PACK_BYTES)).select("pack", "data")
    passes = []
    for k in range(blocks):
        held, name = sent(items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k))

        def block(batches: Iterator[pa.RecordBatch], held=held, name=name) -> Iterator[pa.RecordBatch]:
            automaton = _built(name, held, window)
            for b in batches:
                for pack, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    hit = []
                    for at, t in enumerate(unbundled(data.as_py())["text"].to_pylist()):
                        mask, found = automaton.hits(alnum_words(t))
                        if mask.any():
                            hit.append((at, np.packbits(mask).tobytes(), sorted(found)))
                    if hit:
                        yield pa.RecordBatch.from_arrays([pa.array([pack] * len(hit), pa.int64()), *(pa.array([h[j] for h in hit], t) for j, t in enumerate((pa.int32(), pa.binary(), pa.list_(pa.string()))))], names=["pack", "at", "mask", "items"])

        passes.append(written(packs.mapInArrow(block, "pack long, at int, mask binary, items array<string>")))
        held.destroy()
    marked = passes[0]
    for p in passes[1:]:
        marked = marked.union(p)

    def together(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        table = unbundled(left["data"][0].as_py())
        of: dict[int, tuple[np.ndarray, set]] = {}
        marks = []
        n = [len(alnum_words(t)) for t in table["text"].to_pylist()]
        for at, mask, found in zip(*(right[c].to_pylist() for c in ("at", "mask", "items")), strict=True):
            whole, names_ = of.setdefault(at, (np.zeros(n[at], bool), set()))
            whole |= np.unpackbits(np.frombuffer(mask, np.uint8), count=n[at]).astype(bool)
            names_.update(found)
        for at, size in enumerate(n):
            mask, found = of.get(at, (np.zeros(size, bool), ()))
            marks.append((size, mask, sorted(found)))
        return pa.Table.from_arrays([table["k"], *_found(marks), *([nullable(table["row"])] if carry else [])], names=names)

    out = packs.groupBy("pack").cogroup(marked.groupBy("pack")).applyInArrow(together, ddl)
    return out.withColumn("contaminated", F.expr(CONTAMINATED)).withColumnRenamed("k", key)


_LAST: dict = {}


def _built(name: str, held: Broadcast, window: int) -> SuffixAutomaton:
    """The worker's automaton of a block; only the latest is kept."""
    if _LAST.get("name") != (name, window):
        _LAST.clear()
        _LAST.update(name=(name, window), automaton=SuffixAutomaton(pickle.loads(held.value), window))
    return _LAST["automaton"]


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns of what ``scan`` finds."""
    return found.select(
        key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows, with all their columns, that are not contaminated."""
    return scan(docs, bench, carry=docs.columns).filter("not contaminated").select("row.*")


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def without_spans(docs: DataFrame, bench: DataFrame, least_words: int = WINDOW, most_coverage: float = 0.5, **how) -> DataFrame:
    """The rows, with all their columns, less the benchmark's words.

    Hit spans of at least least_words words are cut out of the text, from the first word's first to the last one's last
    character; rows of whose words more than most_coverage are hit go as a whole. What is around a cut, and rows without
    such spans, stay as they are; null texts stay null.
    """
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, found in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                cuts = [s for s in found if s["end"] - s["start"] >= least_words]
                if cuts:
                    words = [m.span() for m in _WORD.finditer(t)]
                    edges = [0, *(e for s in cuts for e in (words[s["start"]][0], words[s["end"] - 1][1])), len(t)]
                    t = "".join(t[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))], names=names)

    found = scan(docs, bench, carry=names, **how).filter(F.col("n_hit") <= most_coverage * F.col("n_words"))
    kept = found.select(*(F.col(f"row.`{c}`").alias(c) for c in names), F.col("hit_spans").alias("_hit_spans"))
    return kept.mapInArrow(run, docs.schema)
