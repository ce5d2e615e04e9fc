"""Bounded memory on repetitive texts, exact links of very large sets, and the share of near copies that banding catches."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import make

from leadspark.llm import minhash, suffix_dedup

RNG = np.random.default_rng(1)
LETTERS = list(range(97, 123))


def letters(n):
    return bytes(RNG.choice(LETTERS, n).tolist())


REPETITIVE = {
    "one": b"a" * 30_000, "two": b"ab" * 15_000, "lines": b"0\n" * 15_000, "cells": b"<td>0</td><td></td>\n" * 1500, "columns": b"col;0;0;\n" * 3000,
    "rules": b"".join(b"-" * 80 + letters(30) + b"\n" for _ in range(200)), "broken": b"".join(b"ab" * 40 + letters(1) for _ in range(300)),
    "nine": b"".join(b"<td></td>" * 8 + letters(28) for _ in range(300)), "page": letters(200) * 100, "joined": b"a" * 500 + letters(300) + b"ab" * 400 + b"a" * 500 + letters(100) + b"xyz" * 300,
}


def late_of(texts):
    """Starts of a pack's texts whose string starts earlier, by the pack's own steps."""
    pack = suffix_dedup.Pack(pa.table({"id": list(range(len(texts))), "text": pa.array(texts, pa.binary())}), 100)
    start, stop, place, anchor, row = pack.runs(24)
    number = np.unique(anchor, return_inverse=True)[1]
    late = np.zeros(len(pack.data), bool)
    late[pack.steps] = True
    piece, at, n = suffix_dedup.late_runs(pack.data, start, stop - start, place - start, number, pack.owner[row], start - pack.offset[row], 100)
    if len(piece):
        late[suffix_dedup.ranges(start[piece] + at, start[piece] + at + n)[0]] = True
    return pack, late, len(start)


@pytest.mark.parametrize("bucket", [1 << 18, 300])
@pytest.mark.parametrize("names", [[k] for k in REPETITIVE] + [list(REPETITIVE), ["one", "one", "joined"]])
def test_repetitive_texts(names, bucket, monkeypatch):
    """Each start is late if its string has been there before; small buckets part the strings of one anchor."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    texts = [REPETITIVE[k] for k in names]
    pack, late, _ = late_of(texts)
    seen, at = set(), 0
    for t in texts:
        for i in range(max(0, len(t) - 99)):
            s = t[i : i + 100]
            assert late[at + i] == (s in seen), (i, names)
            seen.add(s)
        at += len(t)


@pytest.mark.parametrize("unit", [b"a", b"ab", b"0\n", b"col;0;0;\n", b"-" * 80 + b"q\n"])
def test_memory_of_repetitive_texts(unit):
    """A document of 3 MB of one short thing takes a few hundred MB at most, not GB."""
    text = unit * (3_000_000 // len(unit))
    tracemalloc.start()
    _, late, runs = late_of([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert late.sum() >= len(text) - 200 - len(unit) and peak < 400_000_000, (runs, peak)


def test_repetitive_documents(spark):
    """Through all steps: the string that starts one byte later covers all but the first byte."""
    out = {r.doc_id: r for r in suffix_dedup.repeats(make(spark, ["a" * 3_000_000, "a" * 1000, "b" * 500 + "a" * 500, "a" * 50])).collect()}
    assert [(out[i].n_bytes - out[i].n_removed) for i in range(4)] == [1, 0, 1, 50]


def test_very_large_sets_are_linked_exactly():
    """An intersection of 765,011 in a union of 900,013 is below 0.85 by 5 parts in a hundred of one shingle, and one more is not."""
    a, b = np.arange(765_011 + 67_501, dtype=np.uint64), np.concatenate((np.arange(765_011), np.arange(10**7, 10**7 + 67_501))).astype(np.uint64)
    both = len(np.intersect1d(a, b)), len(np.union1d(a, b))
    assert both == (765_011, 900_013) and 100 * both[0] - 85 * both[1] == -5
    assert minhash.linked([a, b], 85).tolist() == [0, 1]
    assert minhash.linked([a, np.append(b, np.uint64(765_011))], 85).tolist() == [0, 0]


@pytest.mark.parametrize(("size", "least", "slots"), [(3, 85, 7), (5, 80, 5)])
def test_share_of_near_copies_that_is_caught(spark, size, least, slots):
    """Planted pairs by band of true similarity: all at and above the limit, none below it."""
    rng = np.random.default_rng(21)
    texts, pairs = [], {}
    for k in range(400):
        w = [f"w{x}" for x in rng.integers(0, 50_000, 240)]
        other = list(w)
        for at in rng.choice(240, int(rng.integers(0, 16)), replace=False):
            other[at] = f"edit{rng.integers(0, 10**9)}"
        pairs[len(texts)] = len(texts) + 1
        texts += [" ".join(w), " ".join(other)]

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make(spark, texts), size=size, least=least, slots=slots).collect()}
    bands = {}
    for a, b in pairs.items():
        x, y = shingles(texts[a]), shingles(texts[b])
        near = 100 * len(x & y) >= least * len(x | y)
        band = min(int(20 * len(x & y) / len(x | y)), 19) / 20
        n, caught = bands.get((band, near), (0, 0))
        bands[band, near] = (n + 1, caught + (got[a] == got[b]))
    assert all(n == caught for (_, near), (n, caught) in bands.items() if near), bands
    assert all(caught == 0 for (_, near), (n, caught) in bands.items() if not near), bands
    assert sum(n for (_, near), (n, _) in bands.items() if near) > 100 and sum(n for (_, near), (n, _) in bands.items() if not near) > 20
