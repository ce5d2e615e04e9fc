"""Repeated passages by blockwise suffix sorting with a difference cover.

Asked: for each text the bytes covered by a string of ``length`` bytes that also starts earlier (a smaller document, or
earlier in the same one). That needs, for every class of suffixes with equal first ``length`` bytes, its earliest member.

*Sorting a block* (``SuffixBlock``). A block holds pieces of text. Suffixes whose start modulo v lies in a difference
cover are ranked first, by their first ``length`` bytes. Then one bucket of suffixes at a time is sorted by its first v
bytes; suffixes that tie on these are told apart by the rank of the cover suffix at the shift that the two residues
share, so no comparison reads further than v bytes plus one rank, and memory is the block's bytes plus the cover's
ranks. Neighbours in the order are one class if their first ``length`` bytes agree.

*Blocks over a cluster.* A string of ``length`` bytes has a least k-gram hash (its anchor) at the same offset in each
occurrence, so equal strings meet if pieces go where their anchor says. The steps:

1. documents are bundled into packs of a few MB; of texts with equal bytes only the least document's is looked at, the
   others are repeats as a whole;
2. each pack sends how many runs of starts each of its anchors has through an ``Exchange``, and gets the corpus' totals,
   so it knows which anchors other packs have too, and which are oversized;
3. a pack sorts its own suffixes first, so that of each class only its earliest start goes on, however common the
   passage is, and sends the runs of these with their bytes, by anchor; starts of an oversized anchor go one by one, by a
   hash of their whole string, so that different strings part;
4. the receiving blocks sort what has come, and mark each start that is not the earliest of its class. With more than
   ``MOST_RUNS`` packs a string that all have meets in shares of the packs first, and then the shares' firsts;
5. packs put their own repeats and those they are told together.

Starts are laid into a block so that anchors stand at multiples of v: then suffixes that may be equal share a residue,
and one shift serves a whole bucket of ties.

Defined cases: a null or empty text has no bytes and keeps none; texts shorter than ``length`` are kept unless removed by
nothing; rows of an equal doc_id are one document whose rows all begin at place 0 (so a string at an equal place of two of
them is removed from neither, else from the later place); a null id comes before all ids; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, bundled, mix, nullable, tune, unbundled, written
from .exchange import FAN_IN, Exchange, totals

#: Bytes of a repeated string, of an anchor, and of a pack's texts, about.
LENGTH, GRAM, PACK_BYTES = 100, 24, 3_000_000
#: Bytes of text for each different anchor, at least, to foresee their number; anchors that are added up together; runs of one anchor, or pieces of one string, that meet in a task.
ANCHOR_BYTES, ANCHORS, MOST_RUNS = 32, 500_000, 16_384
#: A difference cover modulo 32 (every difference modulo 32 is one of two members).
COVER_MODULUS, COVER = 32, (0, 1, 2, 3, 7, 11, 19)
#: Suffixes that are sorted at a time; an anchor that has more is parted by its strings, so only equal strings can be more.
BUCKET = 1 << 18
#: Grams of so short a period are the last to be anchors.
PERIOD = 8
#: Bytes of pieces in one batch of rows.
BATCH_BYTES = 1 << 28

_K = np.uint64(0x9E3779B97F4A7C15)


def _check_cover() -> np.ndarray:
    """shift[r][s]: the least d with (r + d) and (s + d) both in the cover."""
    v, inside = COVER_MODULUS, set(COVER)
    shift = np.full((v, v), -1, np.int32)
    for r in range(v):
        for s in range(v):
            shift[r, s] = next((d for d in range(v) if (r + d) % v in inside and (s + d) % v in inside), -1)
    if (shift < 0).any():
        raise ValueError("not a difference cover")
    return shift


SHIFT = _check_cover()


def words_at(data: np.ndarray, at: np.ndarray, offset: int) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; places may not run over the padded end."""
    view = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    return np.ascontiguousarray(view[at + offset]).view(">u8").ravel().astype(np.uint64)


def split(order: np.ndarray, first: np.ndarray, key_of) -> None:
    """Sorts the members of each tie by a key, in place; first marks where a tie begins. Ties of one key aren't moved."""
    tied = np.flatnonzero(~first | ~np.append(first[1:], True))
    if not len(tied):
        return
    k, f = key_of(order[tied]), first[tied]
    differs = np.zeros(len(tied), bool)
    differs[1:] = ~f[1:] & (k[1:] != k[:-1])
    if not differs.any():
        return
    tie = np.cumsum(f) - 1
    uneven = np.zeros(tie[-1] + 1, bool)
    uneven[tie[differs]] = True
    which = uneven[tie]
    at, k, tie = tied[which], k[which], tie[which]
    move = np.lexsort((k, tie))
    order[at] = order[at][move]
    k = k[move]
    first[at[1:]] |= (k[1:] != k[:-1]) | (tie[1:] != tie[:-1])


class SuffixBlock:
    """Suffixes of a block of bytes, sorted by their first ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int = LENGTH):
        self.length = length
        self.data = np.concatenate((data, np.zeros(length + 2 * COVER_MODULUS + 8, np.uint8)))
        self.depths: dict[int, np.ndarray] = {}

    def precompute(self, at: np.ndarray) -> None:
        """Ranks of the cover suffixes at the given places, which ascend, by as many bytes as a shift leaves of ``length``."""
        order, first, self.at = np.arange(len(at)), np.zeros(len(at), bool), at
        first[:1] = True
        lowest = (self.length - (COVER_MODULUS - 1)) // 8 * 8
        for depth in range(8, self.length // 8 * 8 + 1, 8):
            split(order, first, lambda o, d=depth: words_at(self.data, at[o], d - 8))
            if depth >= lowest:
                rank = np.empty(len(at), np.uint32)
                rank[order] = np.cumsum(first)
                self.depths[depth] = rank

    def _tie_key(self, at: np.ndarray, shift: np.ndarray) -> np.ndarray:
        depth = (self.length - shift) // 8 * 8
        out = np.empty(len(at), np.uint32)
        for d in np.unique(depth).tolist():
            which = depth == d
            out[which] = self.depths[d][np.searchsorted(self.at, (at + shift)[which])]
        return out

    def sort(self, starts: np.ndarray, bucket: np.ndarray, aligned: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(order, first): starts in bucket and suffix order, and where a class of equal strings begins.

        aligned: equal strings are known to start at equal residues, so the shift of one residue serves each tie.
        """
        v, residue = COVER_MODULUS, starts % COVER_MODULUS
        if aligned:
            shift = SHIFT[residue, residue]
            self.precompute(np.unique(starts + shift))
        else:
            near = np.unique((starts[:, None] + np.arange(v)).ravel())
            self.precompute(near[np.isin(near % v, COVER)])
        order = np.argsort(bucket, kind="stable")
        first = np.ones(len(starts), bool)
        first[1:] = bucket[order][1:] != bucket[order][:-1]
        edges = np.append(np.flatnonzero(first), len(starts))
        a = 0
        while a < len(starts):  # one bucket at a time, small ones together
            b = int(edges[min(np.searchsorted(edges, a + BUCKET, "right"), len(edges) - 1)])
            b = b if b > a else int(edges[np.searchsorted(edges, a, "right")])
            self._sort_bucket(starts, residue, order[a:b], first[a:b], aligned)
            a = b
        return order, first

    def _sort_bucket(self, starts: np.ndarray, residue: np.ndarray, order: np.ndarray, first: np.ndarray, aligned: bool) -> None:
        if aligned:
            split(order, first, lambda o: residue[o])
        for d in range(0, COVER_MODULUS, 8):
            split(order, first, lambda o, d=d: words_at(self.data, starts[o], d))
        if aligned:
            split(order, first, lambda o: self._tie_key(starts[o], SHIFT[residue[o], residue[o]]))
            split(order, first, lambda o: words_at(self.data, starts[o], self.length - 8))
            return
        # any two suffixes of a tie are compared at the shift that takes both into the cover
        edges = np.append(np.flatnonzero(first), len(order))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:
                tie = sorted(order[a:b].tolist(), key=cmp_to_key(lambda x, y: self._compare(int(starts[x]), int(starts[y]))))
                order[a:b] = tie
                for i in range(1, b - a):
                    first[a + i] = self._compare(int(starts[tie[i - 1]]), int(starts[tie[i]])) != 0

    def _compare(self, x: int, y: int) -> int:
        d = int(SHIFT[x % COVER_MODULUS, y % COVER_MODULUS])
        held = self.depths[(self.length - d) // 8 * 8]
        a, b = (int(held[np.searchsorted(self.at, k + d)]) for k in (x, y))
        if a == b:
            a, b = self.data[x + self.length - 8 : x + self.length].tobytes(), self.data[y + self.length - 8 : y + self.length].tobytes()
        return (a > b) - (a < b)


def later(block: SuffixBlock, starts: np.ndarray, bucket: np.ndarray, owner: np.ndarray, place: np.ndarray, aligned: bool = False) -> np.ndarray:
    """Marks the starts whose string also starts at a smaller (owner, place)."""
    if not len(starts):
        return np.zeros(0, bool)
    order, first = block.sort(starts, bucket, aligned)
    size = np.diff(np.append(np.flatnonzero(first), len(order)))
    out = np.zeros(len(starts), bool)
    if size.max() == 1:
        return out
    number = np.repeat(np.arange(len(size)), size)
    several = size[number] > 1
    o, c = order[several], number[several]
    o = o[np.lexsort((place[o], owner[o], c))]
    head = np.concatenate(([True], c[1:] != c[:-1]))
    lead = o[np.maximum.accumulate(np.where(head, np.arange(len(o)), 0))]
    out[o] = (owner[o] > owner[lead]) | (place[o] > place[lead])
    return out


def anchor_runs(data: np.ndarray, valid: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts that share an anchor: (from, to, place, hash). valid marks the starts of whole strings.

    The anchor is the first of the k-grams in the string with the least 40 bits of hash, so it depends on the string only.
    Grams of a period of up to PERIOD bytes (lines of dashes, zeros) have larger hashes than all others: they recur at every
    start, and as anchors would make runs of one start each.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64)
    out = []
    width, piece = length - gram + 1, 1 << 20
    for base in range(0, len(data) - length + 1, piece):
        part = data[base : base + piece + length - 1]
        n = len(part) - gram + 1
        words = np.lib.stride_tricks.as_strided(np.concatenate((part, np.zeros(8, np.uint8))), (len(part) + 1, 8), (1, 1))
        words = np.ascontiguousarray(words).view("<u8").ravel()
        h = np.zeros(n, np.uint64)
        for o in range(0, gram, 8):
            h = (h ^ words[o : o + n]) * _K
            h ^= h >> np.uint64(29)
        h = mix(h) >> np.uint64(1)
        for q in range(1, min(PERIOD, gram - 8) + 1):  # a gram that is a short thing over and over comes after all others
            same = np.ones(n, bool)
            for o in {*range(0, gram - q - 8, 8), gram - q - 8}:
                same &= words[o : n + o] == words[o + q : n + o + q]
            h[same] |= np.uint64(1 << 63)
        least = (h & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
        step = 1
        while step * 2 <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < width:
            least = np.minimum(least[: step - width], least[width - step :])
        place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        ok = np.flatnonzero(valid[base : base + len(place)])
        if not len(ok):
            continue
        begin = np.concatenate(([True], (ok[1:] != ok[:-1] + 1) | (place[ok[1:]] != place[ok[:-1]])))
        a = ok[begin]
        e = np.append(ok[np.flatnonzero(begin)[1:] - 1], ok[-1]) + 1
        out.append((a + base, e + base, place[a] + base, h[place[a]]))
    if not out:
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def laid(data: np.ndarray, start: np.ndarray, stop: np.ndarray, before: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Copies the strings that start in [start, stop) of each run, anchors at multiples of v; (bytes, where each run begins)."""
    size = stop - start + length - 1
    room = -(-(size + COVER_MODULUS - 1) // COVER_MODULUS) * COVER_MODULUS
    begin = np.cumsum(room) - room + (-before) % COVER_MODULUS
    out = np.zeros(int(room.sum()), np.uint8)
    step = 1 << 15
    for i in range(0, len(start), step):  # a bounded number of bytes is copied at a time
        s, z, b = start[i : i + step], size[i : i + step], begin[i : i + step]
        within = np.arange(int(z.sum())) - np.repeat(np.cumsum(z) - z, z)
        out[np.repeat(b, z) + within] = data[np.repeat(s, z) + within]
    return out, begin


def ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range of each."""
    n = stop - start
    which = np.repeat(np.arange(len(n)), n)
    return np.repeat(start, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n), which


def late_runs(data: np.ndarray, begin: np.ndarray, n: np.ndarray, before: np.ndarray, number: np.ndarray, owner: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, starts) of the runs of starts in pieces whose string also starts earlier.

    Pieces of one anchor number are compared; numbers are taken in turn, so only some suffixes are laid out at a time.
    """
    order = np.argsort(number, kind="stable")
    order = order[np.bincount(number)[number[order]] > 1]
    load, out, i = np.cumsum(n[order], dtype=np.int64), [], 0

    def told(o: np.ndarray, skip: np.ndarray, size: np.ndarray, group: np.ndarray) -> None:
        """Compares size starts of each piece o, from its start skip on, within groups."""
        block, at0 = laid(data, begin[o] + skip, begin[o] + skip + size, before[o].astype(np.int64) - skip, length)
        at, which = ranges(at0, at0 + size)
        late = later(SuffixBlock(block, length), at, group[which], owner[o][which], (place[o] + skip)[which] + at - at0[which], aligned=True)
        a, e, w = runs_of((at - at0[which])[late], which[late])
        out.append((o[w], a + skip[w], e - a))

    while i < len(order):
        j = max(i + 1, int(np.searchsorted(load, (load[i - 1] if i else 0) + BUCKET, "right")))
        if j < len(order):  # to the end of the last number
            j = int(np.searchsorted(number[order], number[order[j - 1]], "right"))
        o = order[i:j]
        i = j
        if n[o].sum() <= 2 * BUCKET:
            told(o, np.zeros(len(o), np.int64), n[o].astype(np.int64), number[o])
            continue
        # one number has more: its starts one by one, parts of its strings at a time
        skip, which = ranges(np.zeros(len(o), np.int64), n[o].astype(np.int64))
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        part = np.empty(len(skip), np.uint16)
        for k in range(0, len(skip), BUCKET):
            part[k : k + BUCKET] = string_keys(padded, (begin[o][which[k : k + BUCKET]] + skip[k : k + BUCKET]), length) % np.uint64(min(65_535, len(skip) // BUCKET + 1))
        for k in range(int(part.max()) + 1):
            some = np.flatnonzero(part == k)
            if len(some):
                told(o[which[some]], skip[some], np.ones(len(some), np.int64), number[o][which[some]])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none)


def runs_of(at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive numbers of one group in a list that ascends within groups: (from, to, group)."""
    if not len(at):
        return at, at, group
    begin = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (group[1:] != group[:-1])))
    last = np.append(np.flatnonzero(begin)[1:] - 1, len(at) - 1)
    return at[begin], at[last] + 1, group[begin]


def string_keys(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the strings of ``length`` bytes at the given places; data must be padded by 8 bytes."""
    out = np.full(len(at), length, np.uint64)
    for o in [*range(0, length - 8, 8), length - 8]:
        out = mix(out * _K + words_at(data, at, o))
    return out


class Pack:
    """The texts of a pack in the order of (id, text)."""

    def __init__(self, rows: pa.Table, length: int):
        keys, texts = rows["id"].to_pylist(), rows["text"].to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0, texts[i]))
        self.ids, self.texts = [keys[i] for i in order], [texts[i] for i in order]
        self.owner = np.array([NO_ID if k is None else k for k in self.ids], np.int64)
        self.offset = np.concatenate(([0], np.cumsum([len(t) for t in self.texts], dtype=np.int64)))
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.order, self.length = order, length

    def runs(self, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, anchor's place, anchor, row) of all runs of starts that share an anchor, less ``steps``, which are kept aside.

        ``steps``: starts whose string also starts a step before in the same text, where the step is that from the anchor of the
        run before to an equal one. They are late, and what they repeat is there, so nothing else need look at them;
        of a text that is one short thing over and over only the first starts are left.
        """
        valid = np.zeros(len(self.data), bool)
        for i, t in enumerate(self.texts):
            if len(t) >= self.length:
                valid[self.offset[i] : self.offset[i + 1] - self.length + 1] = True
        start, stop, place, anchor = anchor_runs(self.data, valid, self.length, gram)
        row = np.searchsorted(self.offset, start, "right") - 1
        step = np.diff(place, prepend=place[:1])
        again = step > 0
        again[1:] &= (start[1:] == stop[:-1]) & (anchor[1:] == anchor[:-1]) & (row[1:] == row[:-1])
        self.steps = np.zeros(0, np.int64)
        if not again.any():
            return start, stop, place, anchor, row
        padded, late, rest = np.concatenate((self.data, np.zeros(8, np.uint8))), [], []
        runs = np.flatnonzero(again)
        load = np.cumsum((stop - start)[runs])
        cuts = np.unique(np.concatenate(([0], np.searchsorted(load, np.arange(BUCKET, int(load[-1]), BUCKET)), [len(runs)])))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at, which = ranges(start[runs[a:b]], stop[runs[a:b]])
            which = runs[a + which]
            back = at - step[which]
            same = np.flatnonzero(back >= self.offset[row[which]])
            for o in [*range(0, self.length - 8, 8), self.length - 8]:
                same = same[words_at(padded, at[same], o) == words_at(padded, back[same], o)]
            late.append(at[same])
            other = np.ones(len(at), bool)
            other[same] = False
            rest.append(runs_of(at[other], which[other]))
        self.steps = np.concatenate(late)
        from_, to, which = (np.concatenate(x) for x in zip(*rest, strict=True))
        first = np.concatenate((start[~again], from_))
        order = np.argsort(first, kind="stable")
        which = np.concatenate((np.flatnonzero(~again), which))[order]
        return first[order], np.concatenate((stop[~again], to))[order], place[which], anchor[which], row[which]

    def copies(self, known: set[bytes]) -> list[int]:
        """The rows that repeat an earlier text as a whole, of this pack or, by their digests, of others."""
        out, first = [], {}
        for i, t in enumerate(self.texts):
            if len(t) >= self.length and (self.owner[first.setdefault(t, i)] != self.owner[i] or (known and hashlib.md5(t).digest() in known)):
                out.append(i)
        return out


#: A row is a piece (kind 0), the bytes of n starts with one key, or a mark (kind 1), n starts of a pack's row that are not the first of their strings.
_ROWS = "kind int, key long, share int, pack long, row int, owner long, start int, n int, before int, data binary"
_ROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("share", pa.int32()), ("pack", pa.int64()), ("row", pa.int32()), ("owner", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("before", pa.int32()), ("data", pa.binary())])


def _rows(count: int, **columns: np.ndarray | pa.Array | int) -> pa.RecordBatch:
    """Rows; a number stands for a column of it, what isn't given is null."""

    def column(f: pa.Field) -> pa.Array:
        v = columns.get(f.name)
        return pa.nulls(count, f.type) if v is None else v if isinstance(v, pa.Array) else pa.array(np.full(count, v) if np.isscalar(v) else v).cast(f.type)

    return pa.RecordBatch.from_arrays([column(f) for f in _ROW], schema=_ROW)


def _marks(pack: np.ndarray | int, row: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return _rows(len(row), kind=1, key=mix(np.full(len(row), pack).astype(np.uint64) * _K + row.astype(np.uint64)).view(np.int64), share=-1, pack=pack, row=row, start=start, n=n)


def _binaries(data: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _digests(length: int) -> Callable[[pa.Table], pa.Array]:
    """Of a pack: the digest of each different text that is long enough, with its least id."""

    def run(rows: pa.Table) -> pa.Array:
        least: dict[bytes, int] = {}
        for k, t in zip(rows["id"].to_pylist(), rows["text"].to_pylist(), strict=True):
            if len(t) >= length:
                d, k = hashlib.md5(t).digest(), NO_ID if k is None else k
                least[d] = min(k, least.get(d, k))
        return pa.array([[{"digest": d, "id": k} for d, k in least.items()]], pa.list_(pa.struct([("digest", pa.binary()), ("id", pa.int64())])))

    return run


def _compared(pieces: DataFrame, length: int) -> DataFrame:
    """Marks of the starts that are not the first of their strings among the pieces of one key and share; other marks pass.

    Where a key's pieces are in several shares (share is not -1), a piece that is first in its share comes again, with none.
    """

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        of = {c: rows[c].to_numpy() for c in ("key", "share", "pack", "row", "owner", "start", "n", "before")}
        rows = rows.combine_chunks()
        column = rows["data"].chunk(0) if rows["data"].num_chunks else pa.array([], pa.binary())
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.nbytes else np.zeros(0, np.uint8)
        begin = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column)].astype(np.int64)
        number = np.cumsum(np.concatenate(([True], (of["key"][1:] != of["key"][:-1]) | (of["share"][1:] != of["share"][:-1])))) - 1
        piece, at, n = late_runs(data, begin, of["n"].astype(np.int64), of["before"], number, of["owner"], of["start"].astype(np.int64), length)
        if len(piece):
            yield _marks(of["pack"][piece], of["row"][piece], of["start"][piece] + at, n)
        again = of["share"] >= 0
        again[piece] = False
        if again.any():
            survivors = rows.filter(pa.array(again))
            yield from survivors.set_column(2, _ROW.field("share"), pa.array(np.full(len(survivors), -1, np.int32))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, starts = [], 0
        for b in batches:
            b = pa.RecordBatch.from_arrays(b.columns, schema=_ROW)
            is_mark = pc.equal(b.column("kind"), 1)
            yield b.filter(is_mark)
            b = b.filter(pc.invert(is_mark))
            held.append(b)
            starts += int(pc.sum(b.column("n")).as_py() or 0)
            if starts > BUCKET:  # all but the last key's pieces, which may go on
                t = pa.Table.from_batches(held)
                key, share = t["key"].to_numpy(), t["share"].to_numpy()
                new = np.flatnonzero((key[1:] != key[:-1]) | (share[1:] != share[:-1]))
                if len(new):
                    cut = int(new[-1]) + 1
                    yield from told(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
                    starts = int(pc.sum(t["n"].slice(cut)).as_py())
        if any(b.num_rows for b in held):
            yield from told(pa.Table.from_batches(held))

    parts = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return pieces.repartition(parts, "key", "share").sortWithinPartitions("key", "share").mapInArrow(run, _ROWS)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, pack_bytes: int = PACK_BYTES, with_text: bool = False, carry: list[str] | None = None, most_runs: int = MOST_RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text, edges][, row]) of each text.

    kept_text: the remaining bytes, less those left of a cut code point; edges: where removed ranges begin and end; row: a struct of columns to carry along.
    """
    tune(docs.sparkSession)
    carried = [F.struct(*carry).alias("row")] if carry else []
    kind_of_row = f", row {docs.select(*carried).schema[0].dataType.simpleString()}" if carry else ""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), *carried)
    packs = written(bundled(texts, pack_bytes, _digests(length), "array<struct<digest:binary,id:long>>"))
    n_packs, size = packs.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    level = Exchange.of(n_packs, size // ANCHOR_BYTES, most=ANCHORS, fan_in=fan_in)
    shares = -(-n_packs // most_runs)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                keys, n = np.unique(Pack(unbundled(data.as_py()), length).runs(gram)[3], return_counts=True)
                yield from level.messages(name, keys, mix(keys), n)

    sent = packs.select("pack", "data").mapInArrow(anchors, "cell long, unit long, keys binary, counts binary")
    told = totals(sent, level, fan_in).select(F.col("unit").alias("pack"), "family", F.col("data").alias("told"))
    # of equal texts, packs learn which are not the corpus' first
    same = packs.select("pack", F.explode("also").alias("t")).select("pack", "t.digest", "t.id")
    least = same.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("digest", "least")
    told = told.union(same.join(least, "digest").filter("id > least").select("pack", F.lit(-1).cast("long"), F.col("digest")))

    def first_look(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """A pack's own repeats, and the pieces that other packs may have too."""
        name, pack = key[0].as_py(), Pack(unbundled(left["data"][0].as_py()), length)
        family, data = right["family"].to_pylist(), right["told"].to_pylist()
        out = []
        whole = pack.copies({d for f, d in zip(family, data, strict=True) if f < 0})
        if whole:
            out.append(_marks(name, np.array(whole), np.zeros(len(whole), np.int64), np.array([len(pack.texts[i]) - length + 1 for i in whole])))
        start, stop, place, anchor, row = pack.runs(gram)
        keys, number, n = np.unique(anchor, return_inverse=True, return_counts=True)
        runs = level.totals_of(keys, mix(keys), {f: d for f, d in zip(family, data, strict=True) if f >= 0})
        if len(pack.steps):
            a, e, w = runs_of(pack.steps, np.searchsorted(pack.offset, pack.steps, "right") - 1)
            out.append(_marks(name, w, a - pack.offset[w], e - a))
        looked = ~np.isin(row, whole)
        start, stop, place, row, number = (x[looked] for x in (start, stop, place, row, number))
        is_open = np.ones(len(pack.data), bool)
        piece, offset, k = late_runs(pack.data, start, stop - start, place - start, number, pack.owner[row], start - pack.offset[row], length)
        if len(piece):
            at, _ = ranges(start[piece] + offset, start[piece] + offset + k)
            is_open[at] = False
            out.append(_marks(name, row[piece], start[piece] + offset - pack.offset[row[piece]], k))
        away = np.flatnonzero((runs > n)[number])
        at, which = ranges(start[away], stop[away])
        fine = is_open[at]
        a, e, w = runs_of(at[fine], which[fine])
        w = away[w]
        hot = runs[number[w]] > most_runs
        single, of_hot = ranges(a[hot], e[hot])
        padded = np.concatenate((pack.data, np.zeros(8, np.uint8)))
        for from_, n_starts, run, hashes, share in ((a[~hot], (e - a)[~hot], w[~hot], keys[number[w[~hot]]], -1), (single, np.ones(len(single), np.int64), w[hot][of_hot], string_keys(padded, single, length), -1 if shares <= 1 else int(mix(np.array([name], np.uint64))[0] % np.uint64(shares)))):
            load = np.cumsum(n_starts + length - 1)
            cuts = np.unique(np.concatenate(([0], np.searchsorted(load, np.arange(BATCH_BYTES, int(load[-1]) if len(load) else 0, BATCH_BYTES)), [len(load)])))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                f, m, u = from_[i:j], n_starts[i:j], run[i:j]
                r, bytes_of = row[u], m + length - 1
                source, _ = ranges(f, f + bytes_of)
                out.append(_rows(len(r), kind=0, key=hashes[i:j].view(np.int64), share=share, pack=name, row=r, owner=pack.owner[r], start=f - pack.offset[r], n=m, before=place[u] - f, data=_binaries(pack.data[source], bytes_of)))
        return pa.Table.from_batches(out, schema=_ROW)

    pieces = packs.select("pack", "data").groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(first_look, _ROWS)
    marks = _compared(pieces, length)
    if shares > 1:  # the first ones of shares meet
        marks = written(marks)
        marks = marks.filter("kind = 1").union(_compared(marks.filter("kind = 0"), length))
    marks = marks.select("pack", "row", "start", "n")

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        table = unbundled(left["data"][0].as_py())
        pack = Pack(table, length)
        change = np.zeros(len(pack.data) + 1, np.int32)
        row, start, n = (right[c].to_numpy() for c in ("row", "start", "n"))
        at = pack.offset[row] + start
        np.add.at(change, at, 1)
        np.add.at(change, at + n + length - 1, -1)
        gone = np.cumsum(change)[:-1] > 0
        rows = []
        for i, t in enumerate(pack.texts):
            mask = gone[pack.offset[i] : pack.offset[i + 1]]
            removed = int(mask.sum())
            kept = t if not removed else pack.data[pack.offset[i] : pack.offset[i + 1]][~mask].tobytes()
            edge = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0])).astype(np.int8)))
            rows.append((pack.ids[i], len(t), removed, len(edge) // 2, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None, edge.tolist() if with_text else None))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "edges"][: 7 if with_text else 5]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
        out = pa.table({k: pa.array(c, t) for k, c, t in zip(names, zip(*rows, strict=True), kinds, strict=False)})
        return out.append_column("row", nullable(table["row"].take(pa.array(pack.order)))) if carry else out

    extra = ", kept_text string, edges array<long>" if with_text else ""
    return packs.select("pack", "data").groupBy("pack").cogroup(marks.groupBy("pack")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + extra + kind_of_row)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows with the repeated passages cut from their texts; bytes left of a cut code point go with it."""
    found = repeats(docs, with_text=True, carry=[c for c in docs.columns if c != "text"])
    return found.select(*(F.col("kept_text").alias("text") if c == "text" else F.length("kept_text").cast("long").alias("n_chars") if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns))

