"""Byte-level BPE by prefix dynamic programming.

For a piece of bytes and a merge-rank vocabulary, every prefix has exactly one encoding that BPE gives, and that
encoding is fixed by its last token: drop the token and what is left is the encoding of a shorter prefix. So one number
for each prefix is enough. The last token of a prefix is the one token that ends there and may follow the last token of
the prefix before it; two tokens may stand next to each other if BPE, given their joined bytes, gives the two back.
Appending bytes only adds prefixes, and an edit keeps all prefixes before it and, from where the tokens fall together
again, all behind it, so both re-encode near the edit only (``PrefixEncoder.append`` and ``.replace``).

Texts are cut by the vocabulary's pattern first and each match is encoded by itself. Different pieces of some texts are
encoded once; encodings of short pieces are kept in a table of bounded size. Long texts go through in parts.

Defined cases: a null text is encoded like the empty one: no tokens, the digests of no bytes. Repeated rows are encoded
each on its own. Other columns are left out and may have any names; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, tune


class Vocabulary:
    """Tokens by rank, with the tests that the dynamic programme needs."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token: list[bytes] = [b""] * (max(self.rank.values()) + 1)
        for t, i in self.rank.items():
            self.token[i] = t
        self.longest = max(map(len, self.rank))
        self.text = [str(i) for i in range(len(self.token))]
        self.size = [len(t) for t in self.token]
        # finds the tokens that end at each byte (bytes stand as the code points of the same number)
        self.ends = ahocorasick.Automaton()
        for t, i in self.rank.items():
            self.ends.add_word(t.decode("latin-1"), (i, len(t)))
        self.ends.make_automaton()
        self.split: list[tuple[int, int] | None] = [None] * len(self.token)
        self.pairs: dict[int, bool] = {}

    def parts(self, t: int) -> tuple[int, int]:
        """The two tokens that BPE merges last to make the token; (-1, -1) for single bytes and tokens it can't make."""
        if (known := self.split[t]) is None:
            b, known = self.token[t], (-1, -1)
            seq = [b[i : i + 1] for i in range(len(b))]
            while len(seq) > 1:
                best = min(range(len(seq) - 1), key=lambda i: (self.rank.get(seq[i] + seq[i + 1], 1 << 60), i))
                if (seq[best] + seq[best + 1]) not in self.rank:
                    break
                if len(seq) == 2:
                    known = (self.rank[seq[0]], self.rank[seq[1]])
                seq[best : best + 2] = [seq[best] + seq[best + 1]]
            self.split[t] = known
        return known

    def reachable(self, t: int) -> bool:
        """Does BPE give this one token for the token's own bytes?"""
        return len(self.token[t]) == 1 or self.parts(t)[0] >= 0

    def may_follow(self, a: int, b: int) -> bool:
        """Does BPE of the joined bytes give exactly (a, b)? Undoes merges at the border, latest first, looking for one that would have crossed it."""
        key = a << 32 | b
        if (known := self.pairs.get(key)) is not None:
            return known
        rank, token, split, parts = self.rank.get, self.token, self.split, self.parts
        left, right, limit, ok = a, b, 1 << 60, self.reachable(b)
        while ok:
            across = rank(token[left] + token[right])
            if across is not None and across < limit:
                ok = False
                break
            of_left, of_right = (split[left] or parts(left))[1], (split[right] or parts(right))[0]
            if of_left < 0 and of_right < 0:  # single bytes meet: nothing left to undo
                break
            if of_right < 0 or (of_left >= 0 and left > right):  # the later merge of the two is undone first
                limit, left = left, of_left
            else:  # of equal ranks, the one further left is merged first
                limit, right = right + 1, of_right
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def encode_piece(self, data: bytes) -> list[int]:
        """``PrefixEncoder(self, data).ids()`` in one go, for the many pieces that are never edited."""
        known, may_follow, size_of = self.pairs.get, self.may_follow, self.size
        size = len(data)
        last = [-2] * (size + 1)
        last[0] = -1
        for at, (t, n) in self.ends.iter(data.decode("latin-1")):
            at += 1
            if last[at] != -2:
                continue
            before = last[at - n]
            if before < 0:
                if at == n and self.reachable(t):
                    last[n] = t
                continue
            ok = known(before << 32 | t)
            if ok or (ok is None and may_follow(before, t)):
                last[at] = t
        out = []
        while size:
            out.append(t := last[size])
            size -= size_of[t]
        out.reverse()
        return out


class PrefixEncoder:
    """One piece of bytes with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> PrefixEncoder:
        """Exact for any bytes: earlier prefixes stay as they are."""
        v, last, pairs = self.v, self.last, self.v.pairs
        start = len(self.data)
        self.data = self.data + more
        off = max(0, start + 1 - v.longest)
        last += [-2] * len(more)
        for at, (t, n) in v.ends.iter(self.data[off:].decode("latin-1")):
            end = at + 1 + off
            if last[end] != -2 or end <= start:
                continue
            before = last[end - n]
            if before < 0:
                ok = end == n and v.reachable(t)
            elif (ok := pairs.get(before << 32 | t)) is None:
                ok = v.may_follow(before, t)
            if ok:
                last[end] = t
        return self

    def replace(self, start: int, stop: int, new: bytes) -> PrefixEncoder:
        """The encoding after data[start:stop] has become ``new``.

        Prefixes up to ``start`` are reused. A prefix's last token depends on the bytes and last tokens of no more than the
        longest token before it, so once that many prefixes behind the edit have the tokens that they had, all the rest have.
        """
        tail, held, window = self.data[stop:], self.last[stop:], self.v.longest
        self.data = self.data[:start]
        del self.last[start + 1 :]
        self.append(new)
        self.reencoded, at = len(new), 0
        while at < len(tail) and not (at >= window and self.last[-window:] == held[at - window + 1 : at + 1]):
            self.append(tail[at : at + window])
            at = min(len(tail), at + window)
            self.reencoded += window
        self.data += tail[at:]
        self.last += held[at + 1 :]
        return self

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            t = self.last[at]
            out.append(t)
            at -= len(self.v.token[t])
        return out[::-1]


class Pieces:
    """Encodings of pieces in two generations of bounded size; long pieces aren't kept.

    When the young generation is full it becomes the old one, and what was old and not used since is dropped; so pieces
    in steady use are never encoded anew.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = 250_000, longest: int = 64):
        self.v, self.most, self.longest = vocabulary, most, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, pieces: set[str]) -> dict[str, bytes]:
        """The token ids of each piece, four bytes each."""
        young, old, rank = self.young, self.old, self.v.rank
        out = {p: ids for p in pieces if (ids := young.get(p)) is not None}
        fresh = sorted(pieces.difference(out))  # neighbours have prefixes and so tokens in common
        for p in fresh:
            if (ids := old.pop(p, None)) is None:
                data = p.encode()
                t = rank.get(data)
                ids = array("I", (t,) if t is not None else self.v.encode_piece(data)).tobytes()
            out[p] = ids
            if len(p) <= self.longest:
                young[p] = ids
        if len(young) > self.most:
            self.old, self.young = young, {}
        return out

    def trim(self) -> None:
        self.old = {}


class Tokenizer:
    #: Pieces that are looked up together.
    CHUNK = 500_000

    def __init__(self, path: str, pattern: str):
        self.v = Vocabulary(path)
        self.pieces, self.pattern = Pieces(self.v), regex.compile(pattern)

    def _cut(self, texts: Iterable[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
        """(number of the text, some of its pieces), as many as make a chunk; a long text comes in several."""
        held, size = [], 0
        for i, text in enumerate(texts):
            found = (m[0] for m in self.pattern.finditer(text)) if text and len(text) > self.CHUNK else self.pattern.findall(text or "")
            found = iter(found) if not isinstance(found, list) else found
            parts = iter(lambda it=found: list(islice(it, self.CHUNK)), []) if not isinstance(found, list) else [found]
            for part in parts:
                held.append((i, part))
                size += len(part)
                if size >= self.CHUNK:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def encoded(self, texts: Iterable[str | None]) -> Iterator[tuple[int, list[int]]]:
        """(number of the text, some of its token ids), in order; each text comes at least once."""
        for held in self._cut(texts):
            ids = self.pieces.of(set().union(*(part for _, part in held))).__getitem__
            for i, part in held:
                yield i, array("I", b"".join(map(ids, part))).tolist()

    def encode(self, text: str | None) -> list[int]:
        return [t for _, ids in self.encoded([text]) for t in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.token.__getitem__, ids))


_HELD: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """The worker's tokenizer of a vocabulary file."""
    if (path, pattern) not in _HELD:
        _HELD[path, pattern] = Tokenizer(path, pattern)
    return _HELD[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids]) of each text. path: a rank file that every executor can open."""
    tune(docs.sparkSession)
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        as_text = t.v.text.__getitem__
        gc.disable()  # nothing here makes cycles, and each collection would walk the tables
        try:
            for b in batches:
                rows = b.num_rows
                n, in_ids, in_bytes, all_ids = [0] * rows, [hashlib.sha256() for _ in range(rows)], [hashlib.sha256() for _ in range(rows)], [[] if with_ids else None for _ in range(rows)]
                for i, ids in t.encoded(x.as_py() for x in b.column(1)):
                    if ids:
                        in_ids[i].update(("," * (n[i] > 0) + ",".join(map(as_text, ids))).encode())
                        in_bytes[i].update(t.decode(ids))
                        n[i] += len(ids)
                    if with_ids:
                        all_ids[i] += ids
                out = [b.column(0), pa.array(n, pa.int64()), pa.array([h.hexdigest() for h in in_ids], pa.string()), pa.array([h.hexdigest() for h in in_bytes], pa.string())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids, names=["k", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)
        finally:
            gc.enable()
            t.pieces.trim()  # a worker outlives the task; other stages need the room

    return spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids).withColumnRenamed("k", key)
