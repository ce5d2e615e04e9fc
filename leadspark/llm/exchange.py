"""Totals of keys over packs of documents, with bounded tasks and messages in proportion to the input.

A pack (a few MB of texts) has a sorted array of distinct 64-bit keys and their counts, and wants each key's total over all
packs, without anyone holding all keys. Keys are dealt into families by other bits than the key's own, so a key is told
apart by its family and 64 bits. A pack sends one message to each family that it has keys of; a family's task adds the
messages up and answers each in the order of its keys. A frequent key is one entry a pack, however often it occurs.

With many packs that would make messages tiny and a frequent key's family large. So at most about ``FAN_IN`` packs meet in a
cell (a family's share of the packs), which bounds a cell to ``ENTRIES`` or so and the messages of a pack to a constant;
cells are then packs themselves, with their keys added up, and meet in the same way one level up (``Exchange.up``). Totals
come down the same path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, mix, packed, unpacked, written

#: Entries that come together in a task, about; packs of which a cell may hear.
ENTRIES, FAN_IN = 2_000_000, 16_384

#: Messages that a worker gives at once.
_ROWS = 256
_SENT = "cell long, unit long, keys binary, counts binary"
_TOLD = "unit long, family long, data binary, kinds long, total long"
_TOLD_SCHEMA = pa.schema([("unit", pa.int64()), ("family", pa.int64()), ("data", pa.binary()), ("kinds", pa.int64()), ("total", pa.int64())])


def shut_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, byte plane by byte plane, since high bytes hardly change from one to the next."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8).T.tobytes())


def open_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def shut_counts(values: np.ndarray) -> bytes:
    """Counts as bytes, with a list of those that don't fit."""
    large = np.flatnonzero(values > 254)
    return zstandard.ZstdCompressor(level=1).compress(packed(np.minimum(values, 255).astype(np.uint8), large.astype(np.uint32), values[large].astype(np.uint64)))


def open_counts(data: bytes) -> np.ndarray:
    small, at, large = unpacked(zstandard.ZstdDecompressor().decompress(data), "u1", "u4", "u8")
    out = small.astype(np.int64)
    out[at] = large.astype(np.int64)
    return out


def _batches(schema: str, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    names = [c.split() for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    for i in range(0, len(rows), _ROWS):
        columns = zip(*rows[i : i + _ROWS], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def _sums(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of some messages, their sums, and for each message where its keys are among the distinct ones."""
    keys = [open_keys(x) for r in rows for x in r.column("keys").to_pylist()]
    counts = [open_counts(x) for r in rows for x in r.column("counts").to_pylist()]
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(number, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    return distinct, sums, np.split(number, np.cumsum([len(k) for k in keys])[:-1])


@dataclass(frozen=True)
class Exchange:
    """One level: ``families`` of keys, numbered from ``first``, each in ``cells`` shares of the packs."""

    cells: int
    families: int
    first: int = 0

    @classmethod
    def of(cls, packs: int, entries: int, first: int = 0, most: int = ENTRIES, fan_in: int = FAN_IN) -> Exchange:
        """For that many packs with so many entries in all."""
        cells = max(1, -(-packs // fan_in))
        return cls(cells, max(1, -(-entries // (cells * most))), first)

    def up(self, fan_in: int = FAN_IN) -> Exchange:
        """The level above, where the cells of a family are the packs and its keys are split so far that tasks hold as much as here."""
        cells = max(1, -(-self.cells // fan_in))
        return Exchange(cells, -(-self.cells // cells))

    def under(self, family: int) -> Exchange:
        """The families of this level that a family of the level below is split into."""
        return replace(self, first=family * self.families)

    def dealt(self, keys: np.ndarray, deal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, families, stops): an order by (family, key), the families that occur, and where each ends in it."""
        family = (deal % np.uint64(self.families)).astype(np.int64)
        order = np.lexsort((keys, family))
        stops = np.cumsum(np.bincount(family, minlength=self.families))
        there = np.flatnonzero(np.diff(stops, prepend=0))
        return order, there, stops[there]

    def _cell_of(self, family: int, unit: int) -> int:
        share = int(mix(np.array([unit], np.int64).view(np.uint64))[0] % np.uint64(self.cells))
        return (self.first + family) * self.cells + share

    def messages(self, unit: int, keys: np.ndarray, deal: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What a pack sends: a row (cell, unit, keys, counts) for each family that it has keys of."""
        order, there, stops = self.dealt(keys, deal)
        rows, a = [], 0
        for f, z in zip(there.tolist(), stops.tolist(), strict=True):
            o = order[a:z]
            rows.append((self._cell_of(f, unit), unit, shut_keys(keys[o]), shut_counts(counts[o])))
            a = z
        return _batches(_SENT, rows)

    def totals_of(self, keys: np.ndarray, deal: np.ndarray, told: dict[int, bytes]) -> np.ndarray:
        """A pack's totals in the order of its keys, from the answers by family."""
        order, there, stops = self.dealt(keys, deal)
        out, a = np.zeros(len(keys), np.int64), 0
        for f, z in zip(there.tolist(), stops.tolist(), strict=True):
            out[order[a:z]] = open_counts(told[self.first + f])
            a = z
        return out


def _by_cell(sent: DataFrame, parts: int) -> DataFrame:
    """One cell after another. Cells are of one size, so they are dealt in turn: by hash, some tasks would get several times as many as others."""
    return sent.repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell")


def totals(sent: DataFrame, level: Exchange, fan_in: int = FAN_IN, height: int = 1) -> DataFrame:
    """(unit, family, data, kinds, total): for each message of the level the totals of its keys.

    kinds and total, the distinct keys of a family with a count and their sum, stand in one row of the family, else 0.
    Several exchanges over the same packs may answer together, their families numbered apart.
    """
    parts = max(int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    if level.cells == 1:

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for family, rows in groups(batches, "cell"):
                units = [u for r in rows for u in r.column("unit").to_pylist()]
                _, sums, where = _sums(rows)
                stats = (int((sums > 0).sum()), int(sums.sum()))
                yield from _batches(_TOLD, [(u, family, shut_counts(sums[w]), *(stats if i == 0 else (0, 0))) for i, (u, w) in enumerate(zip(units, where, strict=True))])

        return _by_cell(sent, parts).mapInArrow(add_up, _TOLD)

    sent, above = written(sent), level.up(fan_in)

    def deal(keys: np.ndarray) -> np.ndarray:
        return mix(keys + np.uint64(height))  # other bits at each level

    def raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in groups(batches, "cell"):
            distinct, sums, _ = _sums(rows)
            yield from above.under(cell // level.cells).messages(cell, distinct, deal(distinct), sums)

    def lowered(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], schema=_TOLD_SCHEMA)
        cell, units = key[0].as_py(), left.column("unit").to_pylist()
        distinct, _, where = _sums(left.to_batches())
        found = above.under(cell // level.cells).totals_of(distinct, deal(distinct), dict(zip(right.column("family").to_pylist(), right.column("data").to_pylist(), strict=True)))
        stats = tuple(sum(right.column(c).to_pylist()) for c in ("kinds", "total"))
        return pa.Table.from_batches(list(_batches(_TOLD, [(u, cell // level.cells, shut_counts(found[w]), *(stats if i == 0 else (0, 0))) for i, (u, w) in enumerate(zip(units, where, strict=True))])), schema=_TOLD_SCHEMA)

    higher = totals(_by_cell(sent, parts).mapInArrow(raised, _SENT), above, fan_in, height + 1).withColumnRenamed("unit", "cell")
    return sent.groupBy("cell").cogroup(higher.groupBy("cell")).applyInArrow(lowered, _TOLD)


def stats_of(told: DataFrame, first: int, families: int) -> tuple[int, int]:
    """(kinds, total) of the keys of some families."""
    r = told.filter((F.col("family") >= first) & (F.col("family") < first + families)).agg(F.sum("kinds"), F.sum("total")).first()
    return int(r[0] or 0), int(r[1] or 0)
