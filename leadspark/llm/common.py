"""Shared pieces of the corpus operators: word rules, cached word hashes, block keys and tables cut off from their lineage.

Word rules work on UTF-8 bytes: only A-Z are lower-cased, and the separators of both rules are ASCII, so no code point is split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.components import stored as written  # noqa: F401  (for the operators)

#: Rows of one Arrow batch; with it, a batch of texts stays far below a worker's memory.
BATCH_ROWS = 512
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Every ASCII byte that is not a-z or 0-9 separates words of the alphanumeric rule.
_ALNUM = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; none for null."""
    return text.encode().lower().translate(_ALNUM).split() if text else []


def space_words(text: str | None, lower: bool = True) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; A-Z lower-cased on demand; none for null."""
    if not text:
        return []
    return text.encode().lower().split() if lower else text.encode().split()


class WordHashes(dict):
    """64-bit hash of each word, kept up to a bound of entries."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit keys over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, since one row may be a very long text; a session that has set a size of its own keeps it."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def spread(docs: DataFrame) -> DataFrame:
    """The rows over all cores, where a scan comes in fewer partitions than there are cores; plans with shuffles stay as they are."""
    ran, cores = docs._jdf.queryExecution(), docs.sparkSession.sparkContext.defaultParallelism
    if ran.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec" or ran.toRdd().getNumPartitions() >= cores:
        return docs
    return docs.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, schema.field(k).type) for k, c in columns.items()], schema=schema)


def crc_bucket(doc_id: str, buckets: int) -> F.Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.expr(f"pmod(crc32(cast(cast({doc_id} as string) as binary)), {buckets})")


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one value."""
    return b"".join(np.int64(len(a)).tobytes() + a.tobytes() for a in arrays)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for k in kinds:
        n = int(np.frombuffer(data, np.int64, 1, at)[0])
        out.append(np.frombuffer(data, k, n, at + 8))
        at += 8 + n * np.dtype(k).itemsize
    return out


def groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of one key after another, from batches that are sorted by it."""
    now, held = None, []
    for batch in batches:
        keys = np.asarray(batch.column(by))
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            k = int(keys[i])
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append(batch.slice(i, j - i))
    if held:
        yield now, held


#: Stands for a null id among 64-bit ids; it comes before all others.
NO_ID = -(1 << 63)


def bundled(docs: DataFrame, most: int, also: Callable[[pa.Table], pa.Array] | None = None, kind: str = "") -> DataFrame:
    """(pack, n_bytes, data[, also]): the rows with a column ``text``, run by run, as compressed tables with about ``most`` bytes of text each.

    A pack is a run of a partition's rows, so it has its size whatever the ids are. To be written before use, since packs
    are numbered by task. also: a further column, of the given type, made from each pack.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def told() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_table(rows.combine_chunks())
            columns = {"pack": pa.array([(task << 32) + made], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())}
            return pa.RecordBatch.from_pydict(columns | ({"also": also(rows)} if also else {}))

        for b in batches:
            n = np.asarray(pc.fill_null(pc.binary_length(b.column("text")), 0), np.int64)
            at = 0
            while at < b.num_rows:
                whole = size + np.cumsum(n[at:])
                cut = int(np.searchsorted(whole, most)) + 1
                held.append(b.slice(at, cut))
                at, size = at + cut, int(whole[min(cut, len(whole)) - 1])
                if size >= most:
                    yield told()
                    made, held, size = made + 1, [], 0
        if held:
            yield told()

    return spread(docs).mapInArrow(run, "pack long, n_bytes long, data binary" + (f", also {kind}" if also else ""))


def unbundled(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def nullable(column: pa.ChunkedArray) -> pa.ChunkedArray:
    """The structs with all fields nullable, as the declared type has them."""

    def of(t: pa.DataType) -> pa.DataType:
        if pa.types.is_struct(t):
            return pa.struct([pa.field(f.name, of(f.type)) for f in t])
        return pa.list_(of(t.value_type)) if pa.types.is_list(t) else t

    return column.cast(of(column.type))
