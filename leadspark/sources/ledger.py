"""A Spark data source with commits: rows of runs in files that count only once a manifest names them.

A write has two phases. Each task writes a file of its own under a name that no one else uses, and hands it on; the driver then
writes one manifest, which makes all files visible at once. A batch of a stream is an epoch: its manifest has the epoch in
its name, so an epoch that is played again finds the manifest there, and its files are removed. A failed task or job leaves
no manifest, so nothing of it is seen. The table is a folder of any file system that Arrow opens (a path, file://,
hdfs://, s3://), reached by driver and executors alike.

    spark.dataSource.register(Ledger)
    df.write.format("lead_ledger").option("path", folder).mode("append").save()
    stream.writeStream.format("lead_ledger").option("path", folder).option("checkpointLocation", ...).start()
    spark.read.format("lead_ledger").option("path", folder).load().filter("run_id = 'r1'")
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of run_id and domain, an event's time, kind and payload.
LEDGER = "run_id string, domain string, t_ms long, kind string, payload string"
#: Columns whose least and largest value in a file the manifest holds.
RANGED = ["run_id", "domain", "t_ms", "kind"]
#: Files are closed beyond so many rows.
FILE_ROWS = 1_000_000


@dataclass
class Part:
    """A file: its name, its rows, and (least, largest, nulls) of each ranged column."""

    name: str
    rows: int
    ranges: dict[str, tuple]


@dataclass
class Written(WriterCommitMessage):
    parts: list[Part] = field(default_factory=list)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _ranges(table: pa.Table) -> dict[str, tuple]:
    out = {}
    for c in RANGED:
        least = pa.compute.min_max(table[c]).as_py() if table.num_rows else {"min": None, "max": None}
        out[c] = (least["min"], least["max"], table[c].null_count)
    return out


class _Writing:
    """What the writers of tables and of streams share."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _opened(self.path)
        store.create_dir(f"{root}/data", recursive=True)
        done, held, n = Written(), [], 0

        def close() -> None:
            table = pa.Table.from_batches(held)
            name = f"{uuid.uuid4().hex}.parquet"
            with store.open_output_stream(f"{root}/data/{name}") as to:
                pq.write_table(table, to)
            done.parts.append(Part(name, table.num_rows, _ranges(table)))

        for b in iterator:
            held.append(b)
            n += b.num_rows
            if n >= FILE_ROWS:
                close()
                held, n = [], 0
        if n:
            close()
        return done

    def _drop(self, messages: Iterable) -> None:
        store, root = _opened(self.path)
        for m in messages:
            for p in m.parts if m is not None else []:
                store.delete_file(f"{root}/data/{p.name}")

    def _commit(self, messages: list, name: str) -> bool:
        """Makes the files visible under a manifest of that name; False, and the files go, if it is there already."""
        store, root = _opened(self.path)
        store.create_dir(f"{root}/log", recursive=True)
        at = f"{root}/log/{name}.json"
        if store.get_file_info(at).type != fs.FileType.NotFound:
            self._drop(messages)
            return False
        parts = [vars(p) for m in messages if m is not None for p in m.parts]
        replaced = [i.base_name for i in _manifests(store, root)] if self.overwrite else []
        draft = f"{root}/log/.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as to:
            to.write(json.dumps({"parts": parts, "replaces": replaced}).encode())
        store.move(draft, at)  # the only step that shows anything
        return True


class _TableWriter(_Writing, DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        super().__init__(path, overwrite)
        self.job = uuid.uuid4().hex

    def commit(self, messages: list) -> None:
        self._commit(messages, f"job-{self.job}")

    def abort(self, messages: list) -> None:
        self._drop(messages)


class _StreamWriter(_Writing, DataSourceStreamArrowWriter):
    """query: names the stream, so that several may write to one table."""

    def __init__(self, path: str, query: str):
        super().__init__(path)
        self.query = query

    def commit(self, messages: list, batchId: int) -> None:
        self._commit(messages, f"epoch-{self.query}-{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:
        self._drop(messages)


def _manifests(store: fs.FileSystem, root: str) -> list[fs.FileInfo]:
    found = store.get_file_info(fs.FileSelector(f"{root}/log", allow_not_found=True))
    return sorted((i for i in found if i.base_name.endswith(".json")), key=lambda i: i.base_name)


def visible(path: str) -> list[Part]:
    """The files that manifests name, less those of manifests that a later one replaces."""
    store, root = _opened(path)
    logs = {}
    for i in _manifests(store, root):
        with store.open_input_stream(i.path) as f:
            logs[i.base_name] = json.loads(f.read())
    gone = {name for log in logs.values() for name in log["replaces"]}
    return [Part(p["name"], p["rows"], {c: tuple(r) for c, r in p["ranges"].items()}) for name, log in logs.items() if name not in gone for p in log["parts"]]


def vacuum(path: str) -> int:
    """Deletes the files that no manifest names: what failed writers have left. Only to be called while nobody writes."""
    store, root = _opened(path)
    named = {p.name for p in visible(path)}
    left = [i for i in store.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)) if i.base_name not in named]
    for i in left:
        store.delete_file(i.path)
    return len(left)


_TESTS = {EqualTo: "==", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class _Reader(DataSourceReader):
    """One partition for each file that may have rows; filters on ranged columns prune files and rows."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.names, self.tests = path, schema.fieldNames(), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            kind = _TESTS.get(type(f))
            if kind and len(f.attribute) == 1 and f.attribute[0] in RANGED and f.value is not None:
                self.tests.append((f.attribute[0], kind, f.value))  # done here, so Spark need not do it again
            else:
                yield f

    def _may_have(self, part: Part) -> bool:
        for column, kind, value in self.tests:
            low, high, _ = part.ranges[column]
            if low is None:  # nulls only, and none passes a comparison
                return False
            fits = {"==": lambda: low <= value <= high, "in": lambda: any(low <= v <= high for v in value if v is not None), ">": lambda: high > value, ">=": lambda: high >= value, "<": lambda: low < value, "<=": lambda: low <= value}
            if not fits[kind]():
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p.name) for p in visible(self.path) if self._may_have(p)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:
            return
        store, root = _opened(self.path)
        of = {"==": lambda c, v: c == v, "in": lambda c, v: c.isin(list(v)), ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v}
        test = None
        for column, kind, value in self.tests:
            one = of[kind](pads.field(column), value)
            test = one if test is None else test & one
        yield from pads.dataset(f"{root}/data/{partition.value}", filesystem=store, format="parquet").to_batches(columns=self.names, filter=test)


class Ledger(DataSource):
    """Options: path, and for streams query (a name; ``stream`` if there is none)."""

    @classmethod
    def name(cls) -> str:
        return "lead_ledger"

    def schema(self) -> str:
        return LEDGER

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _TableWriter(self.options["path"], overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options["path"], self.options.get("query", "stream"))
