"""A resumable row source: Parquet files read in their order, in micro-batches of a set size.

Offsets are (file, row, rows so far) and stand in Spark's own offset log; a batch is planned
from one offset to the next, cut into tasks, and read by the executors.  What was read but not
committed is planned again with the same ends, so the consumed place is that of the last
commit (``consumed``), however far reading had come.  A file that fails is opened again at
the row reached, ``attempts`` times, after 1, 2, 4 and at most 8 times ``pause`` seconds.  A
source that ends is an error, never begun again, unless ``exhausted`` is ``wait``.

    spark.dataSource.register(RowSource)
    spark.readStream.format("brindle_rows").schema(s).option("checkpoint", c).load(folder)

Options: ``path`` (a Parquet file or a folder of them, in a file system that pyarrow knows),
``checkpoint`` (the query's, where a restart finds its place), ``rows`` a batch, ``task_rows``
a task, ``attempts``, ``pause``, ``exhausted`` and ``opener``, the dotted name of a function
from a path to an open file.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

EXHAUSTED = "the source is exhausted"
SLOWEST = 8


def located(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path there."""
    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)


def open_file(path: str):
    """A file of any file system that pyarrow knows by its address."""
    system, at = located(path)
    return system.open_input_file(at)


def listed(path: str) -> list[tuple[str, int]]:
    """Address and size of the Parquet files, in the order of their names."""
    system, at = located(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    lead = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted((lead + x.path, x.size) for x in found if x.type == fs.FileType.File and x.base_name.endswith(".parquet") and not x.base_name.startswith(("_", ".")))


@dataclass
class Piece(InputPartition):
    """Rows ``low`` to ``high`` of a file."""

    path: str
    low: int
    high: int

    def __init__(self, path: str, low: int, high: int):
        super().__init__((path, low, high))
        self.path, self.low, self.high = path, low, high


class RowReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options):
        self.names = schema.names
        self.rows, self.task_rows = int(options.get("rows", 1_000_000)), int(options.get("task_rows", 100_000))
        self.attempts, self.pause = int(options.get("attempts", 3)), float(options.get("pause", 1.0))
        self.wait = options.get("exhausted", "error") == "wait"
        module, _, name = options.get("opener", f"{__name__}.open_file").rpartition(".")
        self.module, self.opener = module, name
        self.files = listed(options["path"])
        self.listing = hashlib.sha256(json.dumps(self.files).encode()).hexdigest()
        self.counts: dict[int, int] = {}
        self.at = last_planned(options["checkpoint"], self.listing) or self.initialOffset()

    def open(self, path: str):
        return getattr(importlib.import_module(self.module), self.opener)(path)

    def retried(self, work, reached=lambda: None):
        """What ``work`` gives; tried again while it fails and at most ``attempts`` times without
        getting further."""
        failed, before = 0, reached()
        while True:
            try:
                return work()
            except (OSError, EOFError):
                failed = 1 if reached() != before else failed + 1
                before = reached()
                if failed >= self.attempts:
                    raise
                time.sleep(min(SLOWEST, 2 ** (failed - 1)) * self.pause)

    def count(self, i: int) -> int:
        """Rows of a file, from its footer."""
        if i not in self.counts:
            self.counts[i] = self.retried(lambda: pq.ParquetFile(self.open(self.files[i][0])).metadata.num_rows)
        return self.counts[i]

    def offset(self, file: int, row: int, rows: int) -> dict:
        return {"listing": self.listing, "file": file, "row": row, "rows": rows}

    def initialOffset(self) -> dict:
        return self.offset(0, 0, 0)

    def latestOffset(self) -> dict:
        """The end of the next batch: so many rows after the last planned one."""
        file, row, want = self.at["file"], self.at["row"], self.rows
        while file < len(self.files) and want >= self.count(file) - row:
            want, file, row = want - (self.count(file) - row), file + 1, 0
        if file < len(self.files):
            row, want = row + want, 0
        if want == self.rows and not self.wait:
            raise EOFError(f"{EXHAUSTED} after {self.at['rows']} rows")
        return self.offset(file, row, self.at["rows"] + self.rows - want)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        if {start["listing"], end["listing"]} != {self.listing}:
            raise ValueError("the files aren't those that the cursor was saved for")
        self.at, pieces = end, []
        for i in range(start["file"], min(end["file"] + 1, len(self.files))):
            low, high = start["row"] if i == start["file"] else 0, end["row"] if i == end["file"] else self.count(i)
            pieces += [Piece(self.files[i][0], k, min(high, k + self.task_rows)) for k in range(low, high, self.task_rows)]
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        reached = partition.low

        def rest() -> Iterator[pa.RecordBatch]:
            """The rows from ``reached`` on; row groups that lie elsewhere aren't decoded."""
            file, first, groups = pq.ParquetFile(self.open(partition.path)), 0, []
            for g in range(file.metadata.num_row_groups):
                after = first + file.metadata.row_group(g).num_rows
                if after > reached and first < partition.high:
                    groups.append((first, g))
                first = after
            at = groups[0][0] if groups else 0
            for batch in file.iter_batches(row_groups=[g for _, g in groups], columns=self.names):
                low, high = max(0, reached - at), min(len(batch), partition.high - at)
                at += len(batch)
                if low < high:
                    yield batch.slice(low, high - low).select(self.names)

        batches = rest()
        while reached < partition.high:

            def step():
                nonlocal batches
                try:
                    return next(batches)
                except (OSError, EOFError):
                    batches = rest()
                    raise

            batch = self.retried(step, lambda: reached)
            reached += len(batch)
            yield batch

    def commit(self, end: dict) -> None:
        """Spark's commit log has the place; nothing of it is kept here."""


class RowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "brindle_rows"

    def streamReader(self, schema: StructType) -> RowReader:
        return RowReader(schema, self.options)


def numbered(folder: str) -> dict[int, str]:
    """The entries of one of Spark's metadata logs: batch and path."""
    system, at = located(folder)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return {}
    return {int(x.base_name): x.path for x in system.get_file_info(fs.FileSelector(at)) if x.base_name.isdigit()}


def _offset_in(checkpoint: str, log: str, listing: str | None) -> dict | None:
    """The offset of this source in an entry of the offset log: version, metadata, offsets."""
    with located(checkpoint)[0].open_input_file(log) as entry:
        offsets = map(_parsed, entry.read().decode().splitlines()[2:])
    return next((x for x in offsets if isinstance(x, dict) and "listing" in x and listing in (None, x["listing"])), None)


def _parsed(line: str):
    try:
        return json.loads(line)
    except ValueError:
        return None


def last_planned(checkpoint: str, listing: str) -> dict | None:
    """The end of the last batch in the offset log: it was committed or will be run again."""
    logs = numbered(f"{checkpoint}/offsets")
    if not logs:
        return None
    found = _offset_in(checkpoint, logs[max(logs)], listing)
    if found is None:
        raise ValueError("the files aren't those that the cursor was saved for")
    return found


def consumed(checkpoint: str) -> int:
    """Rows up to the last batch that was committed."""
    done, logs = numbered(f"{checkpoint}/commits"), numbered(f"{checkpoint}/offsets")
    return _offset_in(checkpoint, logs[max(done)], None)["rows"] if done else 0


def rows_stream(spark: SparkSession, path: str, schema, checkpoint: str, **options) -> DataFrame:
    """The stream of a table's rows in their order."""
    spark.dataSource.register(RowSource)
    return spark.readStream.format(RowSource.name()).schema(schema).options(checkpoint=checkpoint, **options).load(path)
