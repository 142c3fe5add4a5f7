"""Files of fixed-length records as the data source `fixedrec`.

Read: every regular file directly inside the given folders (or named itself), in
path order; missing folders are skipped; a trailing partial record is dropped.
Large files are cut in slices of whole records, and small ones are packed, so a task
reads about as many bytes as any other, from one file or many.

Write: partition i of the written frame becomes worker_{i+1}/partition.1, .2, ...
of at most records-per-file records each; an empty partition writes no file. Appended
files are numbered on from the greatest there. A
task writes under a name of its attempt, and the driver renames on commit, so
failed and repeated tasks leave nothing behind; what is overwritten is moved aside
first and deleted last. Folders must be visible to all
executors under the same path.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..config import SortConfig
from ..operators.sort import choose_pivots, sort_records

#: Bytes that a task reads at most, what opening a file counts for, and records of one Arrow batch.
SLICE_BYTES, OPEN_BYTES, BATCH = 64 << 20, 1 << 18, 1 << 16


def normalised_paths(paths: Sequence[str]) -> list[str]:
    """Real paths in the order given, without repeats."""
    return list(dict.fromkeys(os.path.realpath(p.removeprefix("file://")) for p in paths))


def list_files(paths: Sequence[str]) -> list[str]:
    """Regular files directly inside the folders (not below), or the files named, sorted by path."""
    found = []
    for p in normalised_paths(paths):
        if os.path.isdir(p):
            with os.scandir(p) as entries:
                found += [e.path for e in entries if e.is_file()]
        elif os.path.isfile(p):
            found.append(p)
    return sorted(found)


def record_count(paths: Sequence[str], record_length: int = 100) -> int:
    """Whole records in all bytes of all files together, from their sizes alone."""
    return sum(os.path.getsize(f) for f in list_files(paths)) // record_length


def whole_record_count(paths: Sequence[str], record_length: int = 100) -> int:
    """Records that a scan returns: whole ones of each file."""
    return sum(os.path.getsize(f) // record_length for f in list_files(paths))


@dataclass
class Slice(InputPartition):
    """Pieces (path, first record, records) that one task reads."""

    pieces: list


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fields: list[str]):
        self.paths = json.loads(options["paths"]) if "paths" in options else [p for p in options.get("path", "").split(",") if p]
        self.length = int(options.get("recordlength", 100))
        self.key = int(options.get("keylength", 10))
        self.most = int(options["maxrecords"]) if "maxrecords" in options else None
        self.head = int(options["headrecords"]) if "headrecords" in options else None
        self.tasks = max(1, int(options.get("parallelism", 1)))
        self.fields = fields
        if self.length <= 0 or not 0 < self.key <= self.length:
            raise ValueError("recordLength must be positive and keyLength between 1 and recordLength")

    def _files(self) -> Iterator[tuple[str, int]]:
        """Files and the records that are wanted of each: the first `most` of all, the first `head` of each path given."""
        left = self.most
        for group in [[p] for p in self.paths] if self.head is not None else [self.paths]:
            own = self.head
            for f in list_files(group):
                n = os.path.getsize(f) // self.length
                n = min([n, *(x for x in (left, own) if x is not None)])
                left = None if left is None else left - n
                own = None if own is None else own - n
                if n:
                    yield f, n

    def partitions(self) -> Sequence[InputPartition]:
        files = list(self._files())
        total = sum(n * self.length + OPEN_BYTES for _, n in files)
        most = max(self.length, min(SLICE_BYTES, max(OPEN_BYTES, total // self.tasks)))
        out: list[list] = []
        room = 0
        for f, n in files:
            at = 0
            while at < n:
                if room < self.length:
                    out.append([])
                    room = most
                take = min(n - at, max(1, room // self.length))
                out[-1].append((f, at, take))
                at += take
                room -= take * self.length + OPEN_BYTES
        return [Slice(x) for x in out] or [Slice([])]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        for path, start, count in part.pieces:
            with open(path, "rb", buffering=128 << 10) as f:
                f.seek(start * self.length)
                done = 0
                while done < count:
                    n = min(BATCH, count - done)
                    data = f.read(n * self.length)
                    n = len(data) // self.length
                    if not n:
                        break
                    yield self._batch(data[: n * self.length], n, path, start + done)
                    done += n

    def _batch(self, data: bytes, n: int, path: str, first: int) -> pa.RecordBatch:
        # One buffer of fixed-width values; no record is touched one by one.
        whole = pa.Array.from_buffers(pa.binary(self.length), n, [None, pa.py_buffer(data)])
        columns = {"record": lambda: whole.cast(pa.binary()), "key": lambda: self._cut(data, n, 0, self.key), "value": lambda: self._cut(data, n, self.key, self.length), "path": lambda: pa.array([path] * n), "pos": lambda: pa.array(range(first, first + n), pa.int64())}
        return pa.RecordBatch.from_arrays([columns[f]() for f in self.fields], names=self.fields)

    def _cut(self, data: bytes, n: int, lo: int, hi: int) -> pa.Array:
        import numpy as np

        cut = np.frombuffer(data, np.uint8).reshape(n, self.length)[:, lo:hi]
        return pa.Array.from_buffers(pa.binary(hi - lo), n, [None, pa.py_buffer(np.ascontiguousarray(cut).tobytes())]).cast(pa.binary())


@dataclass
class _Written(WriterCommitMessage):
    worker: int
    files: list
    records: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.out = os.path.realpath(options["path"].removeprefix("file://"))
        length, chunk = int(options.get("recordlength", 100)), int(options.get("chunkbytes", 32 << 20))
        self.config = SortConfig(record_length=length, key_length=min(10, length), chunk_bytes=chunk, file_prefix=options.get("prefix", "partition."))
        self.per_file = self.config.records_per_file
        self.column = schema.fieldNames().index("record") if "record" in schema.fieldNames() else 0
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex
        if overwrite:
            for p in json.loads(options.get("inputs", "[]")):
                real = os.path.realpath(p)
                if os.path.commonpath([real, self.out]) == self.out:
                    raise ValueError(f"input {p} lies inside the output {self.out}, which would be deleted")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        temp = os.path.join(self.out, f"_temp-{self.job}", f"{context.partitionId()}-{context.taskAttemptId()}")
        files: list[str] = []
        total = room = 0
        now = None
        try:
            for b in batches:
                column = b.column(self.column)
                at = 0
                while at < len(column):
                    if not room:
                        if now:
                            now.close()
                        os.makedirs(temp, exist_ok=True)
                        files.append(os.path.join(temp, f"{self.config.file_prefix}{len(files) + self.config.first_file}"))
                        now, room = open(files[-1], "wb", buffering=128 << 10), self.per_file  # noqa: SIM115
                    part = column.slice(at, min(room, len(column) - at))
                    data = b"".join(part.to_pylist()) if part.null_count else self._bytes(part)
                    if len(data) != len(part) * self.config.record_length:
                        raise ValueError(f"every record must have {self.config.record_length} bytes")
                    now.write(data)
                    at, room, total = at + len(part), room - len(part), total + len(part)
        finally:
            if now:
                now.close()
        return _Written(context.partitionId() + 1, files, total)

    @staticmethod
    def _bytes(part: pa.Array) -> bytes:
        """The values of a binary column one behind the other: a slice of its buffer."""
        import numpy as np

        kind = np.int64 if pa.types.is_large_binary(part.type) else np.int32
        offsets = np.frombuffer(part.buffers()[1], kind)[part.offset : part.offset + len(part) + 1]
        return part.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes() if len(part) else b""

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        temp, old = (os.path.join(self.out, f"_{kind}-{self.job}") for kind in ("temp", "old"))
        os.makedirs(self.out, exist_ok=True)
        if self.overwrite:
            os.makedirs(old)
            for name in os.listdir(self.out):
                if name not in (os.path.basename(temp), os.path.basename(old)):
                    os.replace(os.path.join(self.out, name), os.path.join(old, name))
        for m in messages:
            if m and m.files:
                to = os.path.join(self.out, f"worker_{m.worker}")
                os.makedirs(to, exist_ok=True)
                first = self._greatest(to) + 1
                for k, f in enumerate(m.files):
                    os.rename(f, os.path.join(to, f"{self.config.file_prefix}{first + k}"))
        shutil.rmtree(old, ignore_errors=True)
        shutil.rmtree(temp, ignore_errors=True)

    def _greatest(self, folder: str) -> int:
        """The greatest file number in a folder, or what comes before the first."""
        prefix = self.config.file_prefix
        numbers = [x.removeprefix(prefix) for x in os.listdir(folder) if x.startswith(prefix)]
        return max((int(x) for x in numbers if x.isdigit()), default=self.config.first_file - 1)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(os.path.join(self.out, f"_temp-{self.job}"), ignore_errors=True)


class FixedRecDataSource(DataSource):
    """Options: path (comma-separated) or paths (JSON), recordLength, keyLength, columns, maxRecords; to write: chunkBytes, prefix, inputs."""

    @classmethod
    def name(cls) -> str:
        return "fixedrec"

    def schema(self) -> StructType:
        kinds = {"record": BinaryType(), "key": BinaryType(), "value": BinaryType(), "path": StringType(), "pos": LongType()}
        names = [x.strip() for x in self.options.get("columns", "record").split(",")]
        return StructType([StructField(n, kinds[n]) for n in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()}, schema.fieldNames())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer({k.lower(): v for k, v in self.options.items()}, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FixedRecDataSource)


def read_records(spark: SparkSession, paths: Sequence[str], config: SortConfig | None = None, columns: str = "record", max_records: int | None = None, head_records: int | None = None) -> DataFrame:
    """Records of all files of the folders. columns: record, key, value, path and pos, those that are needed.

    max_records: the first so many of all; head_records: the first so many of each folder, and no others are read.
    """
    config = config or SortConfig()
    register(spark)
    reader = spark.read.format("fixedrec").option("paths", json.dumps(list(paths))).option("columns", columns)
    reader = reader.option("recordLength", config.record_length).option("keyLength", config.key_length)
    reader = reader.option("parallelism", spark.sparkContext.defaultParallelism)
    reader = reader if head_records is None else reader.option("headRecords", head_records)
    return (reader if max_records is None else reader.option("maxRecords", max_records)).load()


def write_records(df: DataFrame, path: str, config: SortConfig | None = None, inputs: Iterable[str] = (), overwrite: bool = True) -> None:
    """df's column record as files; df's partitions are the workers."""
    config = config or SortConfig()
    register(df.sparkSession)
    writer = df.write.format("fixedrec").option("recordLength", config.record_length).option("chunkBytes", config.chunk_bytes)
    writer.option("prefix", config.file_prefix).option("inputs", json.dumps(list(inputs))).mode("overwrite" if overwrite else "append").save(path)


def read_sorted(spark: SparkSession, path: str, config: SortConfig | None = None) -> DataFrame:
    """worker, file, pos (from 0) and record of a written output."""
    folders = sorted(os.path.join(path, d) for d in os.listdir(path) if d.startswith("worker_")) if os.path.isdir(path) else []
    df = read_records(spark, folders, config, "record,path,pos")
    part = lambda p: F.regexp_extract("path", p, 1).cast("int")
    return df.select(part(r"worker_(\d+)/").alias("worker"), part(r"\.(\d+)$").alias("file"), "pos", "record")


def sort_files(spark: SparkSession, inputs: Sequence[str], output: str, partitions: int, *, strategy: str | None = None, seed: int = 42, config: SortConfig | None = None) -> int:
    """Sorts the records of the input folders into `partitions` key ranges below output; returns how many there were.

    strategy: head (the default with simple_sampling), bernoulli (the default without), hash or exact.
    The number of records comes from the files' sizes. Raises if the number written differs from it.
    """
    config = config or SortConfig()
    strategy = strategy or ("head" if config.simple_sampling else "bernoulli")
    inputs = normalised_paths(inputs)
    before = whole_record_count(inputs, config.record_length)
    if strategy == "head":
        heads = read_records(spark, inputs, config, "key", head_records=config.head_records)
        points = choose_pivots(heads, "key", partitions, "bernoulli", seed=seed, config=config)
    else:
        points = choose_pivots(read_records(spark, inputs, config, "key"), "key", partitions, strategy, seed=seed, total=before, config=config)
    df = read_records(spark, inputs, config, "key,record")
    write_records(sort_records(df, "key", partitions, pivots=points, config=config).select("record"), output, config, inputs)
    after = sum(whole_record_count([os.path.join(output, d)], config.record_length) for d in os.listdir(output))
    if before != after:
        raise RuntimeError(f"{before} records were read and {after} written")
    return after
