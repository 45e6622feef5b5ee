"""Token ids as Arrow files of equal-length sequences, a Spark data source for both ways.

A part file `part-*.arrow` is an Arrow IPC file whose batches have two fixed-size lists: `ids` (unsigned, of `length`
entries) and `mask` (0 filling, 1 token, 2 last token of a document). Rows have equal length, so row r's ids are the
entries from r * length on of one buffer of a memory-mapped file: random access copies nothing. `docs-*.arrow` beside
it, an Arrow stream, says which ids belong to which document. Documents lie in ascending doc_id order, file after file
as `_files.json` lists them; only the end of a file is filled up.

Task attempts write files of new names, and the commit names those that count, so lost or repeated tasks do no harm.
Paths are opened with pyarrow.fs, which knows local and shared folders, HDFS, S3 and GCS.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import lean, new_path, pieces, strings
from .tokens import default_path, encoder

LENGTH = 2048
END = 1
#: Rows of a batch, and ids that a read batch holds at most (but for one document that is longer).
ROWS, READ = 256, 1 << 19
LISTING = "_files.json"


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    name: str
    first: int
    documents: int
    ids: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, length: int, tokenizer: str, end: int):
        self.path, self.length, self.tokenizer, self.end = path, length, tokenizer, end
        self.dtype = np.dtype("<u2" if max(encoder(tokenizer).size, end + 1) <= 1 << 16 else "<u4")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        number = TaskContext.get().partitionId()
        name = f"{number:06d}-{uuid.uuid4().hex}.arrow"
        kind = pa.from_numpy_dtype(self.dtype)
        schema = pa.schema([("ids", pa.list_(kind, self.length)), ("mask", pa.list_(pa.uint8(), self.length))])
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        first, documents, total = 0, 0, 0
        rest = np.zeros(0, self.dtype), np.zeros(0, np.uint8)
        sink = None

        def batch(ids: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=schema)

        for given in iterator:
            for x in pieces(iter([given]), "text", 1 << 20):
                if sink is None:
                    first = x.column(0)[0].as_py() or 0
                    out, docs = system.open_output_stream(f"{root}/part-{name}"), system.open_output_stream(f"{root}/docs-{name}")
                    sink, listing = pa.ipc.new_file(out, schema), pa.ipc.new_stream(docs, index)
                parts = encoder(self.tokenizer)(strings(x.column(1)))
                n = np.array([len(p) + 1 for p in parts], np.int64)
                ends = np.cumsum(n)
                tail = np.array([self.end], self.dtype)
                ids = np.concatenate([y for p in parts for y in (p.astype(self.dtype), tail)])
                mask = np.ones(len(ids), np.uint8)
                mask[ends - 1] = 2
                listing.write_batch(pa.record_batch([x.column(0), pa.array(total + ends - n), pa.array(n)], schema=index))
                documents, total = documents + len(n), total + len(ids)
                rest = np.concatenate((rest[0], ids)), np.concatenate((rest[1], mask))
                whole = len(rest[0]) // self.length * self.length
                for i in range(0, whole, ROWS * self.length):
                    j = min(whole, i + ROWS * self.length)
                    sink.write_batch(batch(rest[0][i:j], rest[1][i:j]))
                rest = rest[0][whole:], rest[1][whole:]
        if sink is not None:
            if len(rest[0]):
                fill = self.length - len(rest[0])
                sink.write_batch(batch(np.pad(rest[0], (0, fill)), np.pad(rest[1], (0, fill))))
            for x in (sink, out, listing, docs):
                x.close()
        return _Part(number, name, first, documents, total)

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m is not None and m.documents), key=lambda m: m.partition)
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        listed = {"length": self.length, "dtype": self.dtype.str, "files": [[p.name, p.documents, p.ids] for p in parts]}
        with system.open_output_stream(f"{root}/{LISTING}") as f:
            f.write(json.dumps(listed).encode())

    def abort(self, messages: list) -> None:
        system, root = _opened(self.path)
        for m in messages:
            if m is not None and m.documents:
                for kind in ("part", "docs"):
                    system.delete_file(f"{root}/{kind}-{m.name}")


@dataclass
class _File(InputPartition):
    name: str
    start: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        listed = listing(self.path)
        found, start = [], 0
        for name, _, ids in listed["files"]:
            found.append(_File(name, start))
            start += ids
        return found or [_File("", 0)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, root = _opened(self.path)
        sequences = Sequences(system, f"{root}/part-{partition.name}")
        with system.open_input_stream(f"{root}/docs-{partition.name}") as f, pa.ipc.open_stream(f) as docs:
            for x in docs:
                n = x.column(2).to_numpy()
                part = (np.cumsum(n) - n) // READ
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(n)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        continue
                    own = n[a:b]
                    begin = x.column(1)[a].as_py()
                    ids = sequences.ids(begin, begin + int(own.sum()))
                    offsets = pa.array((4 * np.concatenate(([0], np.cumsum(own)))).astype(np.int32))
                    raw = pa.Array.from_buffers(pa.binary(), len(own), [None, offsets.buffers()[1], pa.py_buffer(ids.astype("<u4"))])
                    yield pa.record_batch([x.column(0).slice(a, b - a), pa.array(partition.start + x.column(1).to_numpy()[a:b]), pa.array(own), raw], names=["doc_id", "start", "n_tokens", "ids"])


class Sequences:
    """Random access to one part file: a row's ids and mask, or ids of a range, without reading the rest."""

    def __init__(self, system, path: str):
        from pyarrow import fs

        self._file = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self._reader = pa.ipc.open_file(self._file)
        self.length = self._reader.schema.field("ids").type.list_size
        counts, at = [], 0
        for i in range(self._reader.num_record_batches):
            counts.append(at)
            at += self._reader.get_batch(i).num_rows
        self._at, self.rows = np.array([*counts, at]), at

    def row(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of a row, views of the mapped file."""
        i = int(np.searchsorted(self._at, r, side="right")) - 1
        x, k = self._reader.get_batch(i), r - int(self._at[i])
        return tuple(x.column(c).values.to_numpy()[k * self.length : (k + 1) * self.length] for c in (0, 1))

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from `begin` to `end`, counted over the file."""
        out, size = [], self.length
        while begin < end:
            i = int(np.searchsorted(self._at, begin // size, side="right")) - 1
            base = int(self._at[i]) * size
            values = self._reader.get_batch(i).column(0).values.to_numpy()
            out.append(values[begin - base : end - base])
            begin = base + len(values)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


class TokenSequences(DataSource):
    """`spark.read.format("token_sequences")` and `df.write.format("token_sequences")`; options length, tokenizer, end.

    What is written has doc_id and text in ascending order of doc_id over its partitions; what is read has each
    document's ids as little-endian unsigned 32-bit integers.
    """

    @classmethod
    def name(cls) -> str:
        return "token_sequences"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("length", LENGTH)), self.options.get("tokenizer") or default_path(), int(self.options.get("end", END)))


def listing(path: str) -> dict:
    """The committed files of a folder, in order: {length, dtype, files: [[name, documents, ids]]}."""
    system, root = _opened(path)
    with system.open_input_stream(f"{root}/{LISTING}") as f:
        return json.loads(f.read())


def write_sequences(docs: DataFrame, path: str, tokenizer: str | None = None, length: int = LENGTH, end: int = END) -> None:
    """Encode every whole text of docs (doc_id, text), append `end` to each, and write the ids in ascending doc_id order.

    A null text is an empty one and gives the end id alone. Rows that share a doc_id (repeated rows, or null ids, which
    count as 0 in the order and are written as null) are all written, next to one another in no stated order. Other
    columns are ignored. No rows give a folder without part files. ids take 2 bytes each if the vocabulary allows it.
    """
    spark = docs.sparkSession
    lean(spark)
    tokenizer = tokenizer or default_path()
    spark.dataSource.register(TokenSequences)
    # The random number parts rows of one id; it is the same when a task runs again.
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.rand(5))
    dealt.sortWithinPartitions("doc_id").write.format("token_sequences").options(length=length, tokenizer=tokenizer, end=end).mode("append").save(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of every document of the folder."""
    spark.dataSource.register(TokenSequences)
    return spark.read.format("token_sequences").load(path)


def round_trip(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """Write the documents and read them back: doc_id, start, n_tokens, and the crc32 of the ids as little-endian 32-bit integers."""
    path = path or new_path(docs.sparkSession, "sequences")
    write_sequences(docs, path, tokenizer, length)

    return read_sequences(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
