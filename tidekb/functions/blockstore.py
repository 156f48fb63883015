"""Packed blocks in the shared folder, read inside tasks.

A block is what a group of rows packs to. Tasks append their blocks to one file each; an index table, one row per block,
says where a block lies. A task that is run again writes another file, and only the index of the run that counts is kept.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from tidekb.session import ensure_checkpoint_dir, written

PLACE = "file string, offset long, bytes long"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that driver and executors share (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri if ":/" in uri else f"file://{uri}"))


class Writer:
    """Appends blocks to one new file under ``folder``."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}"
        fs, path = file_system(self.uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.at = fs.open_output_stream(path, compression=None), 0

    def put(self, block: bytes) -> tuple[str, int, int]:
        self.out.write(block)
        self.at += len(block)
        return self.uri, self.at - len(block), len(block)

    def close(self) -> None:
        self.out.close()


class Reader:
    """Reads blocks; the file opened last stays open, and the block read last is kept by ``unpack``'s result."""

    def __init__(self, unpack: Callable[[bytes], object] = bytes, keep: int = 2):
        self.unpack, self.keep = unpack, keep
        self.uri, self.file, self.seen = None, None, {}

    def get(self, uri: str, offset: int, size: int):
        key = (uri, offset)
        if key not in self.seen:
            if uri != self.uri:
                fs, path = file_system(uri)
                self.uri, self.file = uri, fs.open_input_file(path)
            while len(self.seen) >= self.keep:
                self.seen.pop(next(iter(self.seen)))
            self.seen[key] = self.unpack(self.file.read_at(size, offset))
        return self.seen[key]


def grouped(batches, keys: int) -> Iterator[pa.Table]:
    """The rows of one key after another; input is sorted by its first ``keys`` columns. A key's rows may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        start = 0
        for i, key in enumerate(zip(*(b.column(k).to_pylist() for k in range(keys)))):
            if key != last:
                if i > start:
                    held.append(b.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        if b.num_rows > start:
            held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def new_folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}/{name}"


def write_blocks(df: DataFrame, keys: list[str], order: list[str], pack: Callable[[pa.Table], tuple[bytes, dict]], summary: str, name: str) -> DataFrame:
    """Pack the rows of each key, in order, and write them as blocks: keys, place and ``pack``'s summary columns.

    The caller bounds the rows of a key. ``pack`` gets a table with the columns of ``df``, keys first.
    """
    folder = new_folder(df.sparkSession, name)
    df = df.select(*keys, *[c for c in df.columns if c not in keys])
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)
    extra = [x.strip().split(" ", 1)[0] for x in re.split(r",(?![^<]*>)", summary)] if summary else []

    def run(batches):
        out = None
        for t in grouped(batches, len(keys)):
            out = out or Writer(folder)
            block, info = pack(t)
            place = out.put(block)
            fixed = [t.column(k).combine_chunks().slice(0, 1) for k in range(len(keys))]
            row = [pa.array([place[0]]), *(pa.array([x], pa.int64()) for x in place[1:]), *(pa.array([info[c]]) for c in extra)]
            yield pa.RecordBatch.from_arrays([*fixed, *row], [*keys, "file", "offset", "bytes", *extra])
        if out:
            out.close()

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return written(ordered.mapInArrow(run, f"{types}, {PLACE}" + (f", {summary}" if summary else "")), name)


def to_bytes(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each behind its type, and its shape."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head = f"{a.dtype.str} {' '.join(map(str, a.shape))}".encode()
        out += [len(head).to_bytes(4, "little"), head, a.tobytes()]
    return b"".join(out)


def from_bytes(block: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(block):
        n = int.from_bytes(block[at : at + 4], "little")
        kind, *shape = block[at + 4 : at + 4 + n].decode().split()
        shape = tuple(map(int, shape))
        size = int(np.prod(shape)) if shape else 1
        a = np.frombuffer(block, np.dtype(kind), size, at + 4 + n).reshape(shape)
        at += 4 + n + a.nbytes
        out.append(a)
    return out


def to_ipc(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def from_ipc(block: bytes) -> pa.Table:
    with pa.ipc.open_stream(block) as r:
        return r.read_all()


def write_rows(df: DataFrame, rows: int, name: str) -> DataFrame:
    """Rows as blocks of at most ``rows``, where they are: nothing is shuffled. Index: place and ``rows``."""
    folder = new_folder(df.sparkSession, name)

    def run(batches):
        out = None
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                out = out or Writer(folder)
                place = out.put(to_ipc(pa.Table.from_batches([part])))
                yield pa.RecordBatch.from_arrays([pa.array([place[0]]), *(pa.array([x], pa.int64()) for x in (*place[1:], part.num_rows))], ["file", "offset", "bytes", "rows"])
        if out:
            out.close()

    return written(df.mapInArrow(run, f"{PLACE}, rows long"), name)


def dealt(work: DataFrame, keys: list, n: int, each: int = 16) -> DataFrame:
    """``n`` small work items over tasks of about ``each`` items, items of equal ``keys`` together. The number is stated, as
    Spark would put rows that are small but dear into one task."""
    slots = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return work.repartition(max(1, min(n, max(slots, n // each), 100_000)), *keys)
