"""Rows in packed shards, and exact counts of hashed features told back to each shard.

A shard is a run of rows of about ``SHARD`` bytes of text, kept as compressed Arrow
in one row of a written table: packing shuffles nothing, a row is known by its
shard and its place there, and columns that nobody looks at travel inside, so
their names clash with nothing.

``count_keys`` counts hashed features over all shards. A shard sends its distinct
keys, ascending, as compressed differences cut by key range, each with its own
count; a range sums them and answers every shard in the order sent, so a key
travels once each way in a few bytes. Counts are exact but for keys that collide;
``key_bits`` grows with the input, so their share does not. Keys are sent in
``rounds``, a slice of the ranges at a time, and shards are answered in rounds
too, which bounds the disk that shuffles take.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import U, column_bytes, order_of
from .scratch import Scratch, prepare_python, trim

SHARD = 8 << 20
RANGE = 2  # shards to a range of keys
_LEVEL = 6


def pack_rows(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", _LEVEL))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_rows(shard: pa.Table) -> pa.Table:
    """The rows of a shard, given as the one row that holds it."""
    return unpack_blob(shard.column("rows")[0].as_buffer())


def unpack_blob(blob) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def squeeze(x: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return x.size.to_bytes(8, "little") + (pa.compress(planes.tobytes(), "zstd", asbytes=True) if x.size else b"")


def expand(blob: bytes, kind) -> np.ndarray:
    size, width = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(blob[8:], size * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size).T).view(kind).ravel()


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, by their differences."""
    return squeeze(np.diff(keys.astype(U), prepend=U(0)))


def expand_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob, U), dtype=U)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct values (none negative), the place of the first of each, every value's index among them, and their counts."""
    order = order_of(x)
    ordered = x[order]
    new = np.ones(x.size, bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    at = np.flatnonzero(new)
    inverse = np.empty(x.size, np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[at], order[at], inverse, np.diff(np.append(at, x.size))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def packed() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [pa.array([number], pa.int64()), pa.array([table.num_rows], pa.int64()), pa.array([size], pa.int64()), pa.array([pack_rows(table)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "n", "bytes", "rows"])

    for batch in batches:
        _, offs = column_bytes(batch.column("text"))
        offs = offs + 16 * np.arange(len(offs))  # so that many rows without text fill a shard, too
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + SHARD - size, "right")) - 1)
            held.append(batch.slice(at, to - at))
            size += int(offs[to] - offs[at])
            at = to
            if size >= SHARD or at < batch.num_rows:
                yield packed()
                number, held, size = number + 1, [], 0
    if held:
        yield packed()
    trim()


class Shards:
    """The rows of ``docs`` (``text`` among its columns) in packed shards."""

    def __init__(self, docs: DataFrame, scratch: Scratch):
        self.spark, self.scratch, self.schema = docs.sparkSession, scratch, docs.schema
        prepare_python(self.spark)
        packed = docs.mapInArrow(_pack, "shard long, n long, bytes long, rows binary")
        self.path = scratch.path("shards")
        packed.write.options(compression="uncompressed", **{"parquet.block.size": str(SHARD)}).parquet(self.path)
        self._read = self.spark.read.schema(packed.schema).parquet(self.path)
        size = self._read.agg(F.count("*").alias("k"), F.sum("bytes").alias("b")).first()
        self.count, self.bytes = size.k, size.b or 0
        self.ranges = max(self.count // RANGE, 8)
        self.key_bits = min(62, max(40, self.bytes.bit_length() + 10))
        prepare_python(self.spark, 2)  # rows are shards from here on
        scratch.release()

    def read(self) -> DataFrame:
        return self._read.select("shard", "rows")

    def drop(self) -> None:
        self.scratch.drop("shards")

    def map(self, work: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema) -> DataFrame:
        """``work(shard, rows)`` of every shard."""

        def run(batches):
            for batch in batches:
                for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("rows"), strict=True):
                    yield from work(shard, unpack_blob(blob.as_buffer()))
                    trim()

        return self.read().mapInArrow(run, schema)

    def answer(self, reply: DataFrame, work: Callable[[pa.Table, pa.Table, int], pa.Table], schema, name: str, rounds: int = 1) -> DataFrame:
        """``work(rows, reply of the shard, shard)`` of every shard, written in rounds."""

        def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
            trim()  # of the shard before
            return work(unpack_rows(ours), theirs, ours.column("shard")[0].as_py())

        out = []
        for k in range(rounds):
            mine = F.pmod(F.xxhash64("shard"), F.lit(rounds)) == k
            both = self.read().filter(mine).groupBy("shard").cogroup(reply.filter(mine).groupBy("shard"))
            out.append(self.scratch.save(f"{name}{k}", both.applyInArrow(run, schema)))
        return reduce(DataFrame.unionAll, out)

    def count_keys(self, keys_of: Callable[..., tuple[np.ndarray, np.ndarray]], name: str = "reply", rounds: int = 1) -> DataFrame:
        """(shard, part, told): see ``told_counts``. ``keys_of(rows)``: ascending distinct keys below
        2**key_bits and their counts in the shard; in rounds ``keys_of(rows, low, high)``, of those keys alone."""
        ranges, bits = self.ranges, self.key_bits
        edges = np.array([(k << bits) // ranges for k in range(1, ranges)], U)
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())

        def send(first: int, end: int):
            bounds = () if rounds == 1 else tuple((k << bits) // ranges for k in (first, end))

            def work(shard: int, rows: pa.Table):
                keys, counts = keys_of(rows, *bounds)
                cut = [0, *np.searchsorted(keys, edges).tolist(), keys.size]
                out = [(p, shard, squeeze_keys(keys[cut[p] : cut[p + 1]]), squeeze(counts[cut[p] : cut[p + 1]].astype(np.uint32))) for p in range(first, end) if cut[p] < cut[p + 1]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "shard", "keys", "counts"])

            return work

        def total(rows: pa.Table) -> pa.Table:
            keys = [expand_keys(x) for x in rows.column("keys").to_pylist()]
            counts = np.concatenate([expand(x, np.uint32) for x in rows.column("counts").to_pylist()])
            found, _, inverse, _ = distinct(np.concatenate(keys))
            sums = np.minimum(np.bincount(inverse, counts, found.size), (1 << 32) - 1).astype(np.uint32)[inverse]
            told = [squeeze(x) for x in np.split(sums, np.cumsum([x.size for x in keys])[:-1])]
            trim()
            return pa.table({"shard": rows.column("shard"), "part": rows.column("part"), "told": pa.array(told, pa.binary())})

        out, edge = [], [ranges * k // rounds for k in range(rounds + 1)]
        for k in range(rounds):
            sent = self.map(send(edge[k], edge[k + 1]), "part int, shard long, keys binary, counts binary")
            out.append(self.scratch.save(f"{name}{k}", sent.groupBy("part").applyInArrow(total, "shard long, part int, told binary")))
        return reduce(DataFrame.unionAll, out)

    def take(self, keep: DataFrame) -> DataFrame:
        """The rows of ``keep`` (shard, pos), with the columns the shards were made of."""
        bits = keep.groupBy("shard").agg(F.collect_list("pos").alias("pos"))  # at most the rows of a shard
        schema = T.StructType(self.schema.fields)

        def work(ours: pa.Table, theirs: pa.Table) -> pa.Table:
            at = np.sort(theirs.column("pos").combine_chunks().flatten().to_numpy()) if theirs.num_rows else np.zeros(0, np.int64)
            return unpack_rows(ours).take(pa.array(at))

        return self.read().groupBy("shard").cogroup(bits.groupBy("shard")).applyInArrow(work, schema)


def told_counts(reply: pa.Table) -> np.ndarray:
    """Corpus counts of a shard's keys, in their order."""
    got = [expand(x, np.uint32) for x in reply.sort_by("part").column("told").to_pylist()]
    return np.concatenate(got) if got else np.zeros(0, np.uint32)
