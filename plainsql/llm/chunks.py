"""Documents in chunks: some hundred whole texts that go through a shuffle as one compressed value.

Operators that ask other documents about a text exchange compressed arrays between chunks and buckets. The chunk table is
stored in the shared checkpoint folder, so chunks stay the same whichever executor is lost or plan is run again.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from plainsql.llm.text import LAST_ID, cut, ready, slices, tidied

#: Bytes of text from which a chunk is full; a longer text is a chunk alone.
CHUNK_BYTES = 1 << 20
#: Chunks whose records one bucket holds, on average.
CHUNKS_A_BUCKET = 12
#: Bytes of requests, not compressed, from which a pack answers them, and of rows made that go on at once.
REQUESTED, MADE = 16 << 20, 4 << 20


def dump(*arrays: object) -> bytes:
    """A compressed value for ``load``, between this library's own tasks. Numbers go byte by byte, all first bytes first, as
    their upper bytes are mostly alike."""
    flat = [("planes", x.dtype.str, np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T)) if isinstance(x, np.ndarray) and x.ndim == 1 and x.itemsize > 1 and len(x) else x for x in arrays]
    return zstandard.compress(pickle.dumps(flat, 5), 3)


def load(data: bytes) -> tuple:
    return tuple(np.ascontiguousarray(x[2].T).view(x[1]).ravel() if isinstance(x, tuple) and x[:1] == ("planes",) else x for x in pickle.loads(zstandard.decompress(data)))


def chunked(docs: DataFrame, key: str | None = None, full: int = CHUNK_BYTES) -> DataFrame:
    """chunk long, docs binary: ``load`` gives ids (a null is None), the UTF-8 texts end to end with their ends, and the column
    ``key`` if one is named. A chunk is full from ``full`` bytes of text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, texts, keys, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def row() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([dump(ids, b"".join(texts), ends, *[keys] * bool(key))], pa.binary())], names=["chunk", "docs"])

        for b in slices(batches):
            for i, t, k in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column(key or "doc_id").to_pylist(), strict=True):
                if ids and size + len(t) > full:
                    yield row()
                    place, ids, texts, keys, size = place + 1, [], [], [], 0
                ids.append(i)
                texts.append(t)
                keys.append(k)
                size += len(t)
        if ids:
            yield row()

    return cut(ready(docs, *[key] * bool(key)).mapInArrow(tidied(make), "chunk long, docs binary"))


def ordered_ids(ids: list[int | None]) -> np.ndarray:
    return np.array([LAST_ID if i is None else i for i in ids], np.int64)


def answered(chunks: DataFrame, answers: DataFrame, f, schema: str, by: str = "chunk", dealt=lambda rows, answers: [answers] * len(rows)) -> DataFrame:
    """f(row of the chunk as a dict, its answers) -> arrays by column name, for each chunk. ``dealt`` gives the answers of each of
    the chunks with the same ``by``, from these chunks and all their answers as dicts."""
    names = [x.split()[0] for x in schema.split(", ")]

    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
        types = [arrow[x.split()[1]] for x in schema.split(", ")]
        found: dict = {n: [] for n in names}
        rows = left.to_pylist()
        for row, own in zip(rows, dealt(rows, right.to_pylist()), strict=True):
            for n, x in f(row, own).items():
                found[n] += list(x)
        return pa.table([pa.array(found[n], t) for n, t in zip(names, types, strict=True)], names=names)

    return chunks.groupBy(by).cogroup(answers.groupBy(by)).applyInArrow(make, schema)


def per_chunk(chunks: DataFrame, f, schema: str) -> DataFrame:
    """f(chunk, ids, bytes, ends) -> rows as tuples in the order of the schema, for each chunk."""
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    types = [arrow[x.split()[1]] for x in schema.split(", ")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, docs in zip(b.column("chunk").to_pylist(), b.column("docs").to_pylist(), strict=True):
                columns = list(zip(*f(chunk, *load(docs)), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return chunks.mapInArrow(tidied(make), schema)


def per_bucket(rows: DataFrame, f, schema: str, by: str = "bucket") -> DataFrame:
    """f(list of the bucket's rows as dicts) -> rows as tuples in the order of the schema, for each bucket."""
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    types = [arrow[x.split()[1]] for x in schema.split(", ")]

    def make(table: pa.Table) -> pa.Table:
        columns = list(zip(*f(table.to_pylist()), strict=True)) or [()] * len(names)
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return rows.groupBy(by).applyInArrow(make, schema)


def streamed_bucket(rows: DataFrame, f, schema: str, by: str = "bucket") -> DataFrame:
    """As ``per_bucket``; f's rows go on as it yields them, so that not all those of a bucket are held."""
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    types = [arrow[x.split()[1]] for x in schema.split(", ")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*waiting, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

        for row in f([r for b in batches for r in b.to_pylist()]):
            waiting.append(row)
            size += sum(len(x) for x in row if isinstance(x, bytes))
            if size > MADE:
                yield batch()
                waiting, size = [], 0
        yield batch()

    return rows.groupBy(by).applyInArrow(tidied(make), schema)


def unpacked(data: bytes) -> int:
    """Bytes of a value of ``dump`` before it was compressed."""
    return zstandard.frame_content_size(data)


def in_turns(rows: Iterator[dict], most: int) -> Iterator[tuple[list[dict], list[dict]]]:
    """The chunks of each pack with some of the requests to it: all of one asker together, and of so many askers as have ``most`` bytes.

    Rows are in the order of pack and asker; -1 stands for the chunks themselves.
    """
    for _, own in groupby(rows, key=lambda r: r["pack"]):
        docs, waiting, size = [], [], 0
        for asker, some in groupby(own, key=lambda r: r["asker"]):
            if asker < 0:
                docs = list(some)
                continue
            for r in some:
                waiting.append(r)
                size += unpacked(r["value"])
            if size > most:
                yield docs, waiting
                waiting, size = [], 0
        if waiting:
            yield docs, waiting


def asked_in_turns(chunks: DataFrame, requests: DataFrame, f, schema: str) -> DataFrame:
    """f(row of the chunk as a dict, its requests) -> arrays by column name, for each chunk and turn (see ``in_turns``).

    A pack may be asked by all others, so its requests and what they are answered are never held at once.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    types = [arrow[x.split()[1]] for x in schema.split(", ")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, waiting in in_turns((r for b in batches for r in b.to_pylist()), REQUESTED):
            for d in docs:
                if got := [load(r["value"]) for r in waiting if r["chunk"] == d["chunk"]]:
                    out = f({"pack": d["pack"], "chunk": d["chunk"], "docs": d["value"]}, got)
                    yield pa.RecordBatch.from_arrays([pa.array(list(out[n]), t) for n, t in zip(names, types, strict=True)], names=names)

    both = chunks.selectExpr("pack", "-1L as asker", "chunk", "docs as value").unionAll(requests.selectExpr("pack", "asker", "chunk", "request as value"))
    return both.repartition("pack").sortWithinPartitions("pack", "asker").mapInArrow(tidied(make), schema)


def by_value(values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of equal values of a sorted array."""
    if len(values):
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
            yield int(values[i]), slice(i, j)
