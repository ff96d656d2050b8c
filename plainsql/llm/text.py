"""Helpers shared by the text operators: input columns, bounded slices of Arrow batches, word hashes, cut lineage.

Every operator takes a frame with at least ``doc_id`` and ``text``. Other columns are ignored, whatever their names. A null
text counts as empty. A null doc_id stays null in the result; where ids are ordered it counts as the largest id.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from weakref import WeakSet

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python operator holds; a single longer text is a step of its own.
SLICE_BYTES = 2 << 20
#: What stands for a null doc_id where ids are ordered.
LAST_ID = np.iinfo(np.int64).max
#: Entries that a per-worker cache may hold before it is emptied, and the longest word that it keeps.
CACHE_ENTRIES, CACHED_LETTERS = 150_000, 64


def ready(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id as long, text without nulls, and the extra columns asked for; Arrow batches bounded by rows and bytes."""
    conf = docs.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * SLICE_BYTES))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of about ``limit`` bytes of text at most, at least a row each."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < b.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield b.slice(start, stop - start)
            start = stop


class Cache(dict):
    """word -> ``make(word)``, computed once while it stays in this bounded cache."""

    every: WeakSet[Cache] = WeakSet()
    entries = CACHE_ENTRIES
    __hash__ = object.__hash__
    __eq__ = object.__eq__

    def __init__(self) -> None:
        super().__init__()
        self.every.add(self)

    def make(self, word: str) -> object:
        raise NotImplementedError

    def __missing__(self, word: str) -> object:
        x = self.make(word)
        if len(word) <= CACHED_LETTERS:
            if len(self) >= self.entries:
                self.clear()
            self[word] = x
        return x


#: What operators keep for a worker's next tasks of the same operator, by the operator's name.
HELD: dict[str, dict] = {}


def tidied(f: Callable, own: str = "") -> Callable:
    """f over batches; after its last batch the worker gives back what its caches and Arrow hold, as it stays for other tasks.

    What other operators than ``own`` hold goes before the first batch.
    """

    def g(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(own)
        try:
            yield from f(batches)
        finally:
            give_back(bool(own))

    return g


def drop_others(own: str) -> None:
    for name, held in HELD.items():
        if name != own:
            held.clear()


def give_back(keep: bool) -> None:
    """``keep``: the caches, which the next tasks of an operator that holds its own go on with."""
    for c in [] if keep else list(Cache.every):
        c.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


class WordIds(Cache):
    """word -> 64-bit hash."""

    def make(self, word: str) -> int:
        return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


WORD_IDS = WordIds()


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words of all texts, end to end, and the number of words of each text."""
    counts, parts = np.zeros(len(texts), np.int64), []
    for i, t in enumerate(texts):
        words = t.split()
        counts[i] = len(words)
        parts.append(np.fromiter(map(WORD_IDS.__getitem__, words), np.uint64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, for each element."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``width`` words, end to end, and their number for each text.

    A text of 1 to ``width`` - 1 words has one shingle, all its words; one without words has none.
    """
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    starts = np.cumsum(counts) - counts
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    short = np.repeat(np.minimum(counts, width), n)
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(k < short, padded[at + k], np.uint64(k + 1))
    return mix(h), n


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; only where it names none, as in tests, one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plainsql-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: stored in the shared folder, where lost executors cannot take it along."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``; what was shuffled for df goes as soon as it is stored, not when the driver happens to collect its garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return cut(df.select("*"))
    finally:
        conf.set(name, before)
