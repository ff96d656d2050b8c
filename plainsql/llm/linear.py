"""What the two text classifiers share: hashed word n-grams, a bounded labelled sample, and sparse dot products over all texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from plainsql.llm.text import WORD_IDS, Cache, mix, ready, slices, tidied

#: Hashed features: 2 to this power.
BITS = 20
#: Bound of the labelled sample that a classifier is fitted on.
SAMPLE_ROWS = 6000


def ngrams(texts: list[str], orders: tuple[int, ...] = (1, 2), shapes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts end to end, and how many each text has: one for each run of n words, for n in ``orders``.

    ``shapes``: words are also taken with letters and digits levelled, so that marks and capitals count apart from the word.
    """
    parts, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.split()
        h = np.fromiter(map(WORD_IDS.__getitem__, words), np.uint64, len(words))
        found = [mix(h + np.uint64(1))] if 1 in orders else []
        for n in orders:
            if n > 1 and len(h) >= n:
                x = h[: len(h) - n + 1].copy()
                for k in range(1, n):
                    x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
                found.append(mix(x))
        if shapes:
            s = np.fromiter(map(SHAPE_IDS.__getitem__, words), np.uint64, len(words))
            found += [s, mix(s[:-1] * np.uint64(31) + (h[1:] == h[:-1]))] if len(s) > 1 else [s]
        parts += found
        counts[i] = sum(map(len, found))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return (flat >> np.uint64(64 - BITS)).astype(np.int64), counts


class Shapes(Cache):
    """word -> hash of its shape: A for capitals, a for letters, 0 for digits, runs once, other marks as they are."""

    def make(self, word: str) -> int:
        out = []
        for c in word:
            k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            if not out or out[-1] != k:
                out.append(k)
        return WORD_IDS["\0" + "".join(out)]


SHAPE_IDS = Shapes()


def learned_from() -> Column:
    """Rows that labels may be learned from: crc32 of doc_id as text, modulo 5, is not 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """At most ``rows`` labelled (text, 0 or 1), the ones with the least hashes of doc_id, in that order; others are not looked at.

    Labels are few and bounded first, so only the sampled texts reach the driver. Of several texts of one doc_id the least in
    the order of strings is taken.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & learned_from())
    ids = [(r.doc_id, r.label) for r in known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]
    if not ids:
        return []
    small = F.broadcast(spark.createDataFrame(ids, "doc_id long, label int"))
    found = ready(docs).join(small, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id")
    return [(r.text, r.label) for r in found.collect()]


def scored(docs: DataFrame, weights: np.ndarray, bias: float, features: Callable, root: bool = False, row: str | None = None) -> DataFrame:
    """doc_id, held_out, score of each whole text, and the column ``row`` as it is if one is named. A score is the logistic function of the bias plus the weights of its features, with
    ``root`` divided by the square root of their number. A text without features scores by the bias.
    """
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), float(bias)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = shared.value
        for b in slices(batches):
            found, n = features(b.column("text").to_pylist())
            margin = np.zeros(len(n))
            if len(found):  # each text is summed by itself, so its score does not depend on what shares its batch
                margin[n > 0] = np.add.reduceat(w[found].astype(np.float64), (np.cumsum(n) - n)[n > 0])
            margin = margin / (np.maximum(n, 1) ** 0.5 if root else 1) + b0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500)))), *[b.column(c) for c in carried]], names=["doc_id", "score", *carried])

    carried = [row] if row else []
    given = ready(docs, *carried)
    schema = StructType([StructField("doc_id", LongType()), StructField("score", DoubleType()), *[given.schema[c] for c in carried]])
    return given.mapInArrow(tidied(make), schema).select("doc_id", F.coalesce(~learned_from(), F.lit(False)).alias("held_out"), "score", *carried)
