"""Near duplicates by DartMinHash.

Darts are thrown into the weighted regions of a text's elements (its 5-word shingles): each unit of an element's weight gets
darts at the points of a Poisson process over ranks, the same ones in every text that has it. A dart falls on one coordinate;
a coordinate keeps the dart of the least rank. Two texts agree on a coordinate with the probability of their weighted Jaccard
similarity. Ranks are visited in slices until every coordinate has a dart, so a text of n elements costs about n plus
k log k steps, not n times k.

Coordinates are joined in bands. Exact copies stand for one text. Within a band's bucket every text is paired with one pivot,
the text that meets the most others in all its buckets, as the original of a family does; pairs that are verified on the whole
sets join their classes. A bucket in which texts are still in different classes gets another pivot, and so on, as long as the
last step would cost several times as much: all texts outside a bucket's largest class are paired with the rest of it, each
pair in the first bucket that both are in, so none is met twice. Pairs that the parities of their sets prove to be less alike
are dropped there; all others are verified on the whole sets.
Only texts that link to none of their bucket's pivots come that far.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsql.llm.text import cut, hashed_words, mix, ready, shingles, slices, tidied

BANDS, ROWS = 40, 6
SHINGLE, SIMILARITY = 5, 0.8
#: Pivots that a bucket gets at most before the texts that are left are compared with all of their bucket.
PIVOTS = 1
#: Least ranks of the slices: fine where many elements share a coordinate's darts, then growing by a half.
EDGES = (0.0, 1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0, 32.0, 48.0, 64.0, 96.0, 128.0, 192.0, 256.0, 384.0, 512.0, 768.0, 1024.0, 1536.0, 2048.0, 3072.0, 4096.0)
#: Bits of a set's parities.
PARITY_BITS = 1024
#: A worker throws so many darts at once.
DARTS = 1 << 20


@cache
def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, ... events."""
    n = np.arange(int(mean + 12 * mean**0.5 + 12))
    logs = n * np.log(mean) - mean - np.concatenate([[0], np.cumsum(np.log(np.arange(1, len(n))))])
    return np.cumsum(np.exp(logs))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signatures(elements: np.ndarray, counts: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """A row of k dart hashes (uint64) for each text; texts' elements stand end to end, ``counts`` of each.

    A text without elements has a row of 0. Without ``weights`` each distinct element weighs 1 (repeats change nothing).
    A weight w is w whole units and a rest; of the rest's unit only darts below it count.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    share = np.ones(len(elements))
    if weights is not None:
        units = np.ceil(weights).astype(np.int64)
        at = np.repeat(np.arange(len(elements)), units)
        unit = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
        share = np.minimum(1.0, weights[at] - unit)
        elements, owner = mix(elements[at] + unit.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), owner[at]
    size = np.bincount(owner, share, len(counts))
    ranks, values = np.full(len(counts) * k, np.inf), np.zeros(len(counts) * k, np.uint64)
    # So many darts leave no coordinate empty in most texts; the few that have empty ones go on to further slices.
    need = (np.log(k) + 2) * k / np.maximum(size, 1e-9)
    going = size > 0
    for j, low in enumerate(EDGES):
        high = EDGES[j + 1] if j + 1 < len(EDGES) else 2 * low
        if low and not going.any():
            break
        use = np.flatnonzero(going[owner])
        for part in np.array_split(use, max(1, int(len(use) * max(high - low, 0.1)) // DARTS + 1)):
            seed = mix(elements[part] ^ np.uint64(0xD6E8FEB86659FD93 * (j + 1) & (1 << 64) - 1))
            chance = _poisson(high - low)
            n = np.searchsorted(chance, _unit(seed), side="right")
            hit = np.flatnonzero(n)
            n = n[hit]
            which = np.repeat(hit, n)
            dart = mix(seed[which] + (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
            if weights is not None:
                keep = _unit(mix(dart ^ np.uint64(0x8EBC6AF09C88C6E3))) < share[part[which]]
                which, dart = which[keep], dart[keep]
            rank = low + (high - low) * _unit(mix(dart + np.uint64(1)))
            slot = owner[part[which]] * k + (dart % np.uint64(k)).astype(np.int64)
            before = ranks[slot]
            better = rank < before
            slot, rank, dart = slot[better], rank[better], dart[better]
            order = np.lexsort((rank, slot))
            slot, rank, dart = slot[order], rank[order], dart[order]
            first = np.ones(len(slot), bool)
            first[1:] = slot[1:] != slot[:-1]
            ranks[slot[first]], values[slot[first]] = rank[first], dart[first]
        going &= (need > high) | np.isinf(ranks.reshape(-1, k)).any(1)
    return values.reshape(-1, k)


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, key (binary: the same for the same words), bands (array<long>, empty for a text without words)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 20):
            words, n_words = hashed_words(b.column("text").to_pylist())
            found, n = shingles(words, n_words, SHINGLE)
            s = signatures(found, n, bands * rows)
            s = s.reshape(len(n), bands, rows)
            h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(n), bands)).copy()
            for i in range(rows):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, i])
            ends = np.cumsum(n_words)
            place = mix(words ^ mix(np.arange(1, len(words) + 1, dtype=np.uint64) - np.repeat(ends - n_words, n_words).astype(np.uint64)))
            again = mix(words * np.uint64(0xE7037ED1A0B428DB) + mix(np.arange(7, len(words) + 7, dtype=np.uint64) - np.repeat(ends - n_words, n_words).astype(np.uint64)))
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (place, again)]
            key = np.stack([x[ends] - x[ends - n_words] for x in sums] + [n_words.astype(np.uint64)], 1)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([x.tobytes() for x in key], pa.binary()),
                    pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32), h[n > 0].astype(np.int64).ravel()),
                ],
                names=["doc_id", "key", "bands"],
            )

    return ready(docs).mapInArrow(tidied(make), "doc_id long, key binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, shingles (array<int>), parities (array<long>) of each text.

    The shingles are hashes of the distinct ones, in order. A bit of the parities tells whether an odd number of them falls on it.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 20):
            found, n = shingles(*hashed_words(b.column("text").to_pylist()), SHINGLE)
            short = (found >> np.uint64(32)) | (np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32))
            short = np.unique(short)
            owner = (short >> np.uint64(32)).astype(np.int64)
            sizes = np.bincount(owner, minlength=len(n))
            odd = np.bincount(owner * PARITY_BITS + (short % np.uint64(PARITY_BITS)).astype(np.int64), minlength=len(n) * PARITY_BITS) & 1
            parities = np.packbits(odd.astype(np.uint8)).view(np.int64)
            columns = [
                b.column("doc_id"),
                pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), short.astype(np.uint32).view(np.int32)),
                pa.ListArray.from_arrays(np.arange(0, len(parities) + 1, PARITY_BITS // 64, dtype=np.int32), parities),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shingles", "parities"])

    return ready(docs).mapInArrow(tidied(make), "doc_id long, shingles array<int>, parities array<long>")


def near_parities(a: str, b: str, n_a: str, n_b: str, similarity: float) -> Column:
    """False only for sets that are less alike: each bit in which two parities differ has an element that one set lacks."""
    per_mille = round(similarity * 1000)
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return differ * (1000 + per_mille) <= (F.col(n_a) + F.col(n_b)) * (1000 - per_mille)


def first_shared(a: str, b: str) -> Column:
    """The first place at which two arrays are equal, from 0; -1 where none is."""
    return (F.array_position(F.zip_with(a, b, lambda x, y: x == y), True) - 1).cast("int")


def linked(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sets have that Jaccard similarity at least.

    Each bit in which two parities differ has an element that one set lacks, so pairs with too many of them are told from the
    parities alone, without error; only the others' sets are sent.
    """
    per_mille = round(similarity * 1000)
    brief, whole = ([sets.select(F.col("doc_id").alias(x), *(c.alias(f"{n}{x}") for n, c in columns.items())) for x in "ab"] for columns in ({"n": F.size("shingles"), "p": F.col("parities")}, {"s": F.col("shingles")}))
    near = pairs.join(brief[0], "a").join(brief[1], "b").where(near_parities("pa", "pb", "na", "nb", similarity)).select("a", "b")
    common = F.size(F.array_intersect("sa", "sb"))
    # In whole numbers, so a similarity of exactly 0.8 counts.
    return near.join(whole[1], "b").join(whole[0], "a").where(common * 1000 >= per_mille * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that edges (a, b) connect each node with. Nodes without edges have no row.

    Alternates linking each node's larger neighbours, then all its lesser ones, to its least, until nothing changes; the number
    of edges does not grow, and each round that changes something lowers a label.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    e = cut(e)
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = now


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes (doc_id, label and more) with the classes joined that links (a, b) connect."""
    one, two = (classes.select(F.col("doc_id").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    more = [c for c in classes.columns if c != "label"]
    joined = components(links.join(one, "a").join(two, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    return cut(classes.join(joined.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select(*more, F.coalesce("to", "label").alias("label")))


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, similarity: float = SIMILARITY, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, class_id, of each row: the least doc_id among the texts that links connect it with, copies included.

    Null and empty texts, and texts of white space, are copies of each other. A null doc_id is in a class of its own, null.
    Repeated rows are repeated. Empty table: no rows.
    """
    s = cut(signed(docs.where(F.col("doc_id").isNotNull()), bands, rows))
    copies = s.groupBy("key").agg(F.min("doc_id").alias("rep"))
    texts = s.join(copies, "key").where("doc_id = rep").dropDuplicates(["doc_id"]).select("doc_id", F.explode("bands").alias("bucket"))
    # Buckets of one text are the most by far; they go before anything is joined.
    buckets = texts.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("size")).where("least < most")
    members = cut(texts.join(buckets.select("bucket", "size"), "bucket"))
    ids = members.groupBy("doc_id").agg(F.sum("size").alias("met"))
    sets = cut(shingle_sets(docs.join(ids, "doc_id", "left_semi")).dropDuplicates(["doc_id"]))
    classes = cut(ids.select("doc_id", "met", F.col("doc_id").alias("label")))
    for turn in range(pivots + 1):
        placed = members.drop("size").join(classes, "doc_id")
        # Later turns draw by lot, or they would get the first turn's pivots again.
        mark = F.struct(F.lit(0) if turn else -F.col("met"), F.xxhash64("doc_id", F.lit(turn)))
        held = placed.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.min(F.struct(mark, "doc_id", "label")).alias("pick"))
        mixed = held.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("main"), F.min("pick").alias("pick"), F.count("*").alias("classes")).where("classes > 1")
        open_ = cut(placed.join(mixed.select("bucket", "size", F.col("main.n").alias("most"), F.col("main.label").alias("main"), F.col("pick.doc_id").alias("pivot"), F.col("pick.label").alias("of")), "bucket"))
        cost, all_ = open_.agg(F.sum(F.when(F.col("label") != F.col("main"), F.col("size"))), F.count("*")).first()
        if not all_:
            break
        last = turn == pivots or cost <= 4 * all_
        if last:
            # Whole bands are compared, so a pair is met in the first bucket that both are in, whatever other bands look like.
            brief = sets.select("doc_id", F.size("shingles").alias("n"), "parities")
            drawn = open_.select("bucket", "doc_id", "label", "main").join(s.select("doc_id", "bands").dropDuplicates(["doc_id"]), "doc_id").join(brief, "doc_id")
            outside = drawn.where("label != main").select("bucket", *(F.col(c).alias(f"x_{c}") for c in ("doc_id", "label", "n", "parities", "bands")))
            every = drawn.select(F.col("bucket").alias("of_bucket"), "doc_id", "label", "main", "n", "parities", "bands")
            # Of two texts that are both outside, the one with the lesser id stands on the left.
            once = (F.col("bucket") == F.col("of_bucket")) & (F.col("x_label") != F.col("label")) & ((F.col("label") == F.col("main")) | (F.col("x_doc_id") < F.col("doc_id")))
            pairs = outside.join(every, once & near_parities("x_parities", "parities", "x_n", "n", similarity) & (F.get("bands", first_shared("x_bands", "bands")) == F.col("bucket"))).select(F.col("x_doc_id").alias("a"), F.col("doc_id").alias("b"))
        else:
            pairs = open_.where("label != of").select(F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")).distinct()
        classes = merged(classes, cut(linked(pairs, sets, similarity)))
        if last:
            break
    of_text = copies.join(classes.withColumnsRenamed({"doc_id": "rep"}), "rep", "left").select("key", F.coalesce("label", "rep").alias("class_id"))
    known = s.join(of_text, "key").select("doc_id", "class_id")
    return known.union(docs.where(F.col("doc_id").isNull()).select(F.lit(None).cast("long"), F.lit(None).cast("long")))
