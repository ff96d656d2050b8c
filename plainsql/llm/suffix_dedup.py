"""Exact substring dedup by a distributed, sampled suffix array.

A string of SPAN bytes has one anchor: the place of its least K-byte hash. Equal strings have it at the same place, so only
suffixes that start at anchors (one in about 17 places) need sorting, each with the bytes before it that its strings reach.

1. Chunks tell hash buckets which anchors they have, as sorted arrays; the answer marks those that another chunk has too.
2. Anchors that occur in two documents become suffixes. Splitters sampled from leading bytes range-partition them, so equal
   leading bytes are never parted; a chunk sends a suffix once, however many of its documents have it.
3. A bucket sorts its suffixes by multikey quicksort (keys of 8 bytes), compares neighbours, and gives every string its least
   document. Strings that start before their anchor are compared from the common anchor leftwards as well.
4. Chunks get the byte ranges to remove.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsql.llm.chunks import CHUNKS_A_BUCKET, answered, by_value, chunked, dump, load, ordered_ids, per_bucket, per_chunk
from plainsql.llm.text import mix

SPAN, K = 50, 16
#: Positions that are hashed at once, for the processor's cache.
BLOCK = 1 << 16
#: Low bits of a 64-bit word that hold a position, the rest its hash.
PLACE_BITS = 32
LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS = [np.uint64(pow(0xD1342543DE82EF95, 1 << i, 1 << 64)) for i in range(K.bit_length() - 1)]


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: first and last start of the strings, the anchor's place, and its hash.

    ``data`` holds texts end to end; no string crosses an end.
    """
    n = len(data) - SPAN + 1
    if n <= 0:
        return (*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))
    least, hashes = np.empty(n, np.uint64), np.empty(len(data) - K + 1, np.uint64)
    for s in range(0, n, BLOCK):
        h = LETTERS[data[s : s + BLOCK + SPAN - 1]]
        width = 1
        for f in FACTORS:
            h = h[:-width] * f + h[width:]
            width *= 2
        h = mix(h)
        hashes[s : s + len(h)] = h
        h = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(s, s + len(h), dtype=np.uint64)
        window, width = SPAN - K + 1, 1
        while 2 * width <= window:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if rest := window - width:
            h = np.minimum(h[:-rest], h[rest:])
        least[s : s + len(h)] = h
    place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    inside = np.ones(n, bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - SPAN + 1) : e] = False
    start = np.flatnonzero(inside)
    place = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start))[: len(first)] - 1
    return start[first], start[last], place[first], hashes[place[first]]


def _keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket above, 32 bits of the hash below."""
    low = np.uint64(32)
    return ((hashes >> low) % np.uint64(buckets) << low) | (hashes & np.uint64(0xFFFFFFFF))


def heads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as numbers in the order of the bytes."""
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | data[at + i]
    return out


def multikey_order(text: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings text[at:stop] (shorter first), and for each but the first how many bytes its key shares with the one before.

    Multikey quicksort with 8 bytes a key: all by the first key, then only those still equal by the next.
    """
    width = int((stop - at).max()) if len(at) else 0
    order, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    shared = np.zeros(len(at), np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    depth, open_ = 0, np.arange(len(at))
    while len(open_) and depth <= width:
        i = order[open_]
        key = np.zeros(len(i), np.uint64)
        for k in range(8):
            p = at[i] + depth + k
            key = key << np.uint64(8) | np.where(p < stop[i], padded[np.minimum(p, len(text))], 0).astype(np.uint64)
        size = np.clip(stop[i] - at[i] - depth, 0, 9)
        by = np.lexsort((size, key, group[open_]))
        i, key, size, g = i[by], key[by], size[by], group[open_][by]
        order[open_] = i
        same = np.zeros(len(i), bool)
        same[1:] = (key[1:] == key[:-1]) & (size[1:] == size[:-1]) & (g[1:] == g[:-1])
        tie = np.zeros(len(i), bool)
        tie[1:] = g[1:] == g[:-1]
        differ = key[1:] ^ key[:-1]
        equal = np.minimum(np.minimum(sum((differ >> np.uint64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 9)), size[1:]), size[:-1])
        shared[open_[1:]] = np.where(tie[1:], depth + equal, shared[open_[1:]])
        group[open_] = open_[np.maximum.accumulate(np.where(same, 0, np.arange(len(i))))]
        more = (size >= 9) & (same | np.append(same[1:], False))
        open_, depth = open_[more], depth + 8
    return order, shared


def _compare(rows: list[dict]) -> list[tuple]:
    """What a range bucket answers: (chunk, ranges to remove)."""
    texts: dict[tuple, int] = {}
    chunk, which, doc, at = [], [], [], []
    for r in rows:
        lefts, sizes, body, counts, docs, offsets = load(r["suffixes"])
        ends = np.cumsum(sizes)
        own = np.array([texts.setdefault((left, body[e - n : e]), len(texts)) for left, e, n in zip(lefts.tolist(), ends.tolist(), sizes.tolist(), strict=True)], np.int64)
        which.append(np.repeat(own, counts))
        doc.append(docs)
        at.append(offsets)
        chunk.append(np.full(len(docs), r["chunk"]))
    which, doc, at, chunk = map(np.concatenate, (which, doc, at, chunk))
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    left = np.array([k[0] for k in texts], np.int64)
    size = np.array([len(k[1]) for k in texts], np.int64)
    body = np.frombuffer(b"".join(k[1] for k in texts), np.uint8)
    begin = np.cumsum(size) - size
    # Neighbours that share the K bytes at the anchor form a group; one text alone in it has been settled by its least document.
    order, shared = multikey_order(body, begin + left, begin + size)
    new = shared < K
    new[:1] = True
    group = np.cumsum(new) - 1
    alone = np.bincount(group)[group] == 1
    among = order[~alone]
    gone: list[tuple[np.ndarray, np.ndarray]] = []
    factor = np.uint64(0x9E3779B97F4A7C15)
    for back in range(SPAN - K + 1):
        i = among[(left[among] >= back) & (left[among] - back + SPAN <= size[among])]
        if len(i) < 2:
            continue
        strings = body[(begin[i] + left[i] - back)[:, None] + np.arange(SPAN)]
        h = np.zeros(len(i), np.uint64)
        for k in range(SPAN):
            h = h * factor + strings[:, k]
        by = np.argsort(mix(h), kind="stable")
        same = np.zeros(len(by), bool)
        same[1:] = (h[by][1:] == h[by][:-1]) & (strings[by][1:] == strings[by][:-1]).all(1)
        first = np.flatnonzero(~same)
        lowest = np.minimum.reduceat(least[i[by]], first)[np.cumsum(~same) - 1]
        hit = i[by][lowest < least[i[by]]]
        gone.append((hit, left[hit] - back))
    out = [(chunk[(full := doc > least[which])], at[full], size[which[full]])]
    if gone:
        text, start = map(np.concatenate, zip(*gone, strict=True))
        rest = np.flatnonzero(~full & np.isin(which, text))
        own = np.argsort(text, kind="stable")
        text, start = text[own], start[own]
        low, high = np.searchsorted(text, which[rest]), np.searchsorted(text, which[rest], side="right")
        n = high - low
        k = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of = np.repeat(rest, n)
        out.append((chunk[of], at[of] + start[k], np.full(len(of), SPAN)))
    chunk, at, size = map(np.concatenate, zip(*out, strict=True))
    by = np.lexsort((at, chunk))
    chunk, at, size = chunk[by], at[by], size[by]
    return [(c, dump(np.diff(at[s], prepend=0).astype(np.int32), size[s].astype(np.uint8))) for c, s in by_value(chunk)]


def removed(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, and kept (binary) if asked for.

    A byte goes if a string of SPAN bytes that covers it also starts in a document with a smaller doc_id. Null, empty and short
    texts: nothing goes. A null doc_id is larger than all others, and rows with the same doc_id don't count against each other.
    Empty table: no rows.
    """
    chunks = chunked(docs)
    spark = chunks.sparkSession
    buckets = max(8, -(-chunks.count() // CHUNKS_A_BUCKET))

    def leading(chunk: int, ids: list, text: bytes, ends: np.ndarray) -> list[tuple]:
        data = np.frombuffer(text, np.uint8)
        at = (mix(np.arange(64, dtype=np.uint64) + np.uint64(chunk)) % np.uint64(max(1, len(data) - 8))).astype(np.int64)
        return [(int(h),) for h in (heads(data, at) >> np.uint64(1))] if len(data) > 8 else []

    at = [(i + 1) / buckets for i in range(buckets - 1)]
    sampled = per_chunk(chunks, leading, "head long").agg(F.percentile_approx("head", at, 10_000).alias("x")).first()["x"]
    splitters = np.unique(np.array(sampled or [], np.uint64))
    shared = spark.sparkContext.broadcast(splitters)

    def own(chunk: int, ids: list, text: bytes, ends: np.ndarray) -> list[tuple]:
        keys = np.unique(_keys(anchors(np.frombuffer(text, np.uint8), ends)[3], buckets))
        return [(b, chunk, keys[s].astype(np.uint32).tobytes()) for b, s in by_value(keys >> np.uint64(32))]

    def common(rows: list[dict]) -> list[tuple]:
        parts = [np.frombuffer(r["keys"], np.uint32) for r in rows]
        keys = np.sort(np.concatenate(parts))
        twice = np.unique(keys[1:][keys[1:] == keys[:-1]])
        found = [np.isin(p, twice, assume_unique=True) for p in parts]
        return [(r["chunk"], r["bucket"], np.packbits(x).tobytes()) for r, x in zip(rows, found, strict=True) if x.any()]

    def suffixes(row: dict, answers: list[dict]) -> dict:
        ids, text, ends = load(row["docs"])
        data = np.frombuffer(text, np.uint8)
        lo, hi, place, hashes = anchors(data, ends)
        keys = _keys(hashes, buckets)
        doc = np.searchsorted(ends, place, side="right")
        every = np.unique(keys)
        marked = np.zeros(len(every), bool)
        bits = {a["bucket"]: a["bits"] for a in answers}
        for b, s in by_value(every >> np.uint64(32)):
            if b in bits:
                marked[s] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=s.stop - s.start)
        which = np.searchsorted(every, keys)
        number = ordered_ids(ids)
        first, last = np.full(len(every), np.iinfo(np.int64).max), np.full(len(every), np.iinfo(np.int64).min)
        np.minimum.at(first, which, number[doc])
        np.maximum.at(last, which, number[doc])
        use = np.flatnonzero((marked | (first < last))[which])
        range_ = np.searchsorted(shared.value, heads(data, place[use]) >> np.uint64(1), side="right")
        found: dict[int, dict[tuple, list[int]]] = {}
        for i, b, left, start, stop in zip(use.tolist(), range_.tolist(), (place - lo)[use].tolist(), lo[use].tolist(), (hi + SPAN)[use].tolist(), strict=True):
            found.setdefault(b, {}).setdefault((left, text[start:stop]), []).append(i)
        out: dict = {"bucket": [], "chunk": [], "suffixes": []}
        for b, texts in found.items():
            runs = np.array([i for x in texts.values() for i in x], np.int64)
            out["bucket"].append(b)
            out["chunk"].append(row["chunk"])
            out["suffixes"].append(
                dump(
                    np.array([k[0] for k in texts], np.uint8),
                    np.array([len(k[1]) for k in texts], np.uint16),
                    b"".join(k[1] for k in texts),
                    np.array([len(x) for x in texts.values()], np.int32),
                    number[doc[runs]],
                    lo[runs],
                )
            )
        return out

    def without(row: dict, answers: list[dict]) -> dict:
        ids, text, ends = load(row["docs"])
        edge = np.zeros(len(text) + 1, np.int32)
        for a in answers:
            steps, sizes = load(a["ranges"])
            at = np.cumsum(steps)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + sizes, -1)
        goes = np.cumsum(edge[:-1]) > 0
        data = np.frombuffer(text, np.uint8)
        out: dict = {n: [] for n in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept)}
        start = 0
        for i, e in zip(ids, ends.tolist(), strict=True):
            g = goes[start:e]
            kept = data[start:e][~g].tobytes()
            for n, x in zip(out, (i, e - start, int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept), strict=False):
                out[n].append(x)
            start = e
        return out

    marks = per_bucket(per_chunk(chunks, own, "bucket int, chunk long, keys binary"), common, "chunk long, bucket int, bits binary")
    sent = answered(chunks, marks, suffixes, "bucket int, chunk long, suffixes binary")
    ranges = per_bucket(sent, _compare, "chunk long, ranges binary")
    return answered(chunks, ranges, without, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
