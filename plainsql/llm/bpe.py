"""Byte-level BPE by forced boundaries.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never be merged across, so every such place is
a certain token boundary. A word of the pre-tokenizer is cut there, each fragment is encoded alone, and the ids are joined.
Words repeat, so a bounded cache keeps the ids of the last ones. One pass over the rows, no shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from plainsql.llm.text import CACHE_ENTRIES, HELD, ready, slices, tidied

#: The pre-tokenizer's pattern, a fixed value of the vocabulary.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space as that pattern has it (Unicode's White_Space), which is not str.isspace().
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs that the pattern never crosses: a blank at most and what is not white space, or white space.
CHUNKS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_letters() -> dict[str, int]:
    """The letters that vocabulary files write for bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Encoder and decoder for one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        for i, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if spec["model"]["vocab"][a + b] != 256 + i:
                raise ValueError("ids do not follow the order of the merges")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content in self.special:
            ranks.pop(content.encode(), None)
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self.piece = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        inside = np.zeros((256, 256), bool)
        for b in ranks:
            inside[list(b[:-1]), list(b[1:])] = True
        self.forced = ~inside
        self.rows = [bytes(r) for r in self.forced]
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def fragments(self, word: bytes) -> list[bytes]:
        """The word cut wherever two neighbouring bytes stand together in no token."""
        if len(word) <= 64:
            rows = self.rows
            cuts = [i for i, (a, b) in enumerate(pairwise(word), 1) if rows[a][b]]
        else:
            b = np.frombuffer(word, np.uint8)
            cuts = (np.flatnonzero(self.forced[b[:-1], b[1:]]) + 1).tolist()
        return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)], strict=True)] if cuts else [word]

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        for word in WORDS.findall(chunk):
            for fragment in self.fragments(word.encode("utf-8")):
                out += self.piece(fragment)
        ids = tuple(out)
        if len(chunk) <= 64:
            if len(self.cache) >= 2 * CACHE_ENTRIES:
                self.cache.clear()
            self.cache[chunk] = ids
        return ids

    def _plain(self, text: str) -> list[tuple[int, ...]]:
        cache, make = self.cache, self._chunk
        return [cache.get(c) or make(c) for c in CHUNKS.findall(text)]

    def encode(self, text: str) -> list[int]:
        if self.split and any(s in text for s in self.special):
            out: list[int] = []
            for part in self.split.split(text):
                out += [self.special[part]] if part in self.special else chain.from_iterable(self._plain(part))
            return out
        return list(chain.from_iterable(self._plain(text)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


CODERS: dict[str, ForcedBoundaryBPE] = {}
HELD["bpe"] = CODERS


def coder(path: str) -> ForcedBoundaryBPE:
    """One coder for each worker and vocabulary."""
    if path not in CODERS:
        CODERS[path] = ForcedBoundaryBPE(path)
    return CODERS[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int> of each whole text. Null and empty texts: no ids."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([coder(path).encode(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return ready(docs).mapInArrow(tidied(make, "bpe"), "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, text of the rows of ``encoded``. Null ids: null text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if x is None else coder(path).decode(x) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(tidied(make, "bpe"), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of ``encoded`` and of the ids decoded again, in one pass.

    Null and empty texts: 0 tokens. Repeated rows: each its own row.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            c, n, first, second = coder(path), [], [], []
            for t in b.column("text").to_pylist():
                ids = c.encode(t)
                n.append(len(ids))
                first.append(hashlib.sha256(",".join(map(c.text_of.__getitem__, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return ready(docs).mapInArrow(tidied(make, "bpe"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
