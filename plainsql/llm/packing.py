"""Vector bin packing of token sequences.

A piece of a document is a vector: tokens, one segment, loss-bearing tokens. A sequence has a limit on each. The sequence at
hand takes, again and again, the piece whose vector has the largest dot product with what room is left, each dimension as a
share of its limit; pieces that don't fit are left out. Documents are longer than a sequence or don't come out even, so they
may be cut: what no piece fills is filled by cutting the shortest piece that is left.

Each task packs its own rows as they stream by, holding a bounded pool of pieces; nothing is shuffled and no key gathers rows.
What a task has at its end goes into sequences with a power of two of tokens, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from plainsql.llm.bpe import byte_letters
from plainsql.llm.text import CACHE_ENTRIES, HELD, Cache, ready, slices, tidied


@dataclass(frozen=True)
class Limits:
    """Of a sequence. ``pool``: pieces that a task holds at most before it packs."""

    tokens: int = 4096
    segments: int = 64
    loss: int = 4096
    pool: int = 2048


class Words(Cache):
    """The library's ids of a text, by way of its white-space separated chunks, whose ids this bounded cache keeps.

    The tokenizer drops white space and no token reaches across it, so chunks can be encoded alone. Chunks of common Latin
    letters are lowered and split here and go straight to the merges; all others go through the library as a whole.
    The end-of-word mark of the vocabulary is written as byte 255, which is in no UTF-8 text: its tokens with single bytes
    have the least ids, so they come first, as they should.
    """

    entries = 2 * CACHE_ENTRIES
    #: str.isspace() holds for these, the tokenizer's \s does not.
    ODD = re.compile("[\x1c-\x1f]")
    SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
    #: The vocabulary's own pattern, a fixed value.
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: Composed letters that lower one by one: up to U+024F, without the dotted capital I and the dotless forms.
    COMMON = re.compile("[!-~\xa1-\u012f\u0132-\u024f]+")
    MARK = b"\xff"

    def __init__(self, path: str, end: int) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.end = array("I", [end]).tobytes()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, suffix = byte_letters(), model["end_of_word_suffix"]
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(letters[c] for c in token.removesuffix(suffix)) + self.MARK * token.endswith(suffix): i for token, i in model["vocab"].items() if token not in special}
        self.piece = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def make(self, chunk: str) -> bytes:
        if self.COMMON.fullmatch(chunk) and "<|" not in chunk:
            low = chunk.lower()
            if low.isalpha():
                ids = self.piece(low.encode() + self.MARK)
            else:
                ids = [i for part in self.PARTS.findall(low) for i in self.piece(part.encode() + self.MARK)]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id."""
        split = (filter(None, self.SPACE.split(t)) if self.ODD.search(t) else t.split() for t in texts)
        return [b"".join(map(self.__getitem__, chunks)) + self.end for chunks in split]


TOKENIZERS: dict[tuple[str, int], Words] = {}
HELD["packing"] = TOKENIZERS


def words(path: str, end: int) -> Words:
    """One for each worker, vocabulary and end id."""
    if (path, end) not in TOKENIZERS:
        TOKENIZERS[path, end] = Words(path, end)
    return TOKENIZERS[path, end]


class Packer:
    """Streams pieces (key, start, ids, loss-bearing flags as a count) into sequences; each sequence is a list of pieces."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits
        self.size = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.pieces: list[tuple] = []

    def add(self, key: tuple, ids: bytes, loss: float) -> Iterator[list[tuple]]:
        """``loss``: the share of the tokens that bear loss. A document longer than a sequence fills whole ones first."""
        whole, start, n = self._largest(loss), 0, len(ids) // 4
        while n - start >= whole:
            yield [(key, start, ids[4 * start : 4 * (start + whole)])]
            start += whole
        if start < n:
            self.pieces.append((key, start, ids[4 * start :], loss))
        if len(self.pieces) >= self.limits.pool:
            yield from self._pack(self.limits.pool // 2)

    def finish(self) -> Iterator[list[tuple]]:
        yield from self._pack(0)

    def _largest(self, loss: float) -> int:
        return min(self.limits.tokens, int(self.limits.loss / loss) if loss else self.limits.tokens)

    def _vectors(self) -> np.ndarray:
        n = np.array([len(p[2]) // 4 for p in self.pieces], float)
        return np.stack([n, np.ones(len(n)), np.ceil(n * [p[3] for p in self.pieces])], 1)

    def _pack(self, keep: int) -> Iterator[list[tuple]]:
        """Packs until ``keep`` pieces are left; with keep 0, all of them."""
        held, vectors = self.pieces, self._vectors()
        open_, left = np.ones(len(held), bool), len(held)
        while left > keep:
            room, sequence = self.size.copy(), []
            while left:
                fits = open_ & (vectors <= room).all(1)
                if not fits.any():
                    break
                score = np.where(fits, (vectors / self.size) @ (room / self.size), -1.0)
                i = int(score.argmax())
                sequence.append(held[i][:3])
                room -= vectors[i]
                open_[i] = False
                left -= 1
            if left and room.min() >= 1:  # room in every dimension, but each piece left is too long: cut the shortest
                i = int(np.where(open_, vectors[:, 0], np.inf).argmin())
                key, start, ids, loss = held[i]
                n = int(min(room[0], room[2] / loss if loss else room[0], len(ids) // 4 - 1))
                if n:
                    sequence.append((key, start, ids[: 4 * n]))
                    held[i] = (key, start + n, ids[4 * n :], loss)
                    vectors[i] = [len(held[i][2]) // 4, 1, np.ceil(len(held[i][2]) // 4 * loss)]
            yield sequence
        self.pieces = [p for p, o in zip(held, open_, strict=True) if o]


def by_powers(sequence: list[tuple], full: int) -> Iterator[list[tuple]]:
    """A sequence that isn't full as sequences with powers of two of tokens, the largest first."""
    total = sum(len(p[2]) // 4 for p in sequence)
    if total == full:
        yield sequence
        return
    rest = list(sequence)
    for bit in reversed(range(total.bit_length())):
        need, part = total & 1 << bit, []
        while need:
            key, start, ids = rest.pop(0)
            n = min(need, len(ids) // 4)
            part.append((key, start, ids[: 4 * n]))
            if n < len(ids) // 4:
                rest.insert(0, (key, start + n, ids[4 * n :]))
            need -= n
        if part:
            yield part


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, path: str, end: int = 2, limits: Limits = Limits(), loss: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (array<int>) if asked for.

    ``loss`` names a column with the share of a document's tokens that bear loss (all of them without it or if null).
    Null and empty texts: one piece, the end id. Repeated rows: each its own document. Empty table: no rows.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def rows(sequences: Iterator[list[tuple]], place: list[int]) -> Iterator[tuple]:
        for sequence in sequences:
            for part in by_powers(sequence, limits.tokens):
                offset = 0
                for (doc_id, doc_tokens), start, ids in part:
                    yield (doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, place[0], offset, *([np.frombuffer(ids, "<u4").astype(np.int32)] if with_ids else []))
                    offset += len(ids) // 4
                place[0] += 1

    types = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids

    def batch(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[*names, "ids"][: len(types)])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, packer = [TaskContext.get().partitionId() << 40], Packer(limits)
        for b in slices(batches):
            encoded = words(path, end).ids(b.column("text").to_pylist())
            shares = b.column("loss").to_pylist() if loss else [1.0] * b.num_rows
            found: list[tuple] = []
            for doc_id, ids, share in zip(b.column("doc_id").to_pylist(), encoded, shares, strict=True):
                found += rows(packer.add((doc_id, len(ids) // 4), ids, 1.0 if share is None else min(1.0, max(0.0, share))), place)
            yield batch(found)
        yield batch(list(rows(packer.finish(), place)))

    extra = [docs[loss].cast("double").alias("loss")] if loss else []
    return ready(docs, *extra).mapInArrow(tidied(make, "packing"), SCHEMA + (", ids array<int>" if with_ids else ""))
