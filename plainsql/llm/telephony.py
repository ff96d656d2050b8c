"""Telephony audio: companded and ADPCM samples expanded to 16-bit PCM, resampled and stored.

Mu-law and A-law bytes go through tables of 256 entries. ADPCM blocks of one batch are decoded side by side: each numpy step
takes the next nibble of every block, so the Python loop has the length of a block, not of the audio.
All arithmetic is on integers; a text's result does not depend on what shares its batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plainsql.llm.text import ready, slices, tidied

#: Bytes of an ADPCM block, and of what a payload is padded to a multiple of.
BLOCK = 576
FILL = 255
RATE = 8000
#: Format tags of the container, fixed values of the format.
TAGS = {"alaw": 6, "mulaw": 7}
#: Fixed values of the ADPCM scheme: changes of the step index by the three low bits of a nibble.
INDEX_STEPS = (-1, -1, -1, -1, 2, 4, 6, 8)
#: Fixed values of the ADPCM scheme: quantiser step sizes.
STEP_SIZES = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544,
    598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899,
    15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)


def _mulaw_table() -> np.ndarray:
    x = ~np.arange(256) & 0xFF
    size = (((x & 15) << 3) + 132 << (x >> 4 & 7)) - 132
    return np.where(x & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    x = np.arange(256) ^ 0x55
    low, exponent = (x & 15) << 4, x >> 4 & 7
    size = np.where(exponent == 0, low + 8, (low + 264) << np.maximum(exponent - 1, 0))
    return np.where(x & 128, size, -size).astype(np.int16)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By step index * 16 + nibble: the change of the sample, and the next step index * 16."""
    step, nibble = np.array(STEP_SIZES)[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    after = np.clip(np.arange(89)[:, None] + np.array(INDEX_STEPS)[nibble & 7], 0, 88) * 16
    return np.where(nibble & 8, -size, size).astype(np.int32).ravel(), after.astype(np.int32).ravel()


EXPANSIONS = {"mulaw": _mulaw_table(), "alaw": _alaw_table()}
CHANGES, NEXT_STEPS = _adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples, a row for each row of the uint8 matrix ``blocks``; 4 bytes of header, then two samples a byte, low nibble first."""
    n, width = blocks.shape
    out = np.empty((2 * (width - 4) + 1, n), np.int16)
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88) * 16
    out[0] = sample
    body = np.ascontiguousarray(blocks[:, 4:].T).astype(np.int32)
    for i in range(width - 4):
        for k, nibble in enumerate((body[i] & 15, body[i] >> 4)):
            code = index + nibble
            sample = np.clip(sample + CHANGES[code], -32768, 32767)
            index = NEXT_STEPS[code]
            out[2 * i + 1 + k] = sample
    return out.T


def stored(payload: bytes, codec: str = "mulaw", rate: int = RATE) -> bytes:
    """A RIFF/WAVE file with the payload as its 8-bit companded samples."""
    data = payload + b"\0" * (len(payload) & 1)
    head = struct.pack("<4sIHHIIHHH", b"fmt ", 18, TAGS[codec], 1, rate, rate, 1, 8, 0) + struct.pack("<4sII", b"fact", 4, len(payload)) + struct.pack("<4sI", b"data", len(payload))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(data), b"WAVE") + head + data


def samples(media: bytes) -> tuple[bytes, str, int]:
    """The bytes of the data chunk of a RIFF/WAVE file, its codec and its rate. Raises ValueError for anything else."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, rate = 12, None, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = {v: k for k, v in TAGS.items()}.get(tag)
        if kind == b"data" and codec:
            return media[at + 8 : at + 8 + size], codec, rate
        at += 8 + size + (size & 1)
    raise ValueError("no companded samples")


def resampled(pcm: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation; ``ends`` keeps the signals in ``pcm`` apart, the last sample of each is held."""
    after = np.empty_like(pcm)
    after[:-1] = pcm[1:]
    after[ends - 1] = pcm[ends - 1]
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1::2] = (pcm.astype(np.int32) + after) >> 1
    return out


def _figures(pcm: np.ndarray, ends: np.ndarray) -> list[str]:
    """Root of the mean square, sign changes, peak, and checksum of the PCM at twice the rate, for each signal."""
    starts = np.concatenate([[0], ends[:-1]])
    wide = pcm.astype(np.int64)
    power = np.add.reduceat(wide * wide, starts)
    change = np.zeros(len(pcm), np.int64)
    change[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
    change[starts] = 0
    changes, peak = np.add.reduceat(change, starts), np.maximum.reduceat(np.abs(wide), starts)
    double = memoryview(resampled(pcm, ends).tobytes())
    return [f"rms={int(power[i] // (ends[i] - starts[i])) ** 0.5:.3f},crossings={changes[i]},peak={peak[i]},crc={zlib.crc32(double[4 * starts[i] : 4 * ends[i]]):08x}" for i in range(len(ends))]


def features(payloads: list[bytes]) -> list[str]:
    """What the bytes say as mu-law, as A-law and as ADPCM blocks. Each payload is a positive multiple of BLOCK long."""
    raw, ends = np.frombuffer(b"".join(payloads), np.uint8), np.cumsum([len(p) for p in payloads])
    parts = [[f"{name}:{x}" for x in _figures(table[raw], ends)] for name, table in EXPANSIONS.items()]
    pcm = decode_adpcm(raw.reshape(-1, BLOCK))
    parts.append([f"adpcm:{x}" for x in _figures(pcm.ravel(), ends // BLOCK * pcm.shape[1])])
    return [";".join(x) for x in zip(*parts, strict=True)]


def padded(data: bytes) -> bytes:
    return data + bytes([FILL]) * (-len(data) % BLOCK if data else BLOCK)


def as_media(docs: DataFrame, codec: str = "mulaw") -> DataFrame:
    """doc_id, n_bytes, media (binary): each whole text as a stored sound.

    Null and empty texts: a sound of BLOCK filling bytes. Repeated rows: each its own row, equal texts have equal media.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([stored(padded(t), codec) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return ready(docs).mapInArrow(tidied(make), "doc_id long, n_bytes long, media binary")


def to_pcm(media: DataFrame, factor: int = 2) -> DataFrame:
    """doc_id, rate, pcm (binary, 16-bit little-endian) of the stored sounds, at their rate or (factor 2) twice that.

    A null media gives a null pcm.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, column="media"):
            rates, out = [], []
            for m in b.column("media").to_pylist():
                if m is None:
                    rates.append(None)
                    out.append(None)
                    continue
                raw, codec, rate = samples(m)
                pcm = EXPANSIONS[codec][np.frombuffer(raw, np.uint8)]
                pcm = resampled(pcm, np.array([len(pcm)])) if factor == 2 and len(pcm) else pcm
                rates.append(rate * factor)
                out.append(pcm.astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rates, pa.int32()), pa.array(out, pa.binary())], names=["doc_id", "rate", "pcm"])

    return media.select("doc_id", "media").mapInArrow(tidied(make), "doc_id long, rate int, pcm binary")


def digests(media: DataFrame) -> DataFrame:
    """Digests of the stored sounds and of the bytes read back from them, and their features."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, column="media"):
            files = b.column("media").to_pylist()
            read = [samples(m)[0] for m in files]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("n_bytes"),
                    pa.array(map(len, read), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in read]),
                    pa.array([zlib.crc32(x[-32:]) for x in read], pa.int64()),
                    pa.array(map(len, files), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in files]),
                    pa.array(features(read)),
                ],
                names=[x.split()[0] for x in schema.split(", ")],
            )

    return media.mapInArrow(tidied(make), schema)
