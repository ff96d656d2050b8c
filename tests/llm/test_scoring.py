"""Classifiers, audio features and packing under loss limits against plain versions written from the definitions."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from plainsql.llm import linear, packing, quality_ftrl, telephony, toxicity
from plainsql.llm.ftrl import Rates

FULL = (1 << 64) - 1
TEXTS = ["", None, " \n ", "one", "The QUICK fox, the fox! 42 times\n$$ ## the end", "zzz&& " * 30, "é 日本 don't 7x7 A-b-C " * 9, "word " * 2000]


def mixed(x):
    x &= FULL
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & FULL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & FULL
    return x ^ x >> 31


def word_id(w):
    return xxhash.xxh3_64_intdigest(w.encode())


def shape(w):
    marks = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in w]
    return word_id("\0" + "".join(c for i, c in enumerate(marks) if not i or marks[i - 1] != c))


def quality_features(t):
    """Feature -> value: words, pairs of words, shapes, and shapes with whether the next word is the same."""
    words = t.split()
    ids, shapes = [word_id(w) for w in words], [shape(w) for w in words]
    found = [mixed(i + 1) for i in ids] + [mixed(a * 0x9E3779B97F4A7C15 + b) for a, b in zip(ids, ids[1:])] + shapes
    found += [mixed(s * 31 + (a == b)) for s, a, b in zip(shapes, ids, ids[1:])]
    out = {}
    for x in found:
        out[x >> 64 - linear.BITS] = out.get(x >> 64 - linear.BITS, 0) + 1 / len(found) ** 0.5
    return out


def toxic_features(t):
    plain = {w.strip(".,;:!?\"'()[]{}*#$%&|<>-_") for w in t.lower().split()} - {""}
    names = plain | {f"{n}\0{w[:n]}" for w in plain for n in (4, 5, 6) if len(w) >= n}
    return dict.fromkeys((word_id(w) >> 64 - linear.BITS for w in names), 1.0)


class Plain:
    """Follow the regularised leader, a coordinate at a time; None is the bias."""

    def __init__(self, rates):
        self.r, self.z, self.n = rates, {}, {}

    def weight(self, k):
        z, n, r = self.z.get(k, 0.0), self.n.get(k, 0.0), self.r
        l1, l2 = (0, 0) if k is None else (r.l1, r.l2)
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((r.beta + n**0.5) / r.alpha + l2)

    def update(self, gradients):
        weights = {k: self.weight(k) for k in gradients}
        for k, g in gradients.items():
            n = self.n.get(k, 0.0)
            self.z[k] = self.z.get(k, 0.0) + g - ((n + g * g) ** 0.5 - n**0.5) / self.r.alpha * weights[k]
            self.n[k] = n + g * g

    def margin(self, x):
        return sum(v * self.weight(k) for k, v in x.items()) + self.weight(None)


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def labelled(n, marks, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["women", "gay", "muslims", "old"]
    rows = [([r.choice(words) for _ in range(r.randint(0, 25))], r.random() < 0.4) for _ in range(n)]
    return [(" ".join([*w, *([r.choice(marks)] * bad)]), int(bad)) for w, bad in rows]


def plain_quality(rows):
    m, rng = Plain(Rates()), np.random.default_rng(7)
    for _ in range(quality_ftrl.EPOCHS):
        for i in rng.permutation(len(rows)):
            x = quality_features(rows[i][0])
            e = sigmoid(m.margin(x)) - rows[i][1]
            m.update({k: e * v for k, v in x.items()} | {None: e})
    return m


def plain_toxicity(rows):
    m, rng = Plain(toxicity.RATES), np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        others = [toxicity.swapped(t, rng) for t, _ in rows]
        for i in rng.permutation(len(rows)):
            x = toxic_features(rows[i][0])
            margin = m.margin(x)
            m.update(dict.fromkeys([*x, None], sigmoid(margin) - rows[i][1]))
            if others[i] is None:
                continue
            y = toxic_features(others[i])
            a, b = x.keys() - y.keys(), y.keys() - x.keys()
            s, t = sigmoid(margin), sigmoid(margin - sum(map(m.weight, a)) + sum(map(m.weight, b)))
            d = 2 * toxicity.PENALTY * (s - t)
            m.update({k: d * s * (1 - s) for k in a} | {k: -d * t * (1 - t) for k in b})
    return m


def ours_and_plain(label):
    bad = ["zzz&&", "QQ##"] if label == "quality" else ["scum", "vermin!"]
    rows = labelled(150, bad, 3)
    return (quality_ftrl, plain_quality(rows), quality_features, rows) if label == "quality" else (toxicity, plain_toxicity(rows), toxic_features, rows)


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_fit_against_a_coordinate_at_a_time(label):
    module, plain, _, rows = ours_and_plain(label)
    weights, bias = module.fit(rows)
    want = np.zeros(len(weights))
    for k in plain.z:
        if k is not None:
            want[k] = plain.weight(k)
    assert np.count_nonzero(want) > 5
    assert np.allclose(weights, want, atol=1e-9) and bias == pytest.approx(plain.weight(None))


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_query_scores_against_brute_force(spark, label):
    module, plain, features, rows = ours_and_plain(label)
    ids = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 5][: len(rows)]
    known = list(zip(ids, rows))
    held = [i for i in range(1, 400) if not zlib.crc32(str(i).encode()) % 5]
    table = [(i, t) for i, (t, _) in known] + list(zip(held, TEXTS))
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    # The sample's order is by hashes of ids, and the fit depends on it.
    labels = spark.createDataFrame([(i, y) for i, (_, y) in known] + [(i, 1) for i in held], f"doc_id long, {label} int")
    order = [r.doc_id for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    by_id = dict(known)
    plain = (plain_quality if label == "quality" else plain_toxicity)([by_id[i] for i in order])
    made = (quality_ftrl.quality if label == "quality" else toxicity.toxicity)(docs, labels).collect()
    cut = 0.3 if label == "quality" else 0.5
    texts = dict(table)
    assert len(made) == len(table)
    for r in made:
        want = sigmoid(plain.margin(features(texts[r.doc_id] or "")))
        assert r.score == pytest.approx(want, abs=1e-5) and r.held_out == (r.doc_id in held) and r.predicted == (r.score >= cut)


def mulaw(byte):
    x = 255 - byte
    size = ((2 * (x % 16) + 33) * 2 ** (x // 16 % 8) - 33) * 4
    return -size if x >= 128 else size


def alaw(byte):
    x = byte ^ 0b01010101
    part, low = x // 16 % 8, x % 16
    size = 8 * (2 * low + 1 if part == 0 else (2 * low + 33) * 2 ** (part - 1))
    return size if x >= 128 else -size


def adpcm(block):
    sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for nibble in (byte % 16, byte // 16):
            step = telephony.STEP_SIZES[index]
            change = step // 8 + (step // 4 if nibble & 1 else 0) + (step // 2 if nibble & 2 else 0) + (step if nibble & 4 else 0)
            sample = min(32767, max(-32768, sample - change if nibble & 8 else sample + change))
            index = min(88, max(0, index + telephony.INDEX_STEPS[nibble % 8]))
            out.append(sample)
    return out


def figures(x):
    twice = [v for a, b in zip(x, [*x[1:], x[-1]]) for v in (a, (a + b) // 2)]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    crc = zlib.crc32(b"".join(v.to_bytes(2, "little", signed=True) for v in twice))
    return f"rms={(sum(v * v for v in x) // len(x)) ** 0.5:.3f},crossings={crossings},peak={max(map(abs, x))},crc={crc:08x}"


def test_companding_tables_in_full():
    assert telephony.EXPANSIONS["mulaw"].tolist() == [mulaw(b) for b in range(256)]
    assert telephony.EXPANSIONS["alaw"].tolist() == [alaw(b) for b in range(256)]


def test_audio_features_against_plain_decoders(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in telephony.digests(telephony.as_media(docs)).collect():
        data = (TEXTS[r.doc_id] or "").encode()
        data += b"\xff" * (-len(data) % 576 if data else 576)
        blocks = [v for i in range(0, len(data), 576) for v in adpcm(data[i : i + 576])]
        assert r.feature == f"mulaw:{figures([mulaw(b) for b in data])};alaw:{figures([alaw(b) for b in data])};adpcm:{figures(blocks)}"


@pytest.mark.parametrize("limits", [packing.Limits(tokens=256, segments=5, loss=100, pool=16), packing.Limits(tokens=512, segments=64, loss=90, pool=64)])
def test_packing_of_conversations_by_loss(spark, limits):
    path = public_tokenizers.path("word_bpe_49k.json")
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    answers = F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)
    docs = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"), F.try_divide(F.sum(answers), F.sum(F.length("text"))).alias("share")
    )
    shares = {r.doc_id: r.share for r in docs.collect()}
    assert len({round(s, 2) for s in shares.values() if s is not None}) > 3
    rows = packing.packed(docs.repartition(3, "doc_id"), path, limits=limits, loss="share").collect()
    sequences, lengths = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    bound = 0
    for s in sequences.values():
        loss = sum(math.ceil(r.length * (1.0 if shares[r.doc_id] is None else shares[r.doc_id]) - 1e-9) for r in s)
        total = sum(r.length for r in s)
        assert total <= limits.tokens and len(s) <= limits.segments and loss <= limits.loss
        bound += loss > limits.loss - limits.segments and total < limits.tokens
    assert bound  # the limit on loss is what closes some sequences
    assert lengths == {r.doc_id: r.doc_tokens for r in rows} and lengths.keys() == shares.keys()
