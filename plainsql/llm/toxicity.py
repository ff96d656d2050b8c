"""Toxicity classifier with a counterfactual penalty.

Logistic regression on hashed words and their beginnings, so that unseen forms of a stem count too. Wherever a labelled text names a group, the same text with that term
swapped for another of its kind is scored too, and the squared difference of the two scores is penalised, so a neutral mention
of a group neither raises nor lowers a score. The fit sees a bounded sample on the driver; all whole texts are scored.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsql.llm.ftrl import FTRL, Rates, sigmoid
from plainsql.llm.linear import BITS, SAMPLE_ROWS, sample, scored
from plainsql.llm.text import Cache

#: Terms that name a group, by kind and language; a term is swapped for others of its row.
IDENTITY_TERMS = (
    "women men girls boys", "woman man girl boy", "gay straight lesbian bisexual transgender", "muslim christian jewish hindu buddhist atheist", "muslims christians jews hindus buddhists atheists",
    "black white asian latino african european", "immigrants refugees natives foreigners", "deaf blind disabled", "old young elderly",
    "frauen männer mädchen jungen", "muslime christen juden hindus", "ausländer flüchtlinge einheimische",
    "femmes hommes filles garçons", "musulmans chrétiens juifs hindous", "immigrés réfugiés étrangers",
    "mujeres hombres niñas niños", "musulmanes cristianos judíos hindúes", "inmigrantes refugiados extranjeros",
)
#: Lengths of the beginnings of words that are features beside the word.
STEMS = (4, 5, 6)
EPOCHS = 4
RATES = Rates(alpha=0.5, l1=1.5, l2=0.2)
#: Weight of the squared difference of the scores of a text and its counterfactual.
PENALTY = 1.0


class Forms(Cache):
    """word -> numbers of its features."""

    def make(self, word: str) -> tuple[int, ...]:
        plain = word.strip(PUNCTUATION)
        names = [plain, *(f"{n}\0{plain[:n]}" for n in STEMS if len(plain) >= n)] if plain else []
        return tuple(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> (64 - BITS) for w in names)


PUNCTUATION = ".,;:!?\"'()[]{}*#$%&|<>-_"
FORMS = Forms()


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts end to end, each once in a text and in order, and how many each text has."""
    parts = [np.unique(np.fromiter(chain.from_iterable(map(FORMS.__getitem__, set(t.lower().split()))), np.int64)) for t in texts]
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.array([len(x) for x in parts], np.int64)


OTHERS = {t: [x for x in row.split() if x != t] for row in IDENTITY_TERMS for t in row.split()}
TERM = re.compile(r"\b(" + "|".join(sorted(OTHERS, key=len, reverse=True)) + r")\b", re.IGNORECASE)


def swapped(text: str, rng: np.random.Generator) -> str | None:
    """The text with each group it names swapped for another of its kind; None if it names none."""
    if not TERM.search(text):
        return None
    return TERM.sub(lambda m: (others := OTHERS[m[0].lower()])[rng.integers(len(others))], text)


def fit(rows: list[tuple[str, int]], rates: Rates = RATES, epochs: int = EPOCHS, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias. A feature counts once in a text, however long the text is."""
    model, bias = FTRL(1 << BITS, rates), 1 << BITS
    rng = np.random.default_rng(7)

    def once(texts: list[str]) -> list[np.ndarray]:
        found, n = features(texts)
        return [found[e - k : e] for e, k in zip(np.cumsum(n), n, strict=True)]

    plain = once([t for t, _ in rows])
    for _ in range(epochs):
        other = [swapped(t, rng) for t, _ in rows]
        pairs = dict(zip([i for i, t in enumerate(other) if t is not None], once([t for t in other if t is not None]), strict=True))
        for i in rng.permutation(len(rows)):
            at = np.append(plain[i], bias)
            w = model.weights(at)
            margin = w.sum()
            model.step(at, w, np.full(len(at), sigmoid(margin) - rows[i][1]))
            if i in pairs:
                a, b = np.setdiff1d(plain[i], pairs[i]), np.setdiff1d(pairs[i], plain[i])
                if len(a) or len(b):
                    at, sign = np.concatenate([a, b]), np.concatenate([np.ones(len(a)), -np.ones(len(b))])
                    w = model.weights(at)
                    s, t = sigmoid(margin), sigmoid(margin - (w * sign).sum())
                    slope = np.where(sign > 0, s * (1 - s), t * (1 - t))
                    model.step(at, w, 2 * penalty * (s - t) * slope * sign)
    return model.all_weights()


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = SAMPLE_ROWS, row: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of each whole text, and the column ``row`` as it is if one is named.

    Null and empty texts get the score of the bias. Labels that are null or neither 0 nor 1, of a null doc_id, or of held-out
    rows are not learned from; the larger of two labels of a doc_id counts. A null doc_id is not held out.
    """
    weights, bias = fit(sample(docs, labels, "toxic", rows))
    return scored(docs, weights, bias, features, row=row).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
