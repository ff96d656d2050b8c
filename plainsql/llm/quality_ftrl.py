"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

The fit sees a bounded sample of labelled rows (``SAMPLE_ROWS``) on the driver. Scores are sparse dot products of all whole
texts with the weights, whose size is fixed by the number of hash bits, in one pass without a shuffle.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsql.llm.ftrl import FTRL, Rates, sigmoid
from plainsql.llm.linear import BITS, SAMPLE_ROWS, ngrams, sample, scored

#: Words one by one and in pairs, and the shapes of words.
features = partial(ngrams, orders=(1, 2), shapes=True)
EPOCHS = 3


def fit(rows: list[tuple[str, int]], rates: Rates = Rates(), epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias. A feature's value is its count over the square root of the text's number of features.

    Without rows, or with one label only, the weights that result are those of that evidence (none: all 0, scores 0.5).
    """
    model, bias = FTRL(1 << BITS, rates), 1 << BITS
    found, n = features([t for t, _ in rows])
    ends = np.cumsum(n)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, counts = np.unique(found[ends[i] - n[i] : ends[i]], return_counts=True)
            at, x = np.append(at, bias), np.append(counts / max(n[i], 1) ** 0.5, 1.0)
            w = model.weights(at)
            model.step(at, w, (sigmoid(w @ x) - rows[i][1]) * x)
    return model.all_weights()


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of each whole text.

    Null and empty texts get the score of the bias. Labels that are null or neither 0 nor 1, of a null doc_id, or of held-out
    rows are not learned from; the larger of two labels of a doc_id counts. A null doc_id is not held out.
    """
    weights, bias = fit(sample(docs, labels, "quality", rows))
    return scored(docs, weights, bias, features, root=True).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
