"""The classifier chain against a plain loop over folds and categories."""

import numpy as np
import pyarrow as pa
from test_operators import frame, labelled

from corpuslens.llm import toxicity


def sample():
    texts, toxic, good = labelled()
    t, g = np.array(toxic), np.array(good)
    return toxicity.features(pa.array(texts)), np.stack([t & g, t & (1 - g), t], axis=1).astype(float)


def plain_link(x, fed, y, rows):
    own = y[rows]
    if own.min() == own.max():
        return lambda x, fed: np.full(len(x.offsets) - 1, own[0])
    w, v = toxicity.logistic(x.rows(rows), np.column_stack([fed[rows], np.ones(len(rows))]), own, 1 << toxicity.BUCKETS_LOG2)

    def probability(x, fed):
        out = []
        for i in range(len(x.offsets) - 1):
            odds = sum(w[c] for c in x.columns[x.offsets[i] : x.offsets[i + 1]]) + sum(a * b for a, b in zip(fed[i], v[:-1], strict=True)) + v[-1]
            out.append(min(max(1 / (1 + np.exp(-min(max(odds, -30), 30))), 1e-6), 1 - 1e-6))
        return np.array(out)

    return probability


def test_links_learn_from_out_of_fold_probabilities():
    x, y = sample()
    fold = np.arange(len(y)) % toxicity.FOLDS
    chain = toxicity.fit_chain(x, y, fold)
    fed, final = np.zeros((len(y), 0)), np.zeros((len(y), 0))
    for c in range(y.shape[1]):
        out = np.zeros(len(y))
        for f in range(toxicity.FOLDS):
            mine, others = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            out[mine] = plain_link(x, fed, y[:, c], others)(x.rows(mine), fed[mine])
        whole = plain_link(x, fed, y[:, c], np.arange(len(y)))
        final = np.column_stack([final, whole(x, final)])
        fed = np.column_stack([fed, out])
    assert np.allclose(chain(x), final, atol=1e-9)


def test_the_verdict_comes_through_the_chain():
    """Without what the earlier categories say, the last category's probabilities are others, and so are some verdicts at some threshold."""
    x, y = sample()
    chain = toxicity.fit_chain(x, y, np.arange(len(y)) % toxicity.FOLDS)
    w, v = chain.links[-1]
    assert np.abs(v[:-1]).max() > 0.01
    cut = toxicity.Chain([*chain.links[:-1], (w, np.r_[np.zeros(len(v) - 1), v[-1]])])
    p, q = chain(x)[:, -1], cut(x)[:, -1]
    assert np.abs(p - q).max() > 0.01 and any(((p >= t) != (q >= t)).any() for t in (p + q) / 2)


def test_columns_and_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (2, None, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(frame(spark, ["a", None, "", "b " * 5000], ids=[0, None, 2, 2]), toxicity.categories(labels))
    assert rows.columns == ["doc_id", "p_toxic_prose", "p_toxic_junk", "p_toxic", "toxic"]
    got = rows.collect()
    assert sorted((r.doc_id for r in got), key=repr) == [0, 2, 2, None] and all(r.toxic == (r.p_toxic >= 0.3) for r in got)
