"""Training with all token vectors in every task."""

from __future__ import annotations

import numpy as np

from passagemill.operators import training as tr
from passagemill.session import recorded


def test_training_ways_agree(spark, monkeypatch):
    """Ids repeat or are null, texts are null or hold no known token; no row per passage and token is written."""
    words = lambda i: " ".join(f"w{i * j % 29}" for j in range(1, 1 + i % 9))
    rows = [(i % 17 if i % 23 else None, words(i) if i % 13 else None, [float(i * k % 7) - 3 for k in range(5)]) for i in range(200)]
    features = spark.createDataFrame(rows, "passage_id int, text string, vector array<double>")
    vocabulary = tr.build_vocabulary(features, size=20)
    with recorded() as paths:
        model, losses = tr.train_static_model(features, vocabulary)
    assert not any("/shares-" in p for p in paths)
    monkeypatch.setattr(tr, "STATIC_BROADCAST_BYTES", 1)
    joined, same = tr.train_static_model(features, vocabulary)
    assert np.allclose(losses, same) and losses[-1] < losses[0]
    mine, theirs = ({r["token"]: (r["weight"], r["vector"]) for r in m.collect()} for m in (model, joined))
    assert mine.keys() == theirs.keys() and len(mine) == 20
    assert all(np.allclose(mine[t][1], theirs[t][1]) and mine[t][0] == theirs[t][0] for t in mine)
