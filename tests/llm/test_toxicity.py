from __future__ import annotations

import zlib

import numpy as np
import pytest

from tests.llm import plain
from tripletspark.llm import toxicity as tox


def test_gradients_follow_the_loss():
    """Analytic gradients against differences of the loss, in the same single precision."""
    p = tox.new_weights(1)
    windows = [["a", "bad", "day"], ["good"], ["x"] * 7 + ["bad"]]
    y = np.array([1, 0, 1], np.float32)

    def loss() -> float:
        _, _, z = tox.window_logits(p, tox.Inputs(p), windows)
        z = z.astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - y * z))
    g = tox._step(p, windows, y)
    rng = np.random.default_rng(0)
    for name in ("wf", "wb", "uf", "ub", "cf", "cb", "att", "out", "bias"):
        for _ in range(3):
            at = tuple(int(rng.integers(n)) for n in p[name].shape)
            old = p[name][at]
            p[name][at] = old + 1e-2
            up = loss()
            p[name][at] = old - 1e-2
            down = loss()
            p[name][at] = old
            assert (up - down) / 2e-2 == pytest.approx(float(g[name][at]), abs=2e-3)


def test_windows_cover_every_word():
    for n in (0, 1, tox.WINDOW, tox.WINDOW + 1, 500):
        own = {k for s in tox.window_starts(n) for k in range(s, min(n, s + tox.WINDOW))}
        assert own == set(range(n))


def test_held_out_accuracy(spark, sf):
    insults = ["zorgface", "blimhead", "grotwit"]
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        words = [f"w{int(k)}" for k in rng.integers(0, 300, int(rng.integers(5, 300)))]
        if i % 3 == 0:
            for k in {int(rng.integers(len(words))) for _ in range(1 + len(words) // 30)}:
                words[k] = insults[int(rng.integers(3))] + "s" * (i % 2)  # as dense as given ones
        rows.append((i, " ".join(words), "a"))
    rows += [(9000, None, "a"), (9001, "", "a"), (None, "zorgface", None), (9002, "é" * 90_000, "a"),
             (9003, "zorgface " * 5000, "a"), (9003, "zorgface " * 5000, "a")]
    docs = plain.documents(spark, sf, rows).where("doc_id is null or doc_id < 600 or doc_id >= 9000")
    docs = docs.where("source = 'a' or source is null")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)] + [(None, 1, 1),
                                   (3, 1, None), (5, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = tox.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None
                              and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    test = [(r.predicted, int(r.doc_id % 3 == 0)) for r in got
            if r.held_out and r.doc_id < 600]
    assert np.mean([a == b for a, b in test]) >= 0.95
    assert tox.toxicity(docs.limit(0), labels.limit(0)).count() == 0
