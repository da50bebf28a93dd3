"""Every window of every training document gives the language model a gradient."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cadenza.llm import lm
from cadenza.llm.common import text_buffer


def test_every_window_is_trained(spark):
    for count in (7, 8, 9, 10):
        texts = [" ".join(f"t{k}" for k in range(5 * lm.WINDOW - 1))] * count
        offsets, data = text_buffer(pa.array(texts[:1]))
        h, kind, _ = lm.tokens(data, offsets)
        start = lm.Model(np.unique(h))
        rows = start.index(h, kind)
        got = lm._averaged(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), start)
        moved = np.abs(got["x"] - start.w["x"]).max(1)[rows[:-1]] > 1e-4
        assert [moved[a : a + lm.WINDOW - 1].all() for a in range(0, 5 * lm.WINDOW, lm.WINDOW)] == [True] * 5


def test_weights_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS id", "coalesce(text, '') AS text")
    offsets, data = text_buffer(pa.array([r.text for r in docs.limit(20).collect()]))
    start = lm.Model(np.unique(lm.tokens(data, offsets)[0])[: lm.FREQUENT])
    one, other = (lm._averaged(docs.repartition(n), start, 3) for n in (1, 7))
    assert all((one[k] == other[k]).all() for k in one)


def test_only_tokens_take_steps(monkeypatch):
    """Lanes whose document has ended take no step, in training and in scoring; scores are those of a plain loop."""
    rng = np.random.default_rng(4)
    first = np.r_[0, np.cumsum([40, 1, 17, 33])]
    rows = rng.integers(0, lm.FREQUENT + lm.RARE, first[-1])
    model, steps, plain = lm.Model(np.arange(lm.FREQUENT)), [], lm.Model._step

    def counted(self, *args):
        steps.append(len(args[-1]))
        return plain(self, *args)

    monkeypatch.setattr(lm.Model, "_step", counted)
    model.train(rows, first)
    got = model.score(rows, first)
    assert sum(steps) == 2 * len(rows)
    w, k, want = model.w, lm.HIDDEN, []
    soft = lambda x: x - np.log(np.exp(x).sum())
    for a, b in zip(first[:-1], first[1:], strict=True):
        h = np.zeros(k)
        for row in rows[a:b]:
            c = row // lm.CLASS if row < lm.FREQUENT else lm.FREQUENT // lm.CLASS + row - lm.FREQUENT
            ln = soft(h @ w["c"] + w["d"])[c]
            want.append(ln + soft(h @ w["f"][c] + w["g"][c])[row % lm.CLASS] if row < lm.FREQUENT else ln)
            x, u = w["x"][row] + w["b"], h @ w["u"]
            z, r = 1 / (1 + np.exp(-(x[:k] + u[:k]))), 1 / (1 + np.exp(-(x[k : 2 * k] + u[k : 2 * k])))
            n = np.tanh(x[2 * k :] + r * u[2 * k :])
            h = n + z * (h - n)
    assert np.allclose(got, want, atol=1e-4)
