"""Sums over bands by a grid against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from cadenza.operators import linking


@pytest.mark.parametrize("coarse", [True, False])
def test_band_sums(spark, coarse):
    """Points on the edges of bands and cells, equal ones, energies beyond one, missing values."""
    rng = np.random.default_rng(5)
    bpm = rng.integers(60, 130, 300) * 1.0 if coarse else rng.uniform(60, 130, 300).round(3)
    energy = rng.integers(0, 22, 300) / 20 if coarse else rng.uniform(0, 1.1, 300).round(4)
    rows = [(f"p{k}", "minor" if k % 3 else "major", float(b), float(e)) for k, (b, e) in enumerate(zip(bpm, energy, strict=True))]
    rows += [("x", None, 100.0, 0.5), ("y", "major", None, 0.5), ("z", "major", 100.0, None), ("far", "major", 500.0, 0.5)]
    want = {}
    for a, mode, b, e in rows:
        if None not in (mode, b, e):
            near = [pb for p, m, pb, pe in rows if p != a and m == mode and pb is not None and pe is not None and abs(pb - b) <= 15 and max(e - 0.25, 0) <= pe <= min(e + 0.25, 1)]
            if near:
                want[a] = (len(near), round(sum(near) / len(near), 9))
    got = {r.seed: (r.n, round(r.bpm, 9)) for r in linking.band_sums(spark.createDataFrame(rows, "track_id string, mode string, bpm double, energy double")).collect()}
    assert got == want and "far" not in got
