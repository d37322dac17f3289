"""Probes of the nearest-neighbour index against all cells, and its recall with three and four turns."""

import itertools

import numpy as np
import pytest

from tarnscape.llm import ann


@pytest.mark.parametrize("turns", [1, 2, 3, 4])
def test_probes_are_the_best_of_all_cells(turns):
    rng = np.random.default_rng(turns)
    h = ann.Hashes(2, 10, 1, 0)
    h.turns = turns
    y = rng.normal(size=(5, turns, h.axes)).astype(np.float32)
    for q in range(5):
        all_sums = np.sort([sum(float(y[q, j, a]) for j, a in enumerate(cell)) for cell in itertools.product(range(h.axes), repeat=turns)])[::-1]
        for probes in (1, 2, 7, 50, h.axes**turns, 10 * h.axes**turns):
            got = float(h.least(y[q : q + 1], probes)[0])
            assert got == pytest.approx(all_sums[min(probes, len(all_sums)) - 1], abs=1e-5)
        own = all_sums[[0, 3 % len(all_sums), len(all_sums) // 2, -1]]
        assert h.ranks(y[q].astype(np.float64), own).tolist() == [(all_sums > o + 1e-6).sum() for o in own]


@pytest.mark.parametrize("turns", [3, 4])
def test_recall_with_more_turns(spark, monkeypatch, turns):
    """Cells as fine as those of tables of millions and of billions of rows."""
    plain = ann.Hashes.__init__

    def finer(self, *args):
        plain(self, *args)
        self.turns = turns

    monkeypatch.setattr(ann.Hashes, "__init__", finer)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 24))
    x = (centres[rng.integers(0, 30, 1200)] + 0.45 * rng.normal(size=(1200, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id % 40 = 0"), k=10, tables=2).toPandas()
    hits = 0
    for q, part in got.groupby("query_id"):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:10]) & set(part["vec_id"]))
    assert hits / (30 * 10) >= 0.95
