"""Cells of features are brought together in batches before they are shuffled."""

import numpy as np
import pandas as pd

from tarnscape.operators import vectors


def test_a_batch_keeps_one_row_a_cell():
    rng = np.random.default_rng(5)
    runs = pd.DataFrame({"feature_id": rng.integers(0, 40, 300), "area": rng.integers(0, 6, 300) / 2.0, "r": rng.integers(-3, 4, 300), "c0": rng.integers(-9, 9, 300)})
    runs["c1"] = runs["c0"] + rng.integers(0, 7, 300)
    want = {}
    for x in runs.itertuples():
        for c in range(x.c0, x.c1 + 1):
            want[x.r, c] = min(want.get((x.r, c), (np.inf, 0)), (x.area, -x.feature_id))
    (got,) = vectors._best(iter([runs]))
    assert len(got) == len(want) and {(x.r, x.c): (x.area, -x.feature_id) for x in got.itertuples()} == want


def test_long_runs_lines_and_ties_burn_as_their_cells(spark):
    ring = lambda f, x0, y0, x1, y1: [(f, 0, k, x, y, True, False) for k, (x, y) in enumerate([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])]
    rows = ring(1, 0.0, 0.0, 700.0, 3.0) + ring(2, 300.0, 0.0, 400.0, 21.0) + ring(3, 0.0, 1.0, 100.0, 22.0) + [(4, 0, 0, 350.5, 1.5, False, False), (5, 0, 0, 600.5, 0.5, False, False), (5, 0, 1, 603.5, 0.5, False, False)]
    v = spark.createDataFrame(rows, "feature_id long, ring int, seq int, x double, y double, closed boolean, hole boolean")
    values = spark.createDataFrame([(f, 10 * f) for f in range(1, 6)], "feature_id long, value int")
    got = {(x.r, x.c): (x.feature_id, x.value) for x in vectors.burned(v, values, 1.0).collect()}
    # all three areas are 2,100, so the larger number wins; lines have no area
    want = {(r, c): (1, 10) for r in range(3) for c in range(700)} | {(r, c): (2, 20) for r in range(21) for c in range(300, 400)} | {(r, c): (3, 30) for r in range(1, 22) for c in range(100)}
    want |= {(1, 350): (4, 40)} | {(0, c): (5, 50) for c in range(600, 604)}
    assert got == want
    plan = vectors.burned(v, values, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortAggregate") < plan.index("MapInPandas")  # cells come to the sort in batches
