"""Ring ladders against block means and horizons computed site by site."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnscape.operators import rings, terrain


def ground_of(spark, lattices):
    rows = [(g, r, c, None if np.isnan(v) else float(v)) for g, z in lattices.items() for (r, c), v in np.ndenumerate(z)]
    return spark.createDataFrame(rows, "grid_id long, r int, c int, z double")


def surfaces():
    rng = np.random.default_rng(3)
    a = 20 + rng.normal(0, 4, (64, 96)).cumsum(0) / 8
    a[10:18, 20:30] = np.nan
    a[60:, :] = np.nan
    return {0: a, 5: 3 + rng.random((40, 40))}


STEPS = [(3, 8, 1), (4, 16, 2), (5, 32, 4), (6, 64, 8)]
SITES = [(1, 0, 30, 40, 4), (2, 0, 5, 5, 8), (3, 5, 20, 20, 4), (4, 0, 33, 41, 4), (5, 9, 3, 3, 4)]


def test_pyramid_reads_each_cell_once(spark):
    z = surfaces()
    levels = rings.pyramid(ground_of(spark, z), [8, 1, 2])
    got = {(r.grid_id, r.factor, r.r, r.c): (r.total, r.n) for r in levels.collect()}
    for g, a in z.items():
        for f in (1, 2, 8):
            for r in range(math.ceil(a.shape[0] / f)):
                for c in range(math.ceil(a.shape[1] / f)):
                    block = a[r * f : r * f + f, c * f : c * f + f]
                    total, n = got.pop((g, f, r, c))
                    assert n == (~np.isnan(block)).sum() and (total is None) == (n == 0) and (not n or math.isclose(total, np.nansum(block)))
    assert not got
    sums = levels.groupBy("factor").agg(F.sum("n").alias("n")).collect()
    assert len({r.n for r in sums}) == 1
    with pytest.raises(ValueError):
        rings.pyramid(ground_of(spark, {0: np.zeros((4, 4))}), [2, 3])


def brute_ring(a, r, c, half, f):
    side, r0, c0 = 2 * half // f, r // f - half // f, c // f - half // f
    out = np.full((side, side), np.nan)
    for i in range(side):
        for j in range(side):
            y, x = (r0 + i) * f, (c0 + j) * f
            if a is not None and 0 <= y < a.shape[0] and 0 <= x < a.shape[1]:
                block = a[y : y + f, x : x + f]
                if (~np.isnan(block)).any():
                    out[i, j] = np.nanmean(block)
    return out


@pytest.mark.parametrize("repair", [None, 3.0])
def test_ladder_equals_sites_one_by_one(spark, repair):
    z = surfaces()
    chosen = SITES if repair is None else SITES[:2]
    sites = spark.createDataFrame(chosen, "site long, grid_id long, r int, c int, context int")
    ladder = spark.createDataFrame(STEPS, "ring int, half int, factor int")
    crowns = {s[0]: 10.0 * i for i, s in enumerate(chosen)}
    cells, told = rings.ring_ladder(ground_of(spark, z), sites, ladder, spark.createDataFrame(list(crowns.items()), "site long, crown double"), 400.0, 32, repair=repair)
    got = {}
    for x in cells.collect():
        got.setdefault((x.site, x.ring), {})[x.r, x.c] = (x.z, x.repair)
    want = {}
    for site, g, r, c, context in chosen:
        usable = [s for s in STEPS if s[1] > context]

        def ring(half, f, g=g, r=r, c=c):
            raw = brute_ring(z.get(g), r, c, half, f)
            if repair is not None:
                fixed = terrain.repaired(ground_of(spark, {0: raw}), repair).collect()
                raw = np.array([math.nan if x.z is None else x.z for x in sorted(fixed, key=lambda x: (x.r, x.c))]).reshape(raw.shape)
            return np.where(np.isnan(raw), 0.0, raw)

        first = {k: (half, ring(half, f)) for k, half, f in usable[:2]}
        box = next((a for half, a in first.values() if half == 32), max(first.values(), key=lambda x: x[0])[1])
        d = 3.83 * math.sqrt(max(0.0, crowns[site] + 2 - max(0.0, float(np.percentile(box, 5))))) * 1000
        want |= {(site, k): (d, a) for k, (_, a) in first.items()}
        for n, (k, half, f) in enumerate(usable[2:], 2):
            if usable[n - 1][1] * 400.0 < d:
                want[site, k] = (d, ring(half, f))
    assert set(got) == set(want)
    lines = {(x.site, x.ring): x for x in told.collect()}
    for key, (d, a) in want.items():
        assert len(got[key]) == a.size
        assert max(abs(got[key][r, c][0] - v) for (r, c), v in np.ndenumerate(a)) < 1e-9
        x = lines[key]
        sea = sum(how == "sea" for _, how in got[key].values())
        assert math.isclose(x.horizon_m, d, rel_tol=1e-9) and x.cells == a.size and math.isclose(x.low, a.min()) and math.isclose(x.high, a.max())
        assert x.line == f"ring{key[1]}: {sea} cells were sea-filled" and x.filled >= sea
