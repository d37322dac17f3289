"""Viewsheds by tiles against a cell-by-cell sweep, and the sweep against its definition."""

import math

import numpy as np
import pytest

from tarnscape.operators import sight
from test_operators import grid

R2 = 2 * 6_371_000.0


def plain(z, row, col, height, res, target=0.0, radius=0.0, k=0.13):
    """One cell after the other, straight from the definition: octants, two rows of slack, clamped neighbours."""
    n, m = z.shape
    curve = 0.0 if k is None else (1 - k) / R2
    row, col = min(max(row, 0.0), n - 1.0), min(max(col, 0.0), m - 1.0)
    r, c = int(row), int(col)
    fr, fc = row - r, col - c
    g = lambda a, b: z[min(a, n - 1), min(b, m - 1)]
    ground = (g(r, c) * (1 - fc) + (g(r, c + 1) * fc if fc else 0)) * (1 - fr)
    if fr:
        ground += (g(r + 1, c) * (1 - fc) + (g(r + 1, c + 1) * fc if fc else 0)) * fr
    level = ground + height
    seen = np.zeros(z.shape, bool)
    for sweep in range(4):
        turned = [z, z[:, ::-1], z.T, z[::-1].T][sweep]
        mask = [seen, seen[:, ::-1], seen.T, seen[::-1].T][sweep]
        oy = row if sweep < 2 else col
        rows, width = turned.shape
        before, window = None, None
        for x in range([math.floor(col) + 1, m - math.ceil(col), math.floor(row) + 1, n - math.ceil(row)][sweep], width):
            away = [x - col, col - (m - 1 - x), x - row, row - (n - 1 - x)][sweep]
            lo, hi = (math.ceil(oy - away), math.floor(oy + away)) if sweep < 2 else (math.floor(oy - away) + 1, math.ceil(oy + away) - 1)
            now = {}
            for y in range(max(lo - 2, 0), min(hi + 2, rows - 1) + 1):
                limit = -1e30
                if before is not None:
                    at = oy + (y - oy) * (away_before / away)
                    f = math.floor(at)
                    p, q = (before[min(max(v, window[0]), window[1])] for v in (f, f + 1))
                    limit = p + (q - p) * (at - f)
                d2 = ((y - oy) ** 2 + away * away) * res * res
                eff = turned[y, x] - curve * d2 - level
                now[y] = limit if np.isnan(eff) else max(eff / math.sqrt(d2), limit)
                mask[y, x] |= bool((abs(y - oy) <= away if sweep < 2 else abs(y - oy) < away) and (eff + target) / math.sqrt(d2) >= limit and (radius <= 0 or d2 <= radius * radius))
            before, window, away_before = now, (min(now), max(now)), away
    seen[min(math.floor(row + 0.5), n - 1), min(math.floor(col + 0.5), m - 1)] = True
    return seen


PLACES = [(3, 3), (25.5, 20.2), (63, 59), (10, 40), (15.5, 15.5), (16, 31.9), (31.2, 16), (0, 0), (-5, 200), (47.99, 0.01)]


def rough(n, m, seed, holes=0.0):
    rng = np.random.default_rng(seed)
    z = rng.normal(0, 3, (n, m)).cumsum(0).cumsum(1) / 20
    z[rng.random((n, m)) < holes] = np.nan
    return z


@pytest.mark.parametrize("holes", [0.0, 0.2])
def test_sweep_equals_the_definition(holes):
    z = rough(64, 60, 1, holes)
    for i, (r, c) in enumerate(PLACES):
        how = {"target": 2.0 * (i % 2), "radius": 40.0 * (i % 3), "k": None if i % 4 == 3 else 0.13}
        assert (sight.visible_from(z, r, c, 1.7, 2.0, **how) == plain(z, r, c, 1.7, 2.0, **how)).all()


@pytest.mark.parametrize(("tile", "radius"), [(8, 0.0), (13, 0.0), (8, 30.0), (512, 0.0)])
def test_tiles_equal_the_whole_grid(spark, tile, radius):
    """Grids of 8 x 8 tiles, ragged tiles, missing tiles and holes."""
    grids = {0: rough(64, 60, 2), 1: rough(61, 64, 3, 0.3), 2: rough(9, 40, 4), 3: rough(1, 30, 5)}
    grids[1][16:32, 24:48] = np.nan
    rows = [(g, r, c, None if np.isnan(v) and (r + c) % 2 else float(v)) for g, z in grids.items() for (r, c), v in np.ndenumerate(z)]
    cells = spark.createDataFrame(rows, "grid_id long, r int, c int, z double")
    rows = [(10 * g + i, g, float(r), float(c), 1.7) for g in grids for i, (r, c) in enumerate(PLACES)]
    odd = [(900, 77, 1.0, 1.0, 1.7), (901, 0, None, 1.0, 1.7), (902, 0, 5.0, 5.0, None)]
    o = spark.createDataFrame(rows + odd, "obs_id long, grid_id long, row double, col double, height double")
    got = {}
    for r in sight.viewshed(cells, o, 2.0, radius, tile=tile).collect():
        at = got.setdefault(r.obs_id, set())
        assert (r.r, r.c) not in at
        at.add((r.r, r.c))
    assert set(got) == {r[0] for r in rows}
    for i, g, row, col, height in rows:
        want = sight.visible_from(grids[g], row, col, height, 2.0, radius=radius)
        assert got[i] == set(zip(*(v.tolist() for v in np.nonzero(want)), strict=True)), (i, g)


def test_no_array_is_larger_than_a_tile(spark, monkeypatch):
    """Sizes that a sweep holds: its tiles (two where the eye looks across a seam), a column, and edges."""
    sizes = []
    plain_tile = sight.Sweep.tile

    def watched(self, side, x0, y0, z):
        sizes.append((z.size, len(self.next)))
        return plain_tile(self, side, x0, y0, z)

    monkeypatch.setattr(sight.Sweep, "tile", watched)
    z = rough(64, 64, 6)
    s = [sight._sweep(d, 30.5, 15.9, 5.0, 64, 64, **sight._how(2.0, 0.0, 0.0, 0.13)) for d in "EWSN"]
    for x in s:
        x.tile(0, 0, 0, z[:16, :16])
    assert max(a for a, _ in sizes) == 256 and max(b for _, b in sizes) == 64 + 2 * sight.EDGE


def test_no_cells_and_no_observers(spark):
    o = spark.createDataFrame([], "obs_id long, grid_id long, row double, col double, height double")
    cells = grid(spark, rough(9, 9, 1))
    assert sight.viewshed(cells, o, 2.0).count() == 0
    some = spark.createDataFrame([(1, 0, 1.0, 1.0, 1.7)], o.schema)
    assert sight.viewshed(cells.limit(0), some, 2.0).count() == 0


def test_eyes_of_a_grid_look_together(spark):
    """A tile goes to many eyes at once, whose places differ, and each sees what it sees alone."""
    z = rough(40, 40, 3)
    rows = [(i, 0, (i * 7 % 390) / 10, (i * 13 % 380) / 10, 1.7) for i in range(60)]
    o = spark.createDataFrame(rows, "obs_id long, grid_id long, row double, col double, height double")
    got = {}
    for r in sight.viewshed(grid(spark, z), o, 2.0, tile=16).collect():
        got.setdefault(r.obs_id, set()).add((r.r, r.c))
    for i, _, row, col, height in rows:
        assert got[i] == set(zip(*(v.tolist() for v in np.nonzero(sight.visible_from(z, row, col, height, 2.0))), strict=True)), i
    s = sight._sweeps("E", 40, 40, **sight._how(2.0, 0.0, 0.0, 0.13))
    assert s.tile([3, 9], np.array([5.5, 9.0]), np.array([5.5, 9.0]), np.array([9.0, 9.0]), 0, 0, 0, z[None, :16, :16], np.zeros(2, int)).shape == (2, 16, 16)
