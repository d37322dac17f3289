"""Grid, geometry, source and document operators against brute force and known shapes."""

import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnscape.operators import documents, raster, series, sight, terrain, vectors, vegetation
from tarnscape.plans import terrain as plans
from tarnscape.sources import tiles, wkb
from test_operators import grid, heap_flood

SF = "/root/testdata/sf0.001"


def surface(n, m, seed=0):
    rng = np.random.default_rng(seed)
    return np.add.outer(np.sin(np.arange(n) / 5) * 6, np.cos(np.arange(m) / 4) * 5) + rng.normal(size=(n, m))


@pytest.mark.parametrize("tile,blocks", [(8, 2), (7, 3), (64, 8)])
def test_flood_over_levels_of_blocks(spark, tile, blocks):
    z = np.round(surface(45, 38), 1)
    got = raster.sea_connectivity(grid(spark, z), tile, blocks).collect()
    want = heap_flood(z)
    assert len(got) == z.size and all(x.connect == want[x.r, x.c] for x in got)


def test_areas_by_tile_equal_areas_at_once(spark):
    low = grid(spark, np.random.default_rng(3).integers(0, 5, (40, 33))).where("z < 3")
    small, whole = ({(x.r, x.c): tuple(x.area) for x in raster.connected_areas(low, t).collect()} for t in (8, 512))
    assert small == whole and all(a[1:] <= k for k, a in small.items())


def test_distance_reaches_everywhere_and_takes_the_smallest_value(spark):
    z = np.zeros((150, 20))
    at = [(0, 0, 7), (149, 19, 3), (149, 0, 9), (0, 19, 3)]
    e = spark.createDataFrame([(0, *x) for x in at], "grid_id long, r int, c int, v int")
    got = raster.nearest_evidence(grid(spark, z), e, None, 16).collect()
    assert len(got) == 3000
    for x in got[::37]:
        d = [((x.r - r) ** 2 + (x.c - c) ** 2, v) for r, c, v in at]
        assert (x.d2, x.v) == min(d)
    assert max(x.d2 for x in raster.nearest_evidence(grid(spark, z), e, 5, 16).collect()) == 25


def brute_rows(dr, v):
    out = []
    for f, w in zip(dr, v, strict=True):
        best = [min(((int(f[j]) ** 2 + (i - j) ** 2, w[j]) for j in range(len(f)) if f[j] < raster._FAR), default=(raster._FAR**2, np.inf)) for i in range(len(f))]
        out.append(best)
    return out


def test_lower_envelope_equals_all_columns():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, m = rng.integers(1, 6), rng.integers(1, 40)
        dr = np.where(rng.random((n, m)) < rng.random(), rng.integers(0, rng.choice([2, 9, 60]), (n, m)), raster._FAR)
        v = np.where(dr < raster._FAR, rng.integers(0, 4, (n, m)), np.inf)
        d2, got = raster._along_rows(dr, v)
        assert [list(zip(a.tolist(), b.tolist(), strict=True)) for a, b in zip(d2, got, strict=True)] == brute_rows(dr, v)


def test_one_evidence_in_a_wide_row_is_quick():
    dr = np.full((64, 20_000), raster._FAR)
    dr[10, 17_000] = 0
    began = time.perf_counter()
    d2, v = raster._along_rows(dr, np.where(dr == 0, 5.0, np.inf))
    assert time.perf_counter() - began < 2 and d2[10, 0] == 17_000**2 and v[10, 19_999] == 5 and np.isinf(v[9]).all()


def test_distance_by_kind_equals_each_alone(spark):
    rng = np.random.default_rng(1)
    cells = grid(spark, np.zeros((40, 50)))
    rows = [(0, int(rng.integers(0, 40)), int(rng.integers(0, 50)), str(rng.choice(["a", "b", "x"]))) for _ in range(12)] + [(3, 1, 1, "a"), (0, 1, 1, None)]
    e = spark.createDataFrame(rows, "grid_id long, r int, c int, kind string")
    got = raster.distance_by_kind(cells, e, ["a", "b", "none"], 16)
    assert got.columns == ["grid_id", "r", "c", "a", "b", "none"] and got.count() == 2000 and got.where("none IS NOT NULL").isEmpty()
    at = {k: [(r, c) for g, r, c, kind in rows if g == 0 and kind == k] for k in "ab"}
    for x in got.collect():
        for k in "ab":
            assert x[k] == min((x.r - r) ** 2 + (x.c - c) ** 2 for r, c in at[k])


def test_fill_of_a_hole_wider_than_twenty_cells_and_of_nothing(spark):
    z = np.arange(60.0)[:, None] + np.zeros(60)
    df = grid(spark, z).withColumn("z", F.when(F.expr("r < 3 OR r > 56 OR c < 3 OR c > 56"), F.col("z")))
    got = raster.nearest_fill(df).collect()
    assert all(x.z is not None for x in got) and sum(x.filled for x in got) == 54 * 54
    assert all(x.z is None and x.filled is None for x in raster.nearest_fill(df.withColumn("z", F.lit(None).cast("double"))).collect())


def test_gradient_is_one_sided_at_edges_and_holes(spark):
    z = surface(13, 11)
    z[4, 5] = np.nan
    df = grid(spark, z).withColumn("z", F.nanvl("z", F.lit(None)))
    got = {(x.r, x.c): x for x in raster.gradient(df, 2.0, tile=4).collect()}
    for (r, c), x in got.items():
        for d, (a, b) in ((x.d_row, ((r - 1, c), (r + 1, c))), (x.d_col, ((r, c - 1), (r, c + 1)))):
            v = [z[p] if 0 <= p[0] < 13 and 0 <= p[1] < 11 else np.nan for p in (a, b)]
            want = (z[r, c] - v[0]) / 2 if np.isnan(v[1]) else (v[1] - z[r, c]) / 2 if np.isnan(v[0]) else (v[1] - v[0]) / 4
            assert (d is None and np.isnan(want)) or abs(d - want) < 1e-9


def ray_march(z, row, col, eye, res, steps=4):
    """Visibility of every cell by sampling its own line of sight, bilinearly."""
    n, m = z.shape
    out = np.zeros((n, m), bool)

    def at(r, c):
        a, b = min(int(r), n - 2), min(int(c), m - 2)
        u, v = r - a, c - b
        return (z[a, b] * (1 - v) + z[a, b + 1] * v) * (1 - u) + (z[a + 1, b] * (1 - v) + z[a + 1, b + 1] * v) * u

    top = at(row, col) + eye
    for r in range(n):
        for c in range(m):
            d = np.hypot(r - row, c - col)
            k = int(max(abs(r - row), abs(c - col)))
            way = [(i / k) for i in range(1, k)]
            mine = (z[r, c] - top) / max(d, 1e-9)
            out[r, c] = all((at(row + (r - row) * t, col + (c - col) * t) - top) / (d * t) <= mine + 1e-12 for t in way)
    return out


def test_viewshed_on_plane_ridge_and_rough_ground():
    flat = np.zeros((61, 61))
    assert sight.visible_from(flat, 30, 30, 1.7, 2.0).all()
    assert sight.visible_from(flat, 30.4, 29.7, 1.7, 2.0).all()
    inside = sight.visible_from(flat, 30, 30, 1.7, 2.0, radius=20.0)
    assert inside.sum() == sum(r * r + c * c <= 100 for r in range(-30, 31) for c in range(-30, 31))
    ridge = flat.copy()
    ridge[:, 40] = 30
    seen = sight.visible_from(ridge, 30, 20, 1.7, 2.0)
    assert seen[:, :41].all() and not seen[20:41, 42:].any()
    assert sight.visible_from(ridge, 30, 20, 1.7, 2.0, target=200.0).all()
    rough = surface(61, 61, 4) * 2
    got = sight.visible_from(rough, 30, 30, 1.7, 2.0, k=None)
    assert (got == ray_march(rough, 30, 30, 1.7, 2.0)).mean() >= 0.97
    deep = sight.visible_from(np.zeros((3, 4000)), 1, 0, 1.7, 20.0)
    assert not deep[1, 3999] and sight.visible_from(np.zeros((3, 4000)), 1, 0, 1.7, 20.0, k=None).all()


def test_repair_judges_wide_areas(spark):
    z = np.full((60, 60), 50.0)
    z[:, :10] = 3.0
    hole = np.zeros(z.shape, bool)
    hole[0:20, 0:8] = hole[30:50, 30:50] = hole[40:60, 52:60] = True  # sea by the shore, a lake, land beyond
    hole[5, 40] = True  # a speck
    df = grid(spark, z).join(spark.createDataFrame([(int(r), int(c)) for r, c in zip(*np.nonzero(hole), strict=True)], "r int, c int").withColumn("x", F.lit(1)), ["r", "c"], "left")
    df = df.select("grid_id", "r", "c", F.when(F.col("x").isNull(), F.col("z")).alias("z"))
    got = {(x.r, x.c): (x.repair, x.z) for x in terrain.repaired(df, 3.0).collect()}
    assert got[5, 3] == ("sea", 0.0) and got[40, 40] == ("still", 50.0) and got[50, 58] == ("refused", None) and got[5, 40] == ("interpolated", 50.0) and got[0, 30] == (None, 50.0)


def ring_vertices(spark, rows):
    return spark.createDataFrame(rows, "feature_id long, ring int, seq int, x double, y double, closed boolean, hole boolean")


def test_smallest_area_wins_and_lines_burn(spark):
    square = lambda i, a, b, hole=False, ring=0: [(i, ring, k + 1, float(x), float(y), True, hole) for k, (x, y) in enumerate([(a, a), (b, a), (b, b), (a, b)])]
    v = ring_vertices(spark, square(1, 0, 10) + square(2, 2, 6) + square(1, 7, 9, True, 1) + [(3, 0, 1, 0.5, 0.5, False, False), (3, 0, 2, 9.5, 0.5, False, False), (4, 0, 1, 4.5, 9.5, False, False)])
    got = {(x.r, x.c): x.value for x in vectors.burned(v, spark.createDataFrame([(i, i * 10) for i in (1, 2, 3, 4)], "feature_id long, value int"), 1.0).collect()}
    assert got[3, 3] == 20 and got[5, 8] == 10 and (8, 8) not in got and got[0, 5] == 30 and got[9, 4] == 40 and got[9, 9] == 10
    c = {x.feature_id: x for x in vectors.centroids(v).collect()}
    assert c[1].area == 96 and abs(c[1].x - (100 * 5 - 4 * 8) / 96) < 1e-9


def test_normals_and_posts(spark):
    v = ring_vertices(spark, [(1, 0, k + 1, float(x), float(y), True, False) for k, (x, y) in enumerate([(0, 0), (0, 8), (8, 8), (8, 0)])])  # clockwise
    n = {(round(x.x, 6), round(x.y, 6)): (x.nx, x.ny) for x in vectors.inward_normals(vectors.resampled(v, 1.0)).collect()}
    assert n[0, 4] == (1, 0) and n[4, 8] == (0, -1) and len(n) == 32
    p = vectors.posts(v, 3.1).collect()
    assert len(p) == 10 and {round(x.heading, 4) for x in p} <= {round(a, 4) for a in (0, np.pi / 2, -np.pi / 2, np.pi)}
    assert vectors.posts(ring_vertices(spark, [(1, 0, 1, 0.0, 0.0, False, False), (1, 0, 2, 1.0, 0.0, False, False)]), 0.4).count() == 3


def test_crest_follows_a_bank(spark):
    n = 101
    y, x = np.mgrid[:n, :n]
    d = np.hypot(x - 50, y - 50)
    z = 10 + (50 - d) * 0.02 + 3 * np.exp(-(((d - 28) / 1.5) ** 2))
    z[47:54, 70:85] = 10 + (50 - d[47:54, 70:85]) * 0.02  # an entrance
    turn = np.arange(48) * 2 * np.pi / 48
    outline = ring_vertices(spark, [(0, 0, k, float(50 + 33 * np.cos(t)), float(50 + 33 * np.sin(t)), True, False) for k, t in enumerate(turn)])
    c = terrain.crest(grid(spark, z), outline, 1.0, 3.0, 4.0, 15.0, 0.5, 8.0, 21.0, 3.0, 0.3, 3.0)
    line = c["line"].collect()
    away = np.array([np.hypot(p.x - 50, p.y - 50) for p in line])
    assert abs(np.median(away) - 28) < 0.3 and np.abs(away - 28).max() < 3
    assert c["picks"].where("rejected").count() > 3 and c["refused"].count() == 0
    s = terrain.crest_statistics(c["line"], c["picks"]).first()
    assert abs(s.length - 2 * np.pi * 28) < 6 and s.spacing <= 1.2 and abs(s.inset_median - 5) < 0.5
    out = terrain.crest(grid(spark, z[:60, :60]), outline, 1.0, 3.0, 4.0, 15.0, 0.5, 8.0, 21.0, 3.0, 0.3, 3.0)
    assert out["line"].count() == 0 and out["refused"].count() == 1


def test_rays_meet_a_slope(spark):
    z = np.add.outer(np.zeros(40), np.arange(40) * 0.5)
    rays = spark.createDataFrame([(1, 0, 20.0, 0.0, 10.0, 0.0, 1.0, 0.0), (2, 0, 20.0, 39.0, 30.0, 0.0, -1.0, -0.5), (3, 0, 5.0, 5.0, 99.0, 0.1, 0.1, 0.0)], "ray_id long, grid_id long, r double, c double, h double, dr double, dc double, dh double")
    got = {x.ray_id: (x.r, x.c) for x in terrain.picked(rays, grid(spark, z), 1.0, 60, tile=16).collect()}
    assert set(got) == {1} and abs(got[1][1] - 20) < 1e-5


def test_budget_scales_all_classes_alike(spark):
    c, ext = plans._ground(spark, SF)
    args = (c, ext, plans._rows(spark, plans.PLANTS), plans._rows(spark, plans.BAND), [0, 5], 2.0, (8.0, 9.0), 1.0, 1.8)
    free, tight = (vegetation.budgeted(*args, b).collect() for b in (10**9, 300))
    assert {x.scale for x in free} == {1.0} and len(free) == vegetation.sampled(c, ext, plans._rows(spark, plans.PLANTS), 2.0).count()
    per = {}
    for x in tight:
        per.setdefault(x.grid_id, set()).add(x.scale)
    assert all(len(s) == 1 for s in per.values()) and max(sum(x.grid_id == g for x in tight) for g in per) <= 300


def test_decode_reads_all_kinds_and_puts_bad_blobs_aside():
    pt = lambda o, code, *v: (b"\x01" if o == "<" else b"\x00") + struct.pack(o + "I", code) + struct.pack(f"{o}{len(v)}d", *v)
    ring = struct.pack("<I", 4) + struct.pack("<8d", 0, 0, 4, 0, 4, 4, 0, 0)
    poly = b"\x01" + struct.pack("<II", 3, 2) + ring + ring
    assert wkb.decoded(pt("<", 1, 1, 2))[0:2] == ("point", [{"hole": False, "pts": [{"x": 1.0, "y": 2.0}]}])
    for code in (1001, 2001, 0x80000001):
        assert wkb.decoded(pt(">", code, 1, 2, 9))[1][0]["pts"] == [{"x": 1.0, "y": 2.0}]
    assert wkb.decoded(pt("<", 3001, 1, 2, 9, 9))[2] is None
    kind, rings, error = wkb.decoded(b"\x01" + struct.pack("<II", 7, 2) + pt("<", 1, 5, 5) + poly)
    assert (kind, [r["hole"] for r in rings], error) == ("polygon", [False, True], None)
    for flags, size in ((1, 0), (3, 32), (5, 48), (9, 64)):
        assert wkb.decoded(b"GP\x00" + bytes([flags]) + struct.pack("<i", 3006) + b"\x00" * size + poly)[0] == "polygon"
    deep = b"\x01" + struct.pack("<II", 7, 1)
    for bad in (None, b"", b"GP\x00\x11" + bytes(4), b"GP\x00\x0f" + bytes(4) + poly, poly[:-3], pt("<", 99, 1, 2), b"\x01" + struct.pack("<II", 2, 2**31), deep * 30, b"\x01", b"\x02" + pt("<", 1, 1, 2)[1:]):
        assert wkb.decoded(bad)[0] is None and wkb.decoded(bad)[2]


def test_tiles_refuse_an_overflow(spark, tmp_path):
    tiles.write_tiles(grid(spark, surface(20, 30)), str(tmp_path / "a"), 0.1, 8)
    assert tiles.read_tiles(spark, str(tmp_path / "a")).count() == 600
    with pytest.raises(Exception, match="16 bits"):
        tiles.write_tiles(grid(spark, np.full((2, 2), 1e6)), str(tmp_path / "b"), 0.1, 8)


def test_layers_without_an_id_are_left_out(spark):
    a = spark.createDataFrame([(1, "x", "k")], "ID long, Name string, TYPE string")
    b = spark.createDataFrame([("y",)], "name string")
    got = documents.qualified_layers({"some_point": a, "polygons": b}, ("type",), ("id", "uuid")).collect()
    assert [(r.layer, r.layer_rank, r.id, r.type) for r in got] == [("some_point", 3, "1", "k")]
    with pytest.raises(ValueError):
        documents.qualified_layers({"polygons": b}, ("type",), ("id",))


def test_levels_need_two_measured_centuries_for_a_trend(spark):
    samples = spark.createDataFrame([(1, bp, float(bp) / 100) for bp in (900, 1000, 1200) for _ in range(3)] + [(2, 900, 5.0)] * 3, "slug long, bp int, z double")
    present = spark.createDataFrame([(s, bp) for s in (1, 2) for bp in (900, 1000, 1100, 1200)], "slug long, bp int")
    got = {(x.slug, x.bp): (x.level, x.samples) for x in series.century_levels(present, samples, 3).collect()}
    assert got[1, 1100] == (11.0, 0) and got[1, 1200] == (12.0, 3) and got[2, 1000] == (None, 0) and got[2, 900] == (5.0, 3)
    assert {x.bp for x in series.missing_centuries(present, 800, 1000).collect()} == {800}


def test_swedish_order_of_names(spark):
    names = ["Ö", "a", "Å", "Z", "ä", "B", "é"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(F.expr("n COLLATE sv")).collect()]
    assert got == ["a", "B", "é", "Z", "Å", "ä", "Ö"]


def test_policy_of_missing_and_failed_steps(spark):
    s = spark.createDataFrame([(1,), (2,), (3,)], "slug long")
    steps = spark.createDataFrame([("build", None, True), ("water", "shore", False)], "step string, needs string, required boolean")
    log = spark.createDataFrame([(1, "build", True), (2, "build", False), (3, "build", True), (3, "water", False)], "slug long, step string, ok boolean")
    o = documents.step_outcomes(s, steps, spark.createDataFrame([(3, "shore")], "slug long, input string"), log)
    assert {r.slug: (r.verdict, r.off) for r in documents.build_policy(o).collect()} == {1: ("pass", "water"), 2: ("fail", "build,water"), 3: ("warn", "water")}
