"""Grid operators over cell tables (grid_id, r, c, z): tiles, neighbours, distance, flood, relief, rays of sight."""

from __future__ import annotations

from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnscape.session import cut, drop, large


def block_mean(cells: DataFrame, factor: int, value: str = "z") -> DataFrame:
    """Mean of factor x factor blocks over the cells that have a value; null where none has."""
    return cells.groupBy("grid_id", F.expr(f"r div {factor}").cast("int").alias("r"), F.expr(f"c div {factor}").cast("int").alias("c")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


# ---- tiles -----------------------------------------------------------------------------------


def tiles(cells: DataFrame, tile: int, halo: int = 0) -> DataFrame:
    """Adds tr, tc: the tile of each cell. With a halo, a cell comes once for each tile that it is within ``halo`` cells of."""
    if not halo:
        return cells.withColumn("tr", F.expr(f"int(r div {tile})")).withColumn("tc", F.expr(f"int(c div {tile})"))
    near = lambda x: F.expr(f"sequence(int(floor(({x} - {halo}) / {tile})), int(floor(({x} + {halo}) / {tile})))")
    return cells.withColumn("tr", F.explode(near("r"))).withColumn("tc", F.explode(near("c")))


def tile_map(cells: DataFrame, kernel: Callable, out: str, tile: int = 512, halo: int = 1, values: tuple[str, ...] = ("z",)) -> DataFrame:
    """(grid_id, r, c, ...): ``kernel`` over square tiles with a halo, one task call each; one shuffle for all neighbours.

    The kernel gets one float array for each of ``values``, null and missing cells as NaN, and
    gives arrays of the same shape, by name and type in ``out``. Rows that aren't cells of the
    input, and the halo, aren't returned."""
    names = [x.split()[0] for x in out.split(", ")]
    side = tile + 2 * halo

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0])
        r, c = pdf["r"].to_numpy(np.int64) - tr * tile + halo, pdf["c"].to_numpy(np.int64) - tc * tile + halo
        made = [np.full((side, side), np.nan) for _ in values]
        for m, v in zip(made, values, strict=True):
            m[r, c] = pdf[v].to_numpy(np.float64, na_value=np.nan)
        mine = (r >= halo) & (r < halo + tile) & (c >= halo) & (c < halo + tile)
        got = kernel(*made)
        base = {"grid_id": pdf["grid_id"].to_numpy()[mine], "r": pdf["r"].to_numpy()[mine], "c": pdf["c"].to_numpy()[mine]}
        return pd.DataFrame(base | {n: g[r[mine], c[mine]] for n, g in zip(names, got, strict=True)})

    rows = tiles(cells.select("grid_id", "r", "c", *values), tile, halo)
    return rows.groupBy("grid_id", "tr", "tc").applyInPandas(run, f"grid_id long, r int, c int, {out}")


def _slopes(z: np.ndarray, res: float) -> list[np.ndarray]:
    """Derivatives down the rows and along the columns: central inside, one-sided where a neighbour is missing."""
    out = []
    for axis in (0, 1):
        pad = np.pad(z, [(1, 1) if k == axis else (0, 0) for k in (0, 1)], constant_values=np.nan)
        before, after = (pad[:-2], pad[2:]) if axis == 0 else (pad[:, :-2], pad[:, 2:])
        one = np.where(np.isnan(before), after - z, z - before) / res
        out.append(np.where(np.isnan(before) | np.isnan(after), one, (after - before) / (2 * res)))
    return out


def gradient(cells: DataFrame, res: float, value: str = "z", tile: int = 512) -> DataFrame:
    """(grid_id, r, c, d_row, d_col): central differences inside, one-sided at the edges; null where a cell has no neighbour or no value."""
    g = tile_map(cells, lambda z: _slopes(z, res), "d_row double, d_col double", tile, 1, (value,))
    return g.withColumn("d_row", F.nanvl("d_row", F.lit(None))).withColumn("d_col", F.nanvl("d_col", F.lit(None)))


def slope_degrees(d_row: Column, d_col: Column) -> Column:
    return F.degrees(F.atan(F.hypot(d_col, d_row)))


#: Azimuth and weight of each sun.
SUNS = ((315.0, 0.45), (45.0, 0.25), (135.0, 0.15), (225.0, 0.15))


def relief(d_row: Column, d_col: Column, altitude: float = 35.0) -> Column:
    """Weighted relief under four suns, 0 to 1. d_row points south."""
    total = F.lit(0.0)
    for azimuth, weight in SUNS:
        az, al = np.radians(azimuth), np.radians(altitude)
        east, north, up = float(np.cos(al) * np.sin(az)), float(np.cos(al) * np.cos(az)), float(np.sin(al))
        shade = (-d_col * east + d_row * north + up) / F.sqrt(d_col * d_col + d_row * d_row + 1.0)
        total = total + weight * F.greatest(F.lit(0.0), F.least(F.lit(1.0), shade))
    return total


# ---- distance --------------------------------------------------------------------------------

_FAR = 1 << 30


def _down_columns(has: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to the nearest evidence of the own column, and its value (ties: the smaller); _FAR and infinity without any."""
    n = len(has)
    row = np.arange(n)[:, None]
    up = np.maximum.accumulate(np.where(has, row, -1), axis=0)
    down = np.minimum.accumulate(np.where(has, row, n)[::-1], axis=0)[::-1]
    col = np.arange(has.shape[1])[None, :]
    d_up, d_down = np.where(up >= 0, row - up, _FAR), np.where(down < n, down - row, _FAR)
    v_up = np.where(up >= 0, v[np.maximum(up, 0), col], np.inf)
    v_down = np.where(down < n, v[np.minimum(down, n - 1), col], np.inf)
    dr = np.minimum(d_up, d_down)
    return dr, np.minimum(np.where(d_up == dr, v_up, np.inf), np.where(d_down == dr, v_down, np.inf))


def _along_rows(dr: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least squared distance over all columns of the row, and its value (ties: the smaller); infinity as value where there is none.

    The squared distance to what column k has is a parabola over the row's cells, and the
    answer their lower envelope. Columns are taken in turn, all rows at once; each parabola
    enters a row's stack once, with the first cell from which on it is the lowest, and leaves
    it at most once. So the time is linear in the width, wherever the evidence lies."""
    rows, width = dr.shape
    f = dr.astype(np.int64) ** 2
    has = dr < _FAR
    stack, start = np.zeros((rows, width + 1), np.int64), np.zeros((rows, width + 1), np.int64)
    top = np.full(rows, -1)
    for k in np.nonzero(has.any(axis=0))[0].tolist():
        r = np.nonzero(has[:, k])[0]
        while len(r):
            t = top[r]
            j = stack[r, np.maximum(t, 0)]
            # parabola k is below that of column j from here on; where they meet in a cell, the smaller value counts
            over, gap = f[r, k] + k * k - f[r, j] - j * j, 2 * np.maximum(k - j, 1)
            at = over // gap
            begins = np.where((over % gap == 0) & (v[r, k] < v[r, j]), at, at + 1)
            none = t < 0
            drops = ~none & (begins <= start[r, np.maximum(t, 0)])
            stays = ~drops
            s = r[stays]
            top[s] += 1
            stack[s, top[s]] = k
            start[s, top[s]] = np.where(none, 0, np.maximum(begins, 0))[stays]
            r = r[drops]
            top[r] -= 1
    order = np.zeros((rows, width + 1), np.int64)
    n = top + 1
    row = np.repeat(np.arange(rows), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    np.maximum.at(order, (row, np.minimum(start[row, place], width)), place)
    order = np.maximum.accumulate(order[:, :width], axis=1)
    j = np.take_along_axis(stack, order, axis=1)
    any_of = (top >= 0)[:, None]
    d2 = np.take_along_axis(f, j, axis=1) + (np.arange(width) - j) ** 2
    return np.where(any_of, d2, np.int64(_FAR) * _FAR), np.where(any_of, np.take_along_axis(v, j, axis=1), np.inf)


def _distances(cells: DataFrame, evidence: DataFrame, kinds: int, strip: int) -> DataFrame:
    """(grid_id, r, c, d2_0, v_0, d2_1, ...): for each cell and kind (0 to kinds - 1) the squared distance to the nearest evidence, and its value; null without any.

    Two passes: strips of columns find the nearest evidence up and down, then strips of rows
    the nearest over all columns. A task holds one strip; between the passes go blocks of
    strip x strip cells with all kinds, packed."""
    e = evidence.select("grid_id", "r", "c", "kind", F.col("v").cast("double").alias("v")).where("v IS NOT NULL").groupBy("grid_id", "r", "c", "kind").agg(F.min("v").alias("v"))
    # evidence outside the cells counts too, as rows that aren't returned
    both = cells.select("grid_id", "r", "c", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("double").alias("v")).unionByName(e)
    block = "grid_id long, rb int, cb int, dr binary, val binary, cell binary"

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        g, cb = pdf["grid_id"].iloc[0], int(pdf["c"].iloc[0]) // strip
        r, c = pdf["r"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64) - cb * strip
        n = -(-(int(r.max()) + 1) // strip) * strip
        kind = pdf["kind"].to_numpy(np.float64, na_value=np.nan)
        is_e = ~np.isnan(kind)
        v = np.full((kinds, n, strip), np.inf)
        v[kind[is_e].astype(int), r[is_e], c[is_e]] = pdf["v"].to_numpy(np.float64)[is_e]
        cell = np.zeros((n, strip), bool)
        cell[r[~is_e], c[~is_e]] = True
        far = [_down_columns(np.isfinite(x), x) for x in v]
        dr, val = np.stack([x[0] for x in far]), np.stack([x[1] for x in far])
        parts = range(n // strip)
        cut_ = lambda a, k, t: np.ascontiguousarray(a[..., k * strip : (k + 1) * strip, :].astype(t)).tobytes()
        return pd.DataFrame({"grid_id": g, "rb": list(parts), "cb": cb, "dr": [cut_(dr, k, np.int32) for k in parts], "val": [cut_(val, k, np.float64) for k in parts], "cell": [cut_(cell, k, bool) for k in parts]})

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        g, rb, first = pdf["grid_id"].iloc[0], int(pdf["rb"].iloc[0]), int(pdf["cb"].min())
        width = (int(pdf["cb"].max()) - first + 1) * strip
        dr, val, cell = np.full((kinds, strip, width), _FAR), np.full((kinds, strip, width), np.inf), np.zeros((strip, width), bool)
        for cb, a, b, x in zip(pdf["cb"], pdf["dr"], pdf["val"], pdf["cell"], strict=True):
            at = np.s_[..., (cb - first) * strip : (cb - first + 1) * strip]
            dr[at], val[at], cell[at] = np.frombuffer(a, np.int32).reshape(kinds, strip, strip), np.frombuffer(b).reshape(kinds, strip, strip), np.frombuffer(x, bool).reshape(strip, strip)
        r, c = np.nonzero(cell)
        out = {"grid_id": g, "r": r + rb * strip, "c": c + first * strip}
        for k in range(kinds):
            d2, v = (x[r, c] for x in _along_rows(dr[k], val[k]))
            out |= {f"d2_{k}": pd.Series(d2, dtype="Int64").where(np.isfinite(v)), f"v_{k}": pd.Series(v).where(np.isfinite(v))}
        return pd.DataFrame(out)

    packed = both.groupBy("grid_id", F.expr(f"int(c div {strip})")).applyInPandas(columns, block)
    named = ", ".join(f"d2_{k} long, v_{k} double" for k in range(kinds))
    return packed.groupBy("grid_id", "rb").applyInPandas(rows, f"grid_id long, r int, c int, {named}")


def nearest_evidence(cells: DataFrame, evidence: DataFrame, radius: int | None = None, strip: int = 64) -> DataFrame:
    """(grid_id, r, c, d2, v): squared distance in cells to the nearest evidence cell; v is its value (ties: the smallest).

    ``evidence`` has grid_id, r, c and a numeric v; a null v is no evidence. Cells with no
    evidence within ``radius`` (anywhere in the grid, without one) are absent. Exact, and in
    linear time (see _distances)."""
    d = _distances(cells, evidence.withColumn("kind", F.lit(0)), 1, strip).where("d2_0 IS NOT NULL")
    d = d if radius is None else d.where(F.col("d2_0") <= radius * radius)
    return d.select("grid_id", "r", "c", F.col("d2_0").alias("d2"), F.col("v_0").alias("v"))


def distance_by_kind(cells: DataFrame, evidence: DataFrame, kinds: list[str], strip: int = 64) -> DataFrame:
    """(grid_id, r, c, one column for each of ``kinds``): squared distance in cells to the nearest evidence (grid_id, r, c, kind) of each, null without any.

    All kinds go through the same two shuffles; evidence of other kinds doesn't count."""
    number = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")).cast("int") - 1
    e = evidence.where(F.col("kind").isin(*kinds)).select("grid_id", "r", "c", number.alias("kind"), F.lit(0.0).alias("v"))
    d = _distances(cells, e, len(kinds), strip)
    return d.select("grid_id", "r", "c", *[F.col(f"d2_{i}").alias(k) for i, k in enumerate(kinds)])


def nearest_fill(cells: DataFrame, value: str = "z", strip: int = 64) -> DataFrame:
    """(grid_id, r, c, value, filled): a cell without a value takes that of the nearest one with a value (ties: the lowest).

    However far that is. A grid that nothing covers keeps its nulls, and ``filled`` is null
    there: a violation for the caller."""
    near = nearest_evidence(cells, cells.where(F.col(value).isNotNull()).withColumn("v", F.col(value)), strip=strip)
    j = cells.select("grid_id", "r", "c", F.col(value).alias("own")).join(large(near), ["grid_id", "r", "c"], "left")
    filled = F.when(F.col("v").isNotNull(), F.col("own").isNull())
    return j.select("grid_id", "r", "c", F.coalesce(F.col("own").cast("double"), "v").alias(value), filled.alias("filled"))


# ---- flood -----------------------------------------------------------------------------------


class _Basins:
    """A tile's cells by the lowest cell that each drains to, and the passes between basins.

    A cell points to its lowest neighbour (ties: the first), so the least highest step from a
    cell to anywhere is the higher of its own height and that from its basin's lowest cell.
    That leaves a small graph: basins, and for each pair the lowest pass."""

    def __init__(self, z: np.ndarray):
        h, w = z.shape
        n = h * w
        flat = z.ravel()
        ident = np.arange(n).reshape(h, w)
        low, at = z.copy(), ident.copy()
        for here, there in ((np.s_[1:], np.s_[:-1]), (np.s_[:, 1:], np.s_[:, :-1]), (np.s_[:-1], np.s_[1:]), (np.s_[:, :-1], np.s_[:, 1:])):
            less = (z[there] < low[here]) | ((z[there] == low[here]) & (ident[there] < at[here]))
            low[here], at[here] = np.where(less, z[there], low[here]), np.where(less, ident[there], at[here])
        p = at.ravel()
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = q
        self.least, self.of = np.unique(p, return_inverse=True)
        self.of, self.z = self.of.reshape(h, w), z
        a = np.concatenate([self.of[:-1].ravel(), self.of[:, :-1].ravel()])
        b = np.concatenate([self.of[1:].ravel(), self.of[:, 1:].ravel()])
        s = np.concatenate([np.maximum(z[:-1], z[1:]).ravel(), np.maximum(z[:, :-1], z[:, 1:]).ravel()])
        ok = (a != b) & np.isfinite(s)
        a, b, s = np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok]), s[ok]
        order = np.lexsort((s, a * np.int64(len(self.least)) + b))
        a, b, s = a[order], b[order], s[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.a, self.b, self.s = a[first], b[first], s[first]


def _reduced(nodes: list[int], height: list[float], a: list[int], b: list[int], s: list[float], keep: set[int]) -> tuple[list[int], list[int], list[float]]:
    """Links among the nodes of ``keep`` with the same least highest steps as the whole graph: one fewer than nodes at most.

    The links go by height; where two groups that both hold a kept node meet, one link stays.
    A node is itself a step of its height."""
    place = {x: i for i, x in enumerate(nodes)}
    root = list(range(len(nodes)))
    rep = [x if x in keep else None for x in nodes]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    oa, ob, os = [], [], []
    cost = [max(x, height[place[p]], height[place[q]]) for p, q, x in zip(a, b, s, strict=True)]
    for k in sorted(range(len(a)), key=cost.__getitem__):
        i, j = find(place[a[k]]), find(place[b[k]])
        if i == j:
            continue
        if rep[i] is not None and rep[j] is not None:
            oa.append(rep[i])
            ob.append(rep[j])
            os.append(cost[k])
        root[j] = i
        rep[i] = rep[j] if rep[i] is None else rep[i]
    return oa, ob, os


def _spread(count: int, a: np.ndarray, b: np.ndarray, s: np.ndarray, seeds: list[tuple[float, int]]) -> np.ndarray:
    """The least highest step from any seed (height, node) to each node; infinity where none leads."""
    level = np.full(count, np.inf)
    order = np.argsort(np.concatenate([a, b]), kind="stable")
    src, dst, cost = np.concatenate([a, b])[order], np.concatenate([b, a])[order].tolist(), np.concatenate([s, s])[order].tolist()
    start = np.searchsorted(src, np.arange(count + 1)).tolist()
    heap: list[tuple[float, int]] = []
    for x, i in seeds:
        heappush(heap, (x, i))
    while heap:
        x, i = heappop(heap)
        if x >= level[i]:
            continue
        level[i] = x
        for k in range(start[i], start[i + 1]):
            y = cost[k] if cost[k] > x else x
            if y < level[dst[k]]:
                heappush(heap, (y, dst[k]))
    return level


def _array(pdf: pd.DataFrame, r0: int, c0: int, side: int) -> np.ndarray:
    z = np.full((side, side), np.inf)
    z[pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0] = pdf["z"]
    return z


def _border(side: int) -> np.ndarray:
    mask = np.ones((side, side), bool)
    mask[1:-1, 1:-1] = False
    return mask


def sea_connectivity(cells: DataFrame, tile: int = 256, blocks: int = 8, value: str = "z") -> DataFrame:
    """(grid_id, r, c, z, connect): least over paths from the grid's edge of the highest cell on the path.

    Cells are read twice. First each tile is reduced to a graph of its border cells, with one
    link fewer than cells, that keeps the least highest step between any two of them. Blocks
    of ``blocks`` x ``blocks`` tiles are reduced in the same way to their own borders, again
    and again until a block is a whole grid; there the edge floods the graph. Then the levels
    go back down, block by block, and each tile floods from its settled border. The number of
    jobs is twice the logarithm of tiles along a side, not the length of a path, and a task
    holds a tile or the borders of one block. A grid that fits a tile is flooded in one call.
    Null heights take no part."""
    src = cells.where(F.col(value).isNotNull()).select("grid_id", "r", "c", F.col(value).cast("double").alias("z"))
    edges = cells.groupBy("grid_id").agg(F.max("r").alias("max_r"), F.max("c").alias("max_c"))
    top = edges.agg(F.max(F.greatest("max_r", "max_c"))).first()[0]
    out = "grid_id long, r int, c int, z double, connect double"
    if top is None:
        return cells.sparkSession.createDataFrame([], out)
    src = src.join(edges, "grid_id")

    def flooded(pdf: pd.DataFrame, r0: int, c0: int, side: int, seeds: dict | None) -> pd.DataFrame:
        z = _array(pdf, r0, c0, side)
        if seeds is None:
            bottom, right = int(pdf["max_r"].iloc[0]) - r0, int(pdf["max_c"].iloc[0]) - c0
            edge = np.zeros_like(z, bool)
            edge[[0, bottom], : right + 1] = True
            edge[: bottom + 1, [0, right]] = True
            r, c = np.nonzero(edge & np.isfinite(z))
            start = z[r, c]
        else:
            r, c, start = seeds
        g = _Basins(z)
        level = _spread(len(g.least), g.a, g.b, g.s, list(zip(start.tolist(), g.of[r, c].tolist(), strict=True)))
        connect = np.maximum(z, level[g.of])
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        return pd.DataFrame({"grid_id": pdf["grid_id"], "r": r, "c": c, "z": pdf["z"], "connect": connect[r - r0, c - c0]})

    if top < tile:
        return src.groupBy("grid_id").applyInPandas(lambda p: flooded(p, 0, 0, int(max(p["max_r"].iloc[0], p["max_c"].iloc[0])) + 1, None), out)

    link = "grid_id long, r int, c int, z double, r2 int, c2 int, s double, max_r int, max_c int"
    stride = 1 << 31

    def border_graph(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of a tile's border cells; a cell without a link comes with itself."""
        r0, c0 = int(pdf["r"].iloc[0]) // tile * tile, int(pdf["c"].iloc[0]) // tile * tile
        z = _array(pdf, r0, c0, tile)
        g = _Basins(z)
        edge = _border(tile)
        for at, most in ((int(pdf["max_r"].iloc[0]) - r0, 0), (int(pdf["max_c"].iloc[0]) - c0, 1)):
            if at < tile:  # the grid ends inside the tile
                edge[(at, slice(None)) if most == 0 else (slice(None), at)] = True
        r, c = np.nonzero(edge & np.isfinite(z))
        n = len(g.least)
        nodes = list(range(n + len(r)))
        height = [-np.inf] * n + z[r, c].tolist()
        a = g.a.tolist() + list(range(n, n + len(r)))
        b = g.b.tolist() + g.of[r, c].tolist()
        s = g.s.tolist() + z[r, c].tolist()
        oa, ob, os = _reduced(nodes, height, a, b, s, set(nodes[n:]))
        oa, ob = [*[x - n for x in oa], *range(len(r))], [*[x - n for x in ob], *range(len(r))]
        oa, ob, s = np.array(oa, int), np.array(ob, int), np.array([*os, *z[r, c]])
        return pd.DataFrame({"grid_id": pdf["grid_id"].iloc[0], "r": r[oa] + r0, "c": c[oa] + c0, "z": z[r[oa], c[oa]], "r2": r[ob] + r0, "c2": c[ob] + c0, "s": s, "max_r": pdf["max_r"].iloc[0], "max_c": pdf["max_c"].iloc[0]})

    def graph_of(pdf: pd.DataFrame, inner: int):
        """Nodes, heights and links of a block, with the steps between neighbours across its inner seams of ``inner`` cells."""
        own = pdf[(pdf["r"] == pdf["r2"]) & (pdf["c"] == pdf["c2"])]
        key = own["r"].to_numpy(np.int64) * stride + own["c"].to_numpy(np.int64)
        height = dict(zip(key.tolist(), own["z"].tolist(), strict=True))
        rest = pdf[(pdf["r"] != pdf["r2"]) | (pdf["c"] != pdf["c2"])]
        a = (rest["r"].to_numpy(np.int64) * stride + rest["c"].to_numpy(np.int64)).tolist()
        b = (rest["r2"].to_numpy(np.int64) * stride + rest["c2"].to_numpy(np.int64)).tolist()
        s = rest["s"].tolist()
        for k in key.tolist():
            for other, at in ((k + stride, k // stride + 1), (k + 1, k % stride + 1)):
                if at % inner == 0 and other in height:
                    a.append(k)
                    b.append(other)
                    s.append(max(height[k], height[other]))
        return list(height), list(height.values()), a, b, s

    def block_graph(inner: int, size: int):
        def go(pdf: pd.DataFrame) -> pd.DataFrame:
            nodes, height, a, b, s = graph_of(pdf, inner)
            mr, mc = int(pdf["max_r"].iloc[0]), int(pdf["max_c"].iloc[0])
            keep = {k for k in nodes if (k // stride) % size in (0, size - 1) or (k % stride) % size in (0, size - 1) or k // stride == mr or k % stride == mc}
            oa, ob, os = _reduced(nodes, height, a, b, s, keep)
            of = dict(zip(nodes, height, strict=True))
            oa, ob, os = [*oa, *keep], [*ob, *keep], [*os, *[of[k] for k in keep]]
            x, y = np.array(oa, np.int64), np.array(ob, np.int64)
            return pd.DataFrame({"grid_id": pdf["grid_id"].iloc[0], "r": x // stride, "c": x % stride, "z": [of[k] for k in oa], "r2": y // stride, "c2": y % stride, "s": os, "max_r": mr, "max_c": mc})

        return go

    def settled(inner: int):
        """Levels of all nodes of a block from those of its border, or from the grid's edge where there is none yet."""

        def go(key, graph: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            shape = {"grid_id": "int64", "r": "int32", "c": "int32", "connect": "float64"}
            if not len(graph):
                return pd.DataFrame({k: [] for k in shape}).astype(shape)
            nodes, height, a, b, s = graph_of(graph, inner)
            place = {k: i for i, k in enumerate(nodes)}
            if len(known):
                at = (known["r"].to_numpy(np.int64) * stride + known["c"].to_numpy(np.int64)).tolist()
                seeds = [(x, place[k]) for k, x in zip(at, known["connect"].tolist(), strict=True) if k in place]
            else:
                mr, mc = int(graph["max_r"].iloc[0]), int(graph["max_c"].iloc[0])
                seeds = [(h, i) for i, (k, h) in enumerate(zip(nodes, height, strict=True)) if k // stride in (0, mr) or k % stride in (0, mc)]
            level = _spread(len(nodes), np.array([place[k] for k in a], np.int64), np.array([place[k] for k in b], np.int64), np.array(s, float), seeds)
            level = np.maximum(level, height)
            k = np.array(nodes, np.int64)
            return pd.DataFrame({"grid_id": graph["grid_id"].iloc[0], "r": k // stride, "c": k % stride, "connect": level}).astype(shape)

        return go

    place = lambda size: [F.expr(f"int(r div {size})"), F.expr(f"int(c div {size})")]
    levels = [(tile, cut(src.groupBy("grid_id", *place(tile)).applyInPandas(border_graph, link), "borders"))]
    size = tile
    while size <= top:
        inner, size = size, size * blocks
        if size <= top:
            levels.append((size, cut(levels[-1][1].groupBy("grid_id", *place(size)).applyInPandas(block_graph(inner, size), link), "borders")))
    known = None
    shape = "grid_id long, r int, c int, connect double"
    for k in range(len(levels) - 1, -1, -1):
        inner, graph = levels[k]
        outer = inner * blocks
        at = [F.expr(f"int(r div {outer})").alias("br"), F.expr(f"int(c div {outer})").alias("bc")]
        g = graph.select("*", *at)
        have = (known if known is not None else cells.sparkSession.createDataFrame([], shape)).select("*", *at)
        fresh = cut(g.groupBy("grid_id", "br", "bc").cogroup(have.groupBy("grid_id", "br", "bc")).applyInPandas(settled(inner), shape), "levels")
        drop(known)
        known = fresh

    def flood_tile(key, pdf: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"grid_id": [], "r": [], "c": [], "z": [], "connect": []}).astype({"grid_id": "int64", "r": "int32", "c": "int32", "z": "float64", "connect": "float64"})
        r0, c0 = int(pdf["r"].iloc[0]) // tile * tile, int(pdf["c"].iloc[0]) // tile * tile
        return flooded(pdf, r0, c0, tile, (seeds["r"].to_numpy() - r0, seeds["c"].to_numpy() - c0, seeds["connect"].to_numpy()))

    at = [F.expr(f"int(r div {tile})").alias("br"), F.expr(f"int(c div {tile})").alias("bc")]
    return src.select("*", *at).groupBy("grid_id", "br", "bc").cogroup(known.select("*", *at).groupBy("grid_id", "br", "bc")).applyInPandas(flood_tile, out)


# ---- components ------------------------------------------------------------------------------


def neighbours(cells: DataFrame) -> DataFrame:
    """Pairs of 4-connected cells (grid_id, r, c, r2, c2), each once."""
    right = cells.select("grid_id", "r", "c", F.col("r").alias("r2"), (F.col("c") + 1).alias("c2"))
    down = cells.select("grid_id", "r", "c", (F.col("r") + 1).alias("r2"), F.col("c").alias("c2"))
    there = cells.select("grid_id", F.col("r").alias("r2"), F.col("c").alias("c2"))
    return right.union(down).join(large(there), ["grid_id", "r2", "c2"]).select("grid_id", "r", "c", "r2", "c2")


def _labels(mask: np.ndarray) -> np.ndarray:
    """For each cell of the mask the first cell (row by row) of its 4-connected part, by hooking and pointer jumping; -1 elsewhere."""
    h, w = mask.shape
    ident = np.arange(h * w).reshape(h, w)
    p = ident.ravel().copy()
    across, down = mask[:, 1:] & mask[:, :-1], mask[1:] & mask[:-1]
    a = np.concatenate([ident[:, :-1][across], ident[:-1][down]])
    b = np.concatenate([ident[:, 1:][across], ident[1:][down]])
    while len(a):
        x, y = p[a], p[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(p, np.maximum(x, y), np.minimum(x, y))
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = q
    return np.where(mask, p.reshape(h, w), -1)


def connected_areas(cells: DataFrame, tile: int = 512) -> DataFrame:
    """(grid_id, r, c, area): the 4-connected area of each cell, named by its first cell: area is a struct (g, r, c).

    Tiles label their own cells; only cells along the seams are linked, and the links between
    tile labels go through components(). So the iterated table has a row for a label at a seam."""
    from tarnscape.operators.graph import components

    def kernel(here: np.ndarray) -> list[np.ndarray]:
        at = _labels(~np.isnan(here))
        return [at // here.shape[1], at % here.shape[1]]

    own = tile_map(cells.select("grid_id", "r", "c", F.lit(1.0).alias("here")), kernel, "lr int, lc int", tile, 0, ("here",))
    base = lambda x: F.expr(f"int({x} div {tile}) * {tile}")
    own = cut(own.select("grid_id", "r", "c", F.struct(F.col("grid_id").alias("g"), (base("r") + F.col("lr")).alias("r"), (base("c") + F.col("lc")).alias("c")).alias("own")), "areas")
    low = lambda x: F.expr(f"{x} % {tile} = 0")
    high = lambda x: F.expr(f"{x} % {tile} = {tile - 1}")
    there = own.select("grid_id", F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("own").alias("b"))
    seams = []
    for x, dr, dc in (("r", 1, 0), ("c", 0, 1)):
        near = own.where(high(x)).select("grid_id", (F.col("r") + dr).alias("r2"), (F.col("c") + dc).alias("c2"), F.col("own").alias("a"))
        seams.append(near.join(large(there.where(low(f"{x}2"))), ["grid_id", "r2", "c2"]).select("a", "b"))
    joined = components(seams[0].union(seams[1]).distinct())
    return own.join(joined.withColumnRenamed("node", "own"), "own", "left").select("grid_id", "r", "c", F.coalesce("component", "own").alias("area"))


# ---- sight -----------------------------------------------------------------------------------

EARTH_RADIUS_M = 6_371_000.0


def sight_lines(cells: DataFrame, observers: DataFrame, directions: int = 16, steps: int = 40, res: float = 2.0, k: float = 0.13) -> DataFrame:
    """(obs_id, ray, step, visible): what observers (obs_id, grid_id, r, c, eye) see along rays.

    Each ray samples the nearest cell at every step; a sample is visible if its angle, with
    the refracted drop of the earth taken off, is no lower than all nearer ones."""
    ray = observers.select("*", F.explode(F.sequence(F.lit(0), F.lit(directions - 1))).alias("ray")).select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    turn = F.col("ray") * (2 * np.pi / directions)
    at = ray.select("obs_id", "grid_id", "ray", "step", "eye", (F.col("r") - F.round(F.col("step") * F.cos(turn) + 1e-9)).cast("int").alias("r"), (F.col("c") + F.round(F.col("step") * F.sin(turn) + 1e-9)).cast("int").alias("c"))
    d = F.col("step") * res
    got = at.join(large(cells.where("z IS NOT NULL").select("grid_id", "r", "c", "z")), ["grid_id", "r", "c"]).withColumn("angle", (F.col("z") - d * d * (1 - k) / (2 * EARTH_RADIUS_M) - F.col("eye")) / d)
    near = Window.partitionBy("obs_id", "ray").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    blocked = F.max("angle").over(near)
    return got.select("obs_id", "ray", "step", (blocked.isNull() | (F.col("angle") >= blocked)).alias("visible"))
