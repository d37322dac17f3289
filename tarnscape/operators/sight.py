"""What observers see on grids of any size: a wavefront of tiles, away from each observer in four sweeps."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnscape.operators.raster import EARTH_RADIUS_M, tiles
from tarnscape.session import arrow_rows, cut, large

#: The angle where nothing blocks: finite, so that it interpolates.
NO_BLOCK = -1e30
#: Rows beyond the wedge of a sweep that a column has, so that the next one finds both of its neighbours.
SLACK = 2
#: Rows that a tile takes over from its neighbour towards the observer.
EDGE = 4
SWEEPS = "EWSN"
#: Eyes that look together, about, and the angles of columns, and heights of tiles, that they hold.
EYES, HELD = 1024, 4_000_000
#: Cells that are put together to a batch of results, about.
CELLS = 500_000


class Sweeps:
    """Sweeps of several eyes at (x, y) along x away from them: a column at a time, each from the one before.

    The sight line to a cell crosses the column before at a fraction of a row, between two
    cells whose highest angles so far are interpolated. The wedge has the rows within 45
    degrees, without the diagonals if ``strict``, so four sweeps share out a grid. ``flip``
    has the number of columns where x runs against the grid.

    Tiles come strip by strip, and in a strip from the eyes' rows outwards. Each takes the
    angles of the column before it from the strip before, and those of the rows next to it
    from its neighbour towards the eye, and hands on its own. So what is held is a tile, and
    a column and the edge rows of one tile for each eye."""

    def __init__(self, flip: int, rows: int, strict: bool, res: float, target: float, radius: float, curve: float):
        self.flip, self.rows, self.strict = flip, rows, strict
        self.res, self.target, self.radius, self.curve = res, target, radius, curve
        self.slots: dict[int, int] = {}
        self.strip: int | None = None
        self.column, self.next = self._blank(0), self._blank(0)
        self.edges: dict[int, np.ndarray] = {}

    def _blank(self, n: int) -> np.ndarray:
        return np.full((n, self.rows + 2 * EDGE), NO_BLOCK)

    def _slots_of(self, ids: list[int]) -> np.ndarray:
        slots = np.array([self.slots.setdefault(i, len(self.slots)) for i in ids])
        if len(self.slots) > len(self.next):
            more = max(len(self.slots), 2 * len(self.next)) - len(self.next)
            self.column, self.next = np.concatenate([self.column, self._blank(more)]), np.concatenate([self.next, self._blank(more)])
            self.edges = {k: np.concatenate([e, np.full((more, *e.shape[1:]), NO_BLOCK)]) for k, e in self.edges.items()}
        return slots

    def away(self, eye: np.ndarray, x: int) -> np.ndarray:
        return eye - (self.flip - 1 - x) if self.flip else x - eye

    def window(self, y: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row that is computed in a column."""
        if self.strict:
            lo, hi = np.floor(y - away) + 1, np.ceil(y + away) - 1
        else:
            lo, hi = np.ceil(y - away), np.floor(y + away)
        return np.maximum(lo - SLACK, 0)[:, None], np.minimum(hi + SLACK, self.rows - 1)[:, None]

    def tile(self, ids: list[int], eye: np.ndarray, y: np.ndarray, level: np.ndarray, side: int, x0: int, y0: int, z: np.ndarray, grid: np.ndarray) -> np.ndarray:
        """The cells of a tile that each of the eyes ``ids`` sees. ``side``: 0 for the eyes' rows, 1 before them, 2 after; ``z`` has that tile of several grids, ``grid`` each eye's."""
        h, w = z.shape[1:]
        if x0 != self.strip:
            self.strip, self.column, self.next = x0, self.next, self._blank(len(self.next))
        own = self._slots_of(ids)
        n = len(own)
        first = self.flip - np.ceil(eye) if self.flip else np.floor(eye) + 1
        seen = np.zeros((n, h, w), bool)
        before = self.column[own, y0 : y0 + h + 2 * EDGE]
        near = self.edges[side][own] if side in self.edges else None
        low, high = np.full((n, EDGE, w), NO_BLOCK), np.full((n, EDGE, w), NO_BLOCK)
        e = min(EDGE, h)
        rows = np.arange(y0, y0 + h)
        dy, lift = rows - y[:, None], level[:, None]
        for i in range(w):
            x = x0 + i
            column = np.full((n, h + 2 * EDGE), NO_BLOCK)
            begun = x >= first
            if begun.any():
                away = np.where(begun, self.away(eye, x), 1.0)
                lo, hi = self.window(y, away)
                inside = begun[:, None] & (rows >= lo) & (rows <= hi)
                last = np.where(x > first, self.away(eye, x - 1), 0.0)
                at = y[:, None] + dy * (last / away)[:, None]
                below = np.floor(at)
                least, most = self.window(y, last)
                place = lambda k: np.clip(np.clip(k, least, most).astype(np.int64) - y0 + EDGE, 0, h + 2 * EDGE - 1)  # noqa: B023, E731
                p, q = np.take_along_axis(before, place(below), axis=1), np.take_along_axis(before, place(below + 1), axis=1)
                limit = np.where((x > first)[:, None], p + (q - p) * (at - below), NO_BLOCK)
                d2 = (dy * dy + (away * away)[:, None]) * self.res * self.res
                d = np.sqrt(d2)
                eff = z[grid, :, i] - self.curve * d2 - lift
                block = np.where(np.isnan(eff), NO_BLOCK, eff / d)
                column[:, EDGE : EDGE + h] = np.where(inside, np.maximum(block, limit), NO_BLOCK)
                fits = (np.abs(dy) < away[:, None] if self.strict else np.abs(dy) <= away[:, None]) & ((eff + self.target) / d >= limit)
                if self.radius > 0:
                    fits &= d2 <= self.radius * self.radius
                seen[:, :, i] = fits & inside
            low[:, :e, i], high[:, EDGE - e :, i] = column[:, EDGE : EDGE + e], column[:, EDGE + h - e : EDGE + h]
            if near is not None and side == 1:
                column[:, EDGE + h :] = near[:, :, i]
            elif near is not None and side == 2:
                column[:, :EDGE] = near[:, :, i]
            before = column
        self.next[own, y0 + EDGE : y0 + EDGE + h] = before[:, EDGE : EDGE + h]
        if side == 0:
            self.edges = {k: np.full((len(self.next), EDGE, w), NO_BLOCK) for k in (1, 2)} if self.edges.get(1) is None or self.edges[1].shape[2] != w else self.edges
            self.edges[1][own], self.edges[2][own] = low, high
        else:
            self.edges[side][own] = low if side == 1 else high
        return seen


class Sweep:
    """The sweep of one eye (see Sweeps)."""

    def __init__(self, eye: float, y: float, level: float, sweeps: Sweeps):
        self.eye, self.y, self.level = (np.array([v]) for v in (eye, y, level))
        self.sweeps = sweeps
        sweeps._slots_of([0])

    @property
    def next(self) -> np.ndarray:
        return self.sweeps.next[0]

    def tile(self, side: int, x0: int, y0: int, z: np.ndarray) -> np.ndarray:
        return self.sweeps.tile([0], self.eye, self.y, self.level, side, x0, y0, z[None], np.zeros(1, np.int64))[0]


def _turned(sweep: str, z: np.ndarray) -> np.ndarray:
    """Rows and columns so that the sweep goes along the columns, away from the eye; turned twice, it is what it was."""
    if sweep == "E":
        return z
    if sweep == "W":
        return z[:, ::-1]
    return z.T if sweep == "S" else z[::-1].T


def _back(sweep: str, z: np.ndarray) -> np.ndarray:
    return z.T[::-1] if sweep == "N" else _turned(sweep, z)


def _sweeps(sweep: str, h: int, w: int, **how) -> Sweeps:
    across = sweep in "EW"
    return Sweeps({"W": w, "N": h}.get(sweep, 0), h if across else w, not across, **how)


def _places(sweep: str, row, col) -> tuple:
    return (col, row) if sweep in "EW" else (row, col)


def _sweep(sweep: str, row: float, col: float, level: float, h: int, w: int, **how) -> Sweep:
    return Sweep(*_places(sweep, row, col), level, _sweeps(sweep, h, w, **how))


def _how(res: float, target: float, radius: float, k: float | None) -> dict:
    return {"res": res, "target": target, "radius": radius, "curve": 0.0 if k is None else (1 - k) / (2 * EARTH_RADIUS_M)}


def own_cell(row: float, col: float, h: int, w: int) -> tuple[int, int]:
    return min(int(np.floor(row + 0.5)), h - 1), min(int(np.floor(col + 0.5)), w - 1)


def visible_from(z: np.ndarray, row: float, col: float, height: float, res: float, target: float = 0.0, radius: float = 0.0, k: float | None = 0.13) -> np.ndarray:
    """Cells that an eye ``height`` above (row, col) sees on a grid with cells of ``res`` metres; NaN cells neither block nor are seen.

    With k, the ground sinks by (1 - k) d^2 / 2R. ``radius`` in metres bounds what is seen, if
    above 0. A place outside is moved to the edge; one whose ground has no height sees
    nothing. The observer's own cell is always seen."""
    h, w = z.shape
    row, col = min(max(row, 0.0), h - 1.0), min(max(col, 0.0), w - 1.0)
    r0, c0 = int(row), int(col)
    fr, fc = row - r0, col - c0
    at = lambda r, c, weight: z[min(r, h - 1), min(c, w - 1)] if weight else 0.0
    upper = at(r0, c0, 1) * (1 - fc) + at(r0, c0 + 1, fc) * fc
    lower = at(r0 + 1, c0, fr) * (1 - fc) + at(r0 + 1, c0 + 1, fr * fc) * fc
    level = upper * (1 - fr) + lower * fr + height
    seen = np.zeros(z.shape, bool)
    for s in SWEEPS:
        seen |= _back(s, _sweep(s, row, col, level, h, w, **_how(res, target, radius, k)).tile(0, 0, 0, _turned(s, z)))
    seen[own_cell(row, col, h, w)] = True
    return seen


# ---- over tables -----------------------------------------------------------------------------


def packed(cells: DataFrame, tile: int) -> DataFrame:
    """(grid_id, tr, tc, z): a row for each tile that has a height: doubles row by row, NaN where there is none."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.full((tile, tile), np.nan)
        z[pdf["r"].to_numpy() % tile, pdf["c"].to_numpy() % tile] = pdf["z"]
        return pd.DataFrame({"grid_id": pdf["grid_id"].iloc[:1], "tr": pdf["tr"].iloc[:1], "tc": pdf["tc"].iloc[:1], "z": [z.tobytes()]})

    rows = tiles(cells.where("z IS NOT NULL").select("grid_id", "r", "c", F.col("z").cast("double").alias("z")), tile)
    return rows.groupBy("grid_id", "tr", "tc").applyInPandas(pack, "grid_id long, tr int, tc int, z binary")


def eyes(cells: DataFrame, observers: DataFrame) -> DataFrame:
    """(obs_id, grid_id, row, col, level, h, w): observers moved into their grid, the height of the eye by bilinear interpolation, and the grid's size.

    Observers of grids without cells, or without a place or height, are left out."""
    size = cells.groupBy("grid_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    o = observers.select("obs_id", "grid_id", F.col("row").cast("double").alias("row"), F.col("col").cast("double").alias("col"), F.col("height").cast("double").alias("height")).dropna()
    o = o.join(size, "grid_id")
    inside = lambda x, n: F.greatest(F.lit(0.0), F.least(F.col(x), F.col(n) - 1.0))
    o = o.withColumn("row", inside("row", "h")).withColumn("col", inside("col", "w"))
    o = o.withColumn("fr", F.col("row") - F.floor("row")).withColumn("fc", F.col("col") - F.floor("col"))
    weight = {(0, 0): F.lit(1.0), (0, 1): F.col("fc"), (1, 0): F.col("fr"), (1, 1): F.col("fr") * F.col("fc")}
    corner = F.array(*[F.struct(F.lit(f"z{i}{j}").alias("name"), (F.floor("row") + i).cast("int").alias("r"), (F.floor("col") + j).cast("int").alias("c"), w.alias("weight")) for (i, j), w in weight.items()])
    each = o.select("*", F.explode(F.filter(corner, lambda x: x["weight"] != 0)).alias("x")).select(*o.columns, "x.name", "x.r", "x.c")
    z = cells.select("grid_id", "r", "c", F.nanvl(F.col("z").cast("double"), F.lit(None)).alias("z"))
    found = each.join(large(z), ["grid_id", "r", "c"], "left")
    names = [f"z{i}{j}" for i, j in weight]
    level = found.groupBy(*o.columns).agg(*[F.max(F.when(F.col("name") == n, F.col("z"))).alias(n) for n in names])
    z00, z01, z10, z11 = (F.when(w != 0, F.col(n)).otherwise(F.lit(0.0)) for n, w in zip(names, weight.values(), strict=True))
    fr, fc = F.col("fr"), F.col("fc")
    ground = (z00 * (1 - fc) + z01 * fc) * (1 - fr) + (z10 * (1 - fc) + z11 * fc) * fr
    return level.select("obs_id", "grid_id", "row", "col", (ground + F.col("height")).alias("level"), "h", "w")


def _itinerary(who: DataFrame, tile: int, reach: float) -> DataFrame:
    """For each observer and sweep the tiles that its wedge meets, with their order: strip, side, place.

    ``reach``: cells from the observer, or infinity. The eye's own rows, and the next ones,
    are one side, as they look at each other."""
    span = lambda x, n: F.sequence(F.expr(f"int(int(greatest(0, {x} - {reach} - {EDGE})) div {tile})"), F.expr(f"int(int(least({n} - 1, {x} + {reach} + {EDGE})) div {tile})"))
    if np.isinf(reach):
        span = lambda x, n: F.sequence(F.lit(0), F.expr(f"int(({n} - 1) div {tile})"))
    each = who.select("*", F.explode(span("row", "h")).alias("tr")).select("*", F.explode(span("col", "w")).alias("tc"))
    r0, c0 = f"(tr * {tile})", f"(tc * {tile})"
    r1, c1 = f"least(h - 1, tr * {tile} + {tile - 1})", f"least(w - 1, tc * {tile} + {tile - 1})"
    wedge = {"E": (f"{c1} - col", "row", r0, r1, "tc", "tr", "h"), "W": (f"col - {c0}", "row", r0, r1, "-tc", "tr", "h"), "S": (f"{r1} - row", "col", c0, c1, "tr", "tc", "w"), "N": (f"row - {r0}", "col", c0, c1, "-tr", "tc", "w")}
    steps = []
    for s, (away, y, lo, hi, strip, lateral, n) in wedge.items():
        first, last = f"int(floor({y}) div {tile})", f"int(least(floor({y}) + 1, {n} - 1) div {tile})"
        side = f"CASE WHEN {lateral} < {first} THEN 1 WHEN {lateral} > {last} THEN 2 ELSE 0 END"
        meets = f"{away} > 0 AND greatest(0, {lo} - {y}, {y} - {hi}) <= {away} + {EDGE}"
        steps.append(f"CASE WHEN {meets} THEN struct('{s}' AS sweep, {strip} AS strip, {side} AS side, CASE WHEN {lateral} < {first} THEN -{lateral} ELSE {lateral} END AS place, {last} - {first} + 1 AS middle, {first} AS first) END")
    return each.select("*", F.explode(F.expr(f"filter(array({', '.join(steps)}), x -> x IS NOT NULL)")).alias("s")).select(*each.columns, "s.*")


def viewshed_masks(cells: DataFrame, observers: DataFrame, res: float, radius: float = 0.0, target: float = 0.0, k: float | None = 0.13, tile: int = 256) -> DataFrame:
    """(obs_id, grid_id, r0, c0, h, w, mask): what each observer (obs_id, grid_id, row, col, height) sees of each tile, as packed bits row by row.

    Without a radius (in metres) an observer looks over the whole grid. Each of the four
    sweeps of an observer is a stream of the tiles that its wedge meets, sorted away from the
    observer, in one task (see Sweep); a task holds a tile, and a column and the edge of a tile
    for each observer, whatever the distance. Observers of grids of one size whose tiles come
    in the same order look together, a bounded number of them, and a tile goes to them once a sweep.
    A tile may come once for each sweep, and the masks of an observer don't overlap."""
    how = _how(res, target, radius, k)
    who = cut(eyes(cells, observers), "eyes")
    most = f"least({EYES}, greatest(1, {HELD} div greatest(h, w, {tile * tile})))"
    per = who.groupBy("grid_id", "h", "w").agg(F.count("*").alias("n"))
    total = per.groupBy("h", "w").agg(F.sum("n").alias("total"))
    # grids of one size are dealt out, and a grid with more eyes than look together is parted
    parts = per.join(total, ["h", "w"]).selectExpr("grid_id", f"pmod(xxhash64(grid_id), int(ceil(total / {most}))) AS part", f"int(ceil(n / {most})) AS k")
    apart = who.where("level IS NOT NULL").join(large(parts), "grid_id").withColumn("within", F.expr("int(pmod(xxhash64(obs_id), k))")).drop("k")
    plan = _itinerary(apart, tile, radius / res if radius > 0 else np.inf)
    ground = cut(packed(cells, tile), "tiles")
    same = ["grid_id", "h", "w", "tr", "tc", "sweep", "first", "middle", "part", "within", "strip", "side", "place"]
    eye = F.struct("obs_id", "row", "col", "level")
    met = plan.groupBy(*same).agg(F.collect_list(eye).alias("eyes"))
    group = ["h", "w", "sweep", "first", "middle", "part", "within"]
    stream = met.join(large(ground), ["grid_id", "tr", "tc"], "left").repartition(*group).sortWithinPartitions(*group, "strip", "side", "place", "grid_id")

    def seen_of(sweep: Sweeps, rows: list[dict]) -> Iterator[dict]:
        """What the eyes of several grids see of a tile at one place, or of the middle tiles of a strip side by side."""
        ground, eyes = {}, {}
        for x in rows:
            r0, c0 = x["tr"] * tile, x["tc"] * tile
            z = np.full((tile, tile), np.nan) if x["z"] is None else np.frombuffer(x["z"]).reshape(tile, tile)
            ground.setdefault(x["grid_id"], []).append(z[: min(tile, x["h"] - r0), : min(tile, x["w"] - c0)])
            eyes[x["grid_id"]] = x["eyes"]
        x, across = rows[0], rows[0]["sweep"] in "EW"
        r0, c0 = x["tr"] * tile, x["tc"] * tile
        z = np.stack([_turned(x["sweep"], np.concatenate(g, axis=0 if across else 1)) for g in ground.values()])
        h, w = _back(x["sweep"], z[0]).shape
        x0 = {"E": c0, "W": x["w"] - c0 - w, "S": r0, "N": x["h"] - r0 - h}[x["sweep"]]
        of = np.repeat(np.arange(len(z)), [len(eyes[g]) for g in ground])
        ids, row, col, level = ([e[k] for g in ground for e in eyes[g]] for k in ("obs_id", "row", "col", "level"))
        seen = sweep.tile(ids, *_places(x["sweep"], np.array(row), np.array(col)), np.array(level), x["side"], x0, r0 if across else c0, z, of)
        grids = list(ground)
        for obs, g, at_row, at_col, turned in zip(ids, of, row, col, seen, strict=True):
            mask, own = _back(x["sweep"], turned), own_cell(at_row, at_col, x["h"], x["w"])
            if r0 <= own[0] < r0 + h and c0 <= own[1] < c0 + w:
                mask = mask.copy()
                mask[own[0] - r0, own[1] - c0] = False
            if mask.any():
                yield {"obs_id": obs, "grid_id": grids[g], "r0": r0, "c0": c0, "h": h, "w": w, "mask": np.packbits(mask).tobytes()}

    def look(batches) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("obs_id", pa.int64()), ("grid_id", pa.int64()), *[(n, pa.int32()) for n in ("r0", "c0", "h", "w")], ("mask", pa.binary())])
        now, sweep = None, None
        every = (x for b in batches for x in b.to_pylist())
        for (key, *_), rows in groupby(every, lambda x: (tuple(x[k] for k in group), x["strip"], x["side"], x["side"] and x["place"])):
            rows = list(rows)
            if key != now:
                now, sweep = key, _sweeps(rows[0]["sweep"], rows[0]["h"], rows[0]["w"], **how)
            out = list(seen_of(sweep, rows))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    with arrow_rows(cells.sparkSession, 16):  # rows are tiles
        found = cut(stream.mapInArrow(look, "obs_id long, grid_id long, r0 int, c0 int, h int, w int, mask binary"), "masks")
    one = lambda x, n: F.least(F.floor(F.col(x) + 0.5).cast("int"), F.col(n) - 1)
    own = who.select("obs_id", "grid_id", one("row", "h").alias("r0"), one("col", "w").alias("c0"), F.lit(1).alias("h"), F.lit(1).alias("w"), F.lit(b"\x80").alias("mask"))
    return found.unionByName(own)


def viewshed(cells: DataFrame, observers: DataFrame, res: float, radius: float = 0.0, target: float = 0.0, k: float | None = 0.13, tile: int = 256) -> DataFrame:
    """(obs_id, grid_id, r, c): the cells that each observer sees (see viewshed_masks and visible_from)."""

    def whole(rows: list) -> pd.DataFrame:
        i, g, r, c = zip(*rows, strict=True)
        n = [len(x) for x in r]
        return pd.DataFrame({"obs_id": np.repeat(i, n), "grid_id": np.repeat(g, n), "r": np.concatenate(r), "c": np.concatenate(c)})

    def spread(batches):
        for b in batches:
            rows, n = [], 0
            for i, g, r0, c0, h, w, mask in b.itertuples(index=False):
                r, c = np.divmod(np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=h * w)), w)
                rows.append((i, g, (r + r0).astype(np.int32), (c + c0).astype(np.int32)))
                n += len(r)
                if n >= CELLS:
                    yield whole(rows)
                    rows, n = [], 0
            if rows:
                yield whole(rows)

    return viewshed_masks(cells, observers, res, radius, target, k, tile).mapInPandas(spread, "obs_id long, grid_id long, r int, c int")
