"""Outlines of groups of rooms: cells of a raster, grown by a margin, and the border around them walked corner by corner.

A group is a small table of its own (a site's rooms with one tag), so groups
are dealt over tasks and each is handled as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.dialect import spark_sql
from ..plans.relations import with_

#: Size of a cell in metres, and by how many cells the group grows.
CELL, MARGIN = 0.1, 1
OUT = "site long, floor_area string, part int, corner int, x double, y double"


def raster(rooms: list[np.ndarray], cell: float = CELL, margin: int = MARGIN) -> tuple[np.ndarray, float, float]:
    """Cells inside any room or within the margin of one: (row, column), and the place of the first corner."""
    every = np.concatenate(rooms)
    pad = margin + 1
    x0, y0 = every.min(0) - pad * cell
    wide, high = (int(np.ceil((every[:, k].max() + pad * cell - o) / cell)) + 1 for k, o in ((0, x0), (1, y0)))
    x, y = x0 + (np.arange(wide) + 0.5) * cell, (y0 + (np.arange(high) + 0.5) * cell)[:, None]
    full = np.zeros((high, wide), bool)
    for corners in rooms:
        inside = np.zeros_like(full)
        for (ax, ay), (bx, by) in zip(corners, np.roll(corners, -1, 0), strict=True):
            inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay if by != ay else 1.0) + ax)
        full |= inside
    grown = full.copy()
    for dr in range(-margin, margin + 1):
        for dc in range(-margin, margin + 1):
            grown[max(dr, 0) : high + min(dr, 0), max(dc, 0) : wide + min(dc, 0)] |= full[max(-dr, 0) : high + min(-dr, 0), max(-dc, 0) : wide + min(-dc, 0)]
    return grown, float(x0), float(y0)


def borders(grid: np.ndarray) -> list[np.ndarray]:
    """Closed outlines as corners (column, row); straight stretches have no corner between their ends."""
    high, wide = grid.shape
    full = np.zeros((high + 2, wide + 2), bool)
    full[1:-1, 1:-1] = grid
    above, below = full[:-1, 1:-1], full[1:, 1:-1]
    left, right = full[1:-1, :-1], full[1:-1, 1:]
    ways: dict[tuple[int, int], tuple[int, int]] = {}
    for r, c in np.argwhere(above != below).tolist():
        a, b = ((c + 1, r), (c, r)) if above[r, c] else ((c, r), (c + 1, r))
        ways[a] = b
    for r, c in np.argwhere(left != right).tolist():
        a, b = ((c, r), (c, r + 1)) if left[r, c] else ((c, r + 1), (c, r))
        ways[a] = b
    seen: set[tuple[int, int]] = set()
    out = []
    for start in ways:
        line, at = [], start
        while at not in seen and at in ways:
            seen.add(at)
            line.append(at)
            at = ways[at]
        points = np.array(line)
        if len(points) >= 4:
            before, after = points - np.roll(points, 1, 0), np.roll(points, -1, 0) - points
            points = points[before[:, 0] * after[:, 1] != before[:, 1] * after[:, 0]]
            if len(points) >= 4:
                out.append(points)
    return out


def outlined(rooms: DataFrame) -> DataFrame:
    """Corners of the outlines of rooms(site, floor_area, ord, v, x, y), by group and part."""

    def trace(key: tuple, table: pa.Table) -> pa.Table:
        order = table.sort_by([("ord", "ascending"), ("v", "ascending")])
        of = order.column("ord").to_numpy()
        points = np.stack([order.column(c).to_numpy() for c in ("x", "y")], 1)
        grid, x0, y0 = raster(np.split(points, np.flatnonzero(np.diff(of)) + 1))
        found = borders(grid)
        size = [len(p) for p in found]
        whole = np.concatenate(found) if found else np.zeros((0, 2))
        n = len(whole)
        return pa.table(
            {
                "site": pa.array([key[0].as_py()] * n, pa.int64()), "floor_area": pa.array([key[1].as_py()] * n, pa.string()), "part": pa.array(np.repeat(np.arange(len(size)), size), pa.int32()),
                "corner": pa.array(np.concatenate([np.arange(s) for s in size]) if size else [], pa.int32()), "x": pa.array(x0 + whole[:, 0] * CELL), "y": pa.array(y0 + whole[:, 1] * CELL),
            }
        )

    return rooms.groupBy("site", "floor_area").applyInArrow(trace, OUT)


def _groups(spark, sf_dir: str) -> DataFrame:
    sql = "SELECT CAST(v.site AS BIGINT) AS site, r.floor_area, v.ord, v.v, v.x, v.y FROM h_vertices v JOIN h_rooms r ON v.site = r.site AND v.room_id = r.room_id WHERE r.floor_area IS NOT NULL"
    return outlined(spark_sql(with_(sql))(spark, sf_dir)).selectExpr("site", "floor_area", "part", "corner", "round(x, 6) AS x", "round(y, 6) AS y")


QUERIES = {"g13_outlines": _groups}
