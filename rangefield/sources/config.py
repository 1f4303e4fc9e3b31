"""The house: floors, rooms, doors and nodes from a configuration file.

The file is JSON, or YAML where a YAML parser is installed.  It is read on the
driver, as a house has some dozens of rooms; `scene` turns it into the same
relations that the queries are written on, so every query runs on it.
"""

from __future__ import annotations

import json
import os
from typing import Any

DEFAULTS: dict[str, Any] = {"floors": [], "nodes": [], "zones": [], "devices": [], "exclude_devices": [], "timeout": 30, "away_timeout": 120}
DOOR_WIDTH = 0.8


def load(path: str | None = None) -> dict[str, Any]:
    """The configuration at `path` (default: $RANGEFIELD_CONFIG) with defaults filled in; an empty file gives the defaults."""
    with open(path or os.environ["RANGEFIELD_CONFIG"], encoding="utf-8") as f:
        text = f.read()
    try:
        found = json.loads(text) if text.strip() else {}
    except json.JSONDecodeError:
        import yaml  # not needed for JSON

        found = yaml.safe_load(text) or {}
    return validate(found)


def validate(found: Any) -> dict[str, Any]:
    """The configuration with defaults; ValueError names what does not fit."""
    if not isinstance(found, dict):
        raise ValueError("a configuration is a mapping")
    out = DEFAULTS | found
    for name, kind in (("floors", list), ("nodes", list), ("zones", list), ("devices", list), ("exclude_devices", list)):
        if not isinstance(out[name], kind):
            raise ValueError(f"{name} is a list")
    for floor in out["floors"]:
        for room in floor.get("rooms", []):
            if any(len(p) != 2 or not all(isinstance(v, (int, float)) for v in p) for p in room.get("points", [])):
                raise ValueError(f"room {room.get('id')}: points are pairs of numbers")
    for node in out["nodes"]:
        if node.get("point") is not None and len(node["point"]) != 3:
            raise ValueError(f"node {node.get('id')}: a point has three numbers")
    return out


def _value(x: Any) -> str:
    if x is None:
        return "CAST(NULL AS STRING)"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        return str(x)
    if isinstance(x, float):
        return f"{x:.10f}D"
    return "'" + str(x).replace("'", "''") + "'"


def _relation(name: str, columns: str, rows: list[tuple]) -> str:
    if not rows:
        raise ValueError(f"the configuration has no {name}")
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) AS t({columns})"


def scene(config: dict[str, Any]) -> dict[str, str]:
    """The relations rooms, vertices, floors, room_floors, open_to and all_nodes of a configuration, as SQL."""
    rooms, corners, doors, nodes, floors, levels = [], [], [], [], [], []
    for floor in config["floors"]:
        low, high = floor.get("bounds") or ((0, 0, None), (0, 0, None))
        level = floor.get("id") or floor.get("name") or f"floor_{len(floors)}"
        floors.append((len(floors), level, floor.get("name", level), *(None if z is None else float(z) for z in (low[2], high[2]))))
        for room in floor.get("rooms", []):
            points = [(float(x), float(y)) for x, y in room.get("points", [])]
            if len(points) < 3:
                continue
            key, xs, ys = room.get("id") or room["name"], [p[0] for p in points], [p[1] for p in points]
            rooms.append((len(rooms), key, room.get("name", key), min(xs), min(ys), max(xs), max(ys), room.get("floor_area")))
            levels.append((rooms[-1][0], key, level))
            corners += [(rooms[-1][0], key, i, x, y) for i, (x, y) in enumerate(points)]
            for target in room.get("open_to", []):
                own = target if isinstance(target, dict) else {"id": target}
                # without a door the connection has no place on a wall
                x, y = own.get("door") or (-1e6, -1e6)
                doors.append((key, own["id"], float(x), float(y), float(own.get("width", DOOR_WIDTH))))
    for node in config["nodes"]:
        if node.get("id") and node.get("point"):
            nodes.append((node["id"], len(nodes), *map(float, node["point"]), node.get("room"), node.get("enabled", True)))
    return {
        "rooms": _relation("rooms", "ord, room_id, room_name, x0, y0, x1, y1, floor_area", rooms),
        "floors": "SELECT ord, floor_id, floor_name, CAST(z0 AS DOUBLE) AS z0, CAST(z1 AS DOUBLE) AS z1 FROM (" + _relation("floors", "ord, floor_id, floor_name, z0, z1", floors) + ")",
        "room_floors": _relation("rooms", "ord, room_id, floor_id", levels),
        "vertices": _relation("rooms", "ord, room_id, v, x, y", corners),
        "open_to": _relation("connections", "room_id, target, door_x, door_y, width", doors),
        "all_nodes": _relation("nodes", "node_id, ord, x, y, z, room_label, enabled", nodes),
    }
