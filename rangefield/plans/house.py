"""Relations of the house alone, evaluated once per session and put into queries as literal rows.

A house has some dozens of rooms and nodes, so what follows from it (rooms of
nodes, walls on paths) is a few hundred rows; the chains that compute it have
dozens of small shuffles, which every query over messages would repeat.
"""

from __future__ import annotations

from ..functions.dialect import spark_sql
from .relations import needed, with_

#: Bounded by nodes, rooms and walls, and by pairs of nodes.
SMALL = ("edges", "solid", "doors", "crossed", "counted", "node_rooms", "trust2", "anchors")
#: More rows than this are left to the query.
MOST = 5000
_FOUND: dict[tuple[str, str], str | None] = {}
#: A few hundred rows in dozens of small steps: one partition, nothing compiled.
QUICK = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false"}


def _literal(x, kind: str) -> str:
    return f"CAST({'NULL' if x is None else repr(x)} AS {kind})"


def inlined(spark, sql: str, names: tuple[str, ...] = SMALL) -> dict[str, str]:
    """The relations of SMALL that a query needs, as literals, by name."""
    out = {}
    for name in names:
        if name not in needed(sql):
            continue
        key = spark.sparkContext.applicationId, name
        if key not in _FOUND:
            own = spark.newSession()
            for k, v in QUICK.items():
                own.conf.set(k, v)
            given = inlined(spark, f"SELECT * FROM {name}", SMALL[: SMALL.index(name)])
            frame = spark_sql(with_(f"SELECT * FROM {name}", scene=given))(own, "")
            rows = frame.limit(MOST + 1).collect()
            kinds = [k for _, k in frame.dtypes]
            values = ", ".join("(" + ", ".join(_literal(x, k) for x, k in zip(r, kinds, strict=True)) + ")" for r in rows)
            _FOUND[key] = f"SELECT * FROM (VALUES {values}) AS v({', '.join(frame.columns)})" if 0 < len(rows) <= MOST else None
        if _FOUND[key]:
            out[name] = _FOUND[key]
    return out


def house_sql(sql: str):
    """The query (spark, sf_dir) -> DataFrame of an SQL text, with the house as literals."""
    return lambda spark, sf_dir: spark_sql(with_(sql, scene=inlined(spark, sql)))(spark, sf_dir)
