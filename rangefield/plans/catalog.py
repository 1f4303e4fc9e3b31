"""Registry of the library's own queries and their SQL."""

from __future__ import annotations

import re
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..functions.dialect import duck_sql, render
from ..operators import folds, outlines, solvers, tracking
from . import calibration, geometry, ingest, locate, readmodels, sites, views
from .house import house_sql, inlined
from .relations import RELATIONS, with_

FLAGSHIP = "l09_room_aware"
#: Relations that locators read many times: they are computed once per query and kept on the executors.
SHARED = ("fixes", "trust2", "pair_fits")
#: Queries as SQL; those of a house alone are registered over many houses (`sites`), and stay here for any one house.
SQL: dict[str, str] = {}
for _module in (ingest, geometry, calibration, views, readmodels):
    SQL |= _module.QUERIES


def shared_views(spark, sf_dir: str, names: tuple[str, ...] = SHARED) -> dict[str, str]:
    """Temporary views of relations, each persisted; a lost executor's part is computed again."""
    views = {}
    for name in names:
        frame = house_sql(f"SELECT * FROM {name}")(spark, sf_dir)
        views[name] = f"rangefield_{name}_{uuid.uuid4().hex[:8]}"
        frame.persist(StorageLevel.MEMORY_AND_DISK).createOrReplaceTempView(views[name])
    return views


def _filled(sql: str, idw: str, place) -> str:
    """The SQL of a locator with its places and centroids in the form of one engine."""
    sql = re.sub(r"\{place_(\w+)\}", lambda m: place(m[1]), sql)
    return sql.replace(locate.IDW, idw).replace(locate.IDW_KEPT, locate.kept(idw))


def places(spark, sf_dir: str, sql: str) -> dict[str, DataFrame]:
    """The places that a locator's SQL names, each solved for all problems of its fixes."""
    names = re.findall(r"\{place_(\w+)\}", sql)

    def ask(text: str, frame: bool = False):
        out = house_sql(text)(spark, sf_dir)
        return out if frame else [tuple(r) for r in out.collect()]

    if not names:
        return {}
    rows = ask(f"WITH {locate.LEFT_OUT if locate.LEFT_OUT in sql else locate.FIXES} {solvers.GATHERED}", True)
    rooms = [r for (r,) in ask("SELECT room_id FROM rooms ORDER BY ord")]
    trust, fits = (ask("SELECT a, b FROM trust2"), ask("SELECT listener_id, transmitter_id, r2 FROM pair_fits")) if "room_aware" in names else ([], [])
    return {x: solvers.solved(rows, x, rooms, trust, fits) for x in names}


def locating(sql: str):
    """The query of a locator: its places from the vectorised locators, relations that are read many times as views, centroids over arrays."""
    bare = _filled(sql, locate.idw_arrays(), lambda x: f"{x} AS (SELECT * FROM place_{x})")
    used = tuple(x for x in SHARED if re.search(rf"\b(?:FROM|JOIN)\s+{x}\b", with_(bare, SHARED)))

    def query(spark, sf_dir):
        own = with_(bare, SHARED, scene=inlined(spark, bare))
        for name, frame in places(spark, sf_dir, sql).items():
            view = f"rangefield_{name}_{uuid.uuid4().hex[:8]}"
            frame.createOrReplaceTempView(view)
            own = own.replace(f"place_{name})", f"{view})")
        for name, view in shared_views(spark, sf_dir, used).items():
            own = re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {view}", own)
        return spark.sql(render(own, "spark", lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))

    return query


def queries() -> dict:
    """Every query; each takes (spark, sf_dir)."""
    out = {k: house_sql(v) for k, v in (SQL | sites.QUERIES).items()}
    out |= {k: locating(v) for k, v in locate.QUERIES.items()}
    return out | folds.QUERIES | solvers.QUERIES | tracking.QUERIES | outlines.QUERIES


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query."""
    out = {k: duck_sql(with_(v, engine="duckdb")) for k, v in (SQL | sites.QUERIES).items()}
    out |= {k: duck_sql(with_(_filled(v, locate.idw_relational(), locate.PLACES.get), engine="duckdb")) for k, v in locate.QUERIES.items()}
    return out | {k: duck_sql(v) for k, v in folds.ORACLES.items()}


__all__ = ["FLAGSHIP", "RELATIONS", "SQL", "locating", "oracle_sql", "queries", "shared_views"]
