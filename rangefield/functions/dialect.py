"""Column expressions that differ between Spark SQL and the checking engine.

Queries are written once as SQL with `{...}` places; `render` fills them for
either engine, so both compute from the same relational text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name -> (Spark text, DuckDB text); arguments stand as $1, $2, ...
FORMS: dict[str, tuple[str, str]] = {
    "div": ("(($1) div ($2))", "(($1) // ($2))"),
    "us": ("unix_micros(cast($1 as timestamp))", "epoch_us($1)"),
    "json": ("get_json_object($1, '$.$2')", "json_extract_string(CASE WHEN json_valid($1) THEN $1 END, '$.$2')"),
    "jsonq": ("get_json_object($1, '$[\\'$2\\']')", "json_extract_string(CASE WHEN json_valid($1) THEN $1 END, '$.\"$2\"')"),
    "isjson": ("(get_json_object($1, '$') IS NOT NULL)", "json_valid($1)"),
    "rx": ("regexp_replace($1, $2, $3)", "regexp_replace($1, $2, $3, 'g')"),
    "grab": ("regexp_extract($1, $2, $3)", "regexp_extract($1, $2, $3)"),
    "like": ("($1 RLIKE $2)", "regexp_matches($1, $2)"),
    "part": ("element_at(split($1, '/'), $2)", "split_part($1, '/', $2)"),
    "part_of": ("element_at(split($1, $2), $3)", "split_part($1, $2, $3)"),
    "parts": ("size(split($1, '/'))", "len(string_split($1, '/'))"),
    "num": ("try_cast($1 as double)", "try_cast($1 as double)"),
    "days": ("datediff(cast($1 as date), date '$2')", "date_diff('day', date '$2', cast($1 as date))"),
    "lastn": ("last_value($1, true)", "last_value($1 IGNORE NULLS)"),
    "unnest": ("explode(sequence($1, $2))", "unnest(range($1, ($2) + 1))"),
    "kind": (
        "element_at(map('BIGINT', 'number', 'DECIMAL', 'number', 'DOUBLE', 'number', 'FLOAT', 'number', 'STRING', 'string', 'VOID', 'null', 'ABSENT', 'absent'), coalesce(regexp_extract(schema_of_variant(try_variant_get(try_parse_json($1), '$.$2', 'variant')), '^[A-Z]+', 0), 'ABSENT'))",
        "CASE coalesce(json_type(CASE WHEN json_valid($1) THEN $1 END, '$.$2'), 'ABSENT') WHEN 'BIGINT' THEN 'number' WHEN 'UBIGINT' THEN 'number' WHEN 'HUGEINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'ABSENT' THEN 'absent' END",
    ),
    "last_of": ("max_by($1, struct($2, $3))", "arg_max($1, row($2, $3))"),
    "latest": ("max_by($1, struct($2, $3, $4, $5, $6))", "arg_max($1, row($2, $3, $4, $5, $6))"),
    # to hundredths as the checking engine has them: from the product in doubles, where Spark's two digits go by the decimal text
    "cents": ("(round(($1) * 100.0D) / 100.0D)", "round($1, 2)"),
    "fmt1": ("format_string('%.1f', $1)", "printf('%.1f', $1)"),
}


def _split(args: str) -> list[str]:
    """Arguments of a form: separated by `;`."""
    return [x.strip() for x in args.split(";")]


def render(sql: str, engine: str, table: Callable[[str], str]) -> str:
    """SQL for 'spark' or 'duckdb'; `{t:name}` is a table, `{name: a; b}` a form (innermost first)."""
    at = 0 if engine == "spark" else 1
    sql = re.sub(r"\{t:(\w+)\}", lambda m: table(m[1]), sql)
    while True:
        found = re.search(r"\{(\w+):([^{}]*)\}", sql)
        if not found:
            return sql if at == 0 else re.sub(r"\b(\d+\.\d+)D\b", r"\1::DOUBLE", sql)
        text = FORMS[found[1]][at]
        for i, arg in enumerate(_split(found[2]), 1):
            text = text.replace(f"${i}", arg)
        sql = sql[: found.start()] + text + sql[found.end() :]


def spark_sql(sql: str) -> Callable:
    """The query (spark, sf_dir) -> DataFrame of an SQL text."""

    def query(spark, sf_dir):
        return spark.sql(render(sql, "spark", lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))

    return query


def duck_sql(sql: str) -> str:
    """The same SQL for the checking engine."""
    return render(sql, "duckdb", lambda t: t)
