"""Run named queries on Spark and their SQL twins on DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def compare(con, df, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    result = con.execute(sql)
    duck_columns = [d[0] for d in result.description]
    if sorted(duck_columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(duck_columns)}"
    arrow = con.execute(f"DESCRIBE {sql}").fetchall() if not sql.lstrip().startswith("WITH") else con.execute(f"DESCRIBE ({sql})").fetchall()
    kinds = {r[0]: r[1] for r in arrow}
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    for name, kind in df.dtypes:
        if names.get(kind, kind) != kinds[name]:
            return f"type of {name}: {kind} vs {kinds[name]}"
    theirs = canonical(duck_columns, con.execute(sql).fetchall())
    ours = canonical(df.columns, [tuple(r) for r in df.collect()])
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            wrong = sum(x != y for x, y in zip(ours, theirs))
            return f"{wrong} rows differ, first {str(a)[:600]} vs {str(b)[:600]}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from staywise.session import local_session

    sf_dir = sys.argv[1]
    chosen = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sql:
                problem = compare(con, df, sql[name])
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                note = f"rows {len(df.collect())}"
        except Exception as error:
            note = f"ERROR {type(error).__name__}: {str(error)[:1200]}"
        bad += note.startswith(("DIFF", "ERROR"))
        print(f"{name:28s} {time.time() - start:6.1f}s {note}", flush=True)
    print(f"problems: {bad}")


if __name__ == "__main__":
    main()
