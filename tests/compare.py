"""Run registered queries beside their SQL in DuckDB and compare types and values."""

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "hugeint": "int",
    "float": "double", "double": "double", "string": "string", "varchar": "string", "boolean": "boolean",
    "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark_df, con, sql):
    """Empty text when both sides agree, else the first difference."""
    names, rows = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    found = con.execute(sql)
    sql_names = [d[0] for d in found.description]
    sql_kinds = {d[0]: str(d[1]).lower() for d in found.description}
    other_names, others = table(sql_names, found.fetchall())
    if names != other_names:
        return f"columns {names} != {other_names}"
    kinds = {n: KINDS.get(t, t) for n, t in spark_df.dtypes}
    other_kinds = {n: KINDS.get(t, t) for n, t in sql_kinds.items()}
    if kinds != other_kinds:
        return f"types {[(n, kinds[n], other_kinds[n]) for n in names if kinds[n] != other_kinds[n]]}"
    if len(rows) != len(others):
        return f"{len(rows)} rows != {len(others)}"
    wrong = [(a, b) for a, b in zip(rows, others) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(rows)} rows differ in {names}:\n    {wrong[0][0]}\n    {wrong[0][1]}"
    return ""


def main(sf_dir: str, only: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from floeline.session import local_session

    spark, con = local_session("compare", 8), connect(sf_dir)
    statements, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        started = time.perf_counter()
        try:
            df = query(spark, sf_dir)
            if name in statements:
                result = compare(df, con, statements[name]) or "ok"
            else:
                result = f"rows only: {df.count()}"
        except Exception as error:
            result = f"{type(error).__name__}: {str(error)[:700]}"
        bad += not (result == "ok" or result.startswith("rows only"))
        print(f"{time.perf_counter() - started:6.2f}s {name}: {result}", flush=True)
    print(f"{bad} not in order")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
