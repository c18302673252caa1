"""Run registered queries next to their SQL on DuckDB and compare rows and column types.

    python tests/oracle.py /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(table):
    names = sorted(table.column_names)
    columns = [[_plain(v) for v in table.column(n).to_pylist()] for n in names]
    rows = sorted(zip(*columns), key=lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r))
    return names, rows


def compare(spark_table, duck_table):
    """Empty list when equal, else the findings."""
    found = []
    a_names, a = rows_of(spark_table)
    b_names, b = rows_of(duck_table)
    if a_names != b_names:
        return [f"columns {a_names} != {b_names}"]
    for n in a_names:
        ta, tb = str(spark_table.schema.field(n).type), str(duck_table.schema.field(n).type)
        if ta != tb:
            found.append(f"type of {n}: {ta} != {tb}")
    if len(a) != len(b):
        found.append(f"rows {len(a)} != {len(b)}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        found.append(f"{len(bad)} rows differ, first {bad[0]}")
    return found


def main(sf_dir: str, prefixes: list[str]) -> int:
    import __spark_entry__ as entry
    from tidelog.session import get_session

    spark = get_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toArrow()
            took = time.time() - start
            if name in oracles:
                want = con.sql(oracles[name]).to_arrow_table()
                findings = compare(got, want)
            else:
                findings = [] if got.num_rows else ["no rows"]
        except Exception as err:  # noqa: BLE001 - report and go on
            findings, took, got = [f"{type(err).__name__}: {str(err)[:900]}"], time.time() - start, None
        failed += bool(findings)
        kind = "sql " if name in oracles else "rows"
        print(f"{'FAIL' if findings else 'ok  '} {kind} {name:26s} {took:6.2f}s {got.num_rows if got is not None else '-'}", flush=True)
        for f in findings:
            print("      ", f)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
