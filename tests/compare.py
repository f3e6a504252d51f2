"""Compare a registered query with its SQL check: columns, rows and values."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cinefold.session import use_checkpoint_dir, use_package  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def make_spark() -> SparkSession:
    spark = (
        SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[8]"))
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.sql.debug.maxToStringFields", "1000").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return use_checkpoint_dir(use_package(spark), "/tmp/checkpoints/cinefold-tests")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    """A value with the name of its kind, so that 1, 1.0 and True differ."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return type(value).__name__, value + 0.0 if isinstance(value, float) else value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(frame: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    out = []
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} instead of {sorted(names)}"]
    want, got = _bag(names, expected.fetchall()), _bag(frame.columns, frame.collect())
    if want != got:
        missing, extra = want - got, got - want
        out.append(f"{sum(missing.values())} of {sum(want.values())} rows missing, {sum(extra.values())} extra; "
                   f"columns {sorted(names)}")
        out += [f"  want {r}" for r in sorted(missing, key=str)[:3]] + [f"  got  {r}" for r in sorted(extra, key=str)[:3]]
    return out


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{argv[0]}"
    wanted = argv[1:]
    spark, con, bad = make_spark(), connect(sf_dir), 0
    checks = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            frame = query(spark, sf_dir)
            if name in checks:
                problems = differences(frame, con, checks[name])
                verdict = "ok" if not problems else "DIFFERENT"
            else:
                problems, verdict = [], f"rows {frame.count()}"
        except Exception as problem:  # report and go on with the next query
            problems, verdict = [f"{type(problem).__name__}: {str(problem)[:1500]}"], "FAILED"
        bad += bool(problems)
        print(f"{name:32s} {verdict:10s} {time.time() - started:6.1f}s", flush=True)
        for line in problems:
            print("   ", line[:900])
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
