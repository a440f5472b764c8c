"""Run queries on Spark and their SQL on DuckDB and compare the rows: ``python -m checks.compare [name ...]``."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks import CHECKS
from checks.base import SOURCES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SOURCES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def differences(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, folder: str) -> list[str]:
    """What differs between both engines; nothing when they agree."""
    df = CHECKS[name].run(spark, folder)
    columns = sorted(df.columns)
    ours = Counter(tuple(r) for r in df.select(*columns).collect())
    if CHECKS[name].oracle is None:
        return [] if ours else ["no rows"]
    rel = con.execute(CHECKS[name].oracle)
    names = [c[0] for c in rel.description]
    if sorted(names) != columns:
        return [f"columns {columns} / {sorted(names)}"]
    place = [names.index(c) for c in columns]
    theirs = Counter(tuple(row[i] for i in place) for row in rel.fetchall())
    problems = [] if ours else ["no rows"]
    for label, extra in (("only spark", ours - theirs), ("only sql", theirs - ours)):
        if extra:
            problems.append(f"{label}: {sum(extra.values())} of {sum(ours.values())}/{sum(theirs.values())}, e.g. {list(extra)[:2]}")
    kinds = {}
    for side, rows in (("spark", ours), ("sql", theirs)):
        for row in rows:
            for column, value in zip(columns, row):
                if value is not None:
                    kinds.setdefault(column, {}).setdefault(type(value).__name__, side)
    problems += [f"types of {c}: {k}" for c, k in kinds.items() if len(k) > 1]
    return problems


def local_session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(), connect(folder)
    for name in sys.argv[1:] or CHECKS:
        start = time.time()
        try:
            found = differences(spark, con, name, folder)
        except Exception as e:  # report and go on with the next query
            found = [f"{type(e).__name__}: {str(e)[:1500]}"]
        print(f"{'ok  ' if not found else 'DIFF'} {name} {time.time() - start:.1f}s", *found, sep="\n     " if found else " ")
