"""Run registered queries against DuckDB: ``python tests/check_queries.py <sf dir> [name ...]``.

``--rows-per-chunk=N`` lowers the size limit of ordered groups, so that small tables take the chunked forms.
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        f = float(v)
        return repr(f + 0.0) if f == f else "~"
    return str(v)


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    return sorted(tuple(_cell(v) for v in row) for row in pdf[cols].itertuples(index=False, name=None))


def compare(ours: pd.DataFrame, theirs: pd.DataFrame) -> str:
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} <> {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} <> {len(theirs)}"
    a, b = canonical(ours), canonical(theirs)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {sorted(ours.columns)}: {bad[0]}"
    mixed = []
    for c in ours.columns:
        k = lambda t: "i" if t.kind in "iu" else t.kind
        if k(ours[c].dtype) != k(theirs[c].dtype) or (k(ours[c].dtype) == "i" and ours[c].dtype != theirs[c].dtype):
            mixed.append(f"{c}:{ours[c].dtype}/{theirs[c].dtype}")
    return "" if not mixed else "types " + " ".join(mixed)


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from txnlens import session
    from txnlens.session import build_session

    folder, names = sys.argv[1], [a for a in sys.argv[2:] if not a.startswith("--")]
    for option in sys.argv[2:]:
        if option.startswith("--rows-per-chunk="):
            session.ROWS_PER_CHUNK = int(option.split("=")[1])
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(folder), oracle_sql(), []
    for name, fn in queries().items():
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            ours = fn(spark, folder).toPandas()
            took = time.time() - start
            verdict = compare(ours, con.execute(sql[name]).df()) if name in sql else f"rows-only {len(ours)}"
        except Exception as e:  # report and go on
            took, verdict = time.time() - start, "ERROR " + str(e).split("\n\nJVM")[0][:600]
            if names:
                traceback.print_exc()
        ok = verdict == "" or verdict.startswith("rows-only")
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.2f}s {verdict}", flush=True)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
