"""Run a registered query and its SQL counterpart, and compare names, types and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _key(row):
    return tuple("~" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v) for v in row)


def compare(spark, con, fn, sql, sf) -> str:
    """Empty when equal, else what differs."""
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got = sorted((_key(x) for x in df.select(*cols).collect()))
    if sql is None:
        return "" if df.columns else "no columns"
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = dict(zip(names, [str(d[1]) for d in res.description]))
    want_rows = res.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    for c, t in df.dtypes:
        if t in KINDS and KINDS[t] != types[c]:
            return f"type of {c}: {t} vs {types[c]}"
        if t not in KINDS:
            return f"type of {c}: {t} is not a plain scalar"
    order = [names.index(c) for c in cols]
    want = sorted(_key([x[i] for i in order]) for x in want_rows)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; only spark {[x for x in got if x not in want][:2]}; only sql {[x for x in want if x not in got][:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, {cols}: {str(bad[0])[:700]}"
    return "" if got else "no rows on either side"


def main(argv):
    from tests.conftest import make_spark
    from threadgrove.queries import all_queries, all_sql

    sf = f"/root/testdata/sf{argv[0]}"
    picks = argv[1:]
    spark = make_spark()
    con = connect(sf)
    sqls = all_sql()
    bad = 0
    for name, fn in all_queries().items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        t = time.time()
        try:
            why = compare(spark, con, fn, sqls.get(name), sf)
        except Exception as e:  # report and go on with the next query
            why = f"{type(e).__name__}: {str(e)[:900]}"
        bad += bool(why)
        print(f"{'ok ' if not why else 'BAD'} {time.time() - t:6.2f}s {name} {'' if name in sqls else '(rows only) '}{why}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
