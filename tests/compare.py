"""Run a registered query and its SQL and compare the rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, dict):
        return tuple(_plain(x) for x in value.values())
    if isinstance(value, list | tuple):
        return tuple(_plain(x) for x in value)
    return value


def duck_rows(sql, sf_dir=None, tables=None):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")) if sf_dir else ():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name, frame in (tables or {}).items():
        con.register(name, frame)
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(_plain(r[i]) for i in order) for r in out.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(x) for x in r) for r in df.select(*[f"`{n}`" for n in names]).collect())


def same(df, sql, sf_dir=None, tables=None):
    got, want = spark_rows(df), duck_rows(sql, sf_dir, tables)
    assert got[0] == want[0]
    extra, missing = got[1] - want[1], want[1] - got[1]
    assert not extra and not missing, (sum(extra.values()), sum(missing.values()), list(extra)[:3], list(missing)[:3])
    return sum(got[1].values())
