"""Runs a registered query and its SQL over one folder of tables and compares all rows."""

import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return round(float(v), 9) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def differences(spark, query, sql, sf_dir=SF_DIR):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    return [(a, b) for a, b in zip(got, want, strict=False) if a != b][:3] or ([] if len(got) == len(want) else [(len(got), len(want))])
