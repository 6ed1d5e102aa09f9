"""Spark results against DuckDB on the same files."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values):
    return sorted(repr(tuple(v)) for v in values)


def compare(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    got = df.select(*cols).collect()
    expected = con.sql("select {} from ({})".format(", ".join(f'"{c}"' for c in cols), sql)).fetchall()
    assert rows(got) == rows(expected)
