"""DuckDB beside Spark on the same tables."""

import os

import duckdb


def values(df):
    def plain(v):
        if hasattr(v, "item"):
            v = v.item()
        return round(v, 6) if isinstance(v, float) else v

    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


def run(sql, folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con.execute(sql).df()


def agree(spark, query, sql, folder):
    ours, theirs = query(spark, folder).toPandas(), run(sql, folder)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert values(ours) == values(theirs)
