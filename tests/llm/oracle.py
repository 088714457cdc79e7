"""Runs a registered query and its SQL over a data folder and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql, sf_dir):
    with duckdb.connect() as con:
        for t in TABLES:
            path = f"{sf_dir}/{t}.parquet"
            if os.path.exists(path):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        return names, cur.fetchall()


def canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return [names[i] for i in order], sorted(tuple(fix(r[i]) for i in order) for r in rows)


def same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    mine = canon(df.columns, [tuple(r) for r in df.collect()])
    theirs = canon(*rows_of_sql(sql, sf_dir))
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    different = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    assert not different, different[:3]
    return len(mine[1])
