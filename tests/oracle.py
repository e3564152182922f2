"""Values of a query and of its SQL in comparable form."""

from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def shown(names, tuples):
    order = sorted(range(len(names)), key=names.__getitem__)
    f = lambda x: "null" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(f(t[i]) for i in order) for t in tuples)


def agree(df, con, sql):
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(names)
    assert shown(df.columns, df.collect()) == shown(names, res.fetchall())
