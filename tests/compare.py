"""Rows of a Spark result against those of a DuckDB statement, whatever their order."""

import math
import os

SF = os.environ.get("LARDER_TEST_SF", "/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return x


def same(df, con, sql):
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    assert ours == theirs
    return len(ours)
