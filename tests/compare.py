"""Compare a Spark result with that of SQL, whatever the order of rows and columns."""

import math


def _value(x):
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        x = float(x)
        return "null" if math.isnan(x) else f"{round(x, 5) + 0.0:.5f}"
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_value(r[k]) for k in order) for r in rows)


def assert_same(df, rel):
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    off = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not off, off[:3]
