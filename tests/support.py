"""Comparison of a query with its SQL."""

DATA = "/root/testdata/sf0.001"


def plain(value):
    if value is None or isinstance(value, str | bool | int):
        return value
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    if hasattr(value, "asDict"):
        value = value.asDict()
    return tuple(sorted((k, plain(v)) for k, v in value.items())) if isinstance(value, dict) else str(value)


def same(spark, duck, run, sql, data=DATA):
    """Whether a query and its SQL give the same columns and the same rows in any order."""
    df = run(spark, data)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.sql(sql)
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)
    assert mine == theirs
