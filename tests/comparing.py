"""Comparing a query's rows with those of its SQL, whatever their order."""

import decimal
import math


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())


def rows_of_sql(duck, sql):
    r = duck.execute(sql)
    names = [x[0] for x in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(x[i]) for i in order) for x in r.fetchall())
