"""Run queries and their SQL side by side, as the driver does."""

import math
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(_value(r[k]) for k in order) for r in rows), key=str)


def same(spark, duck, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(sql)
    want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    return got, want
