"""Every library query against its SQL on the small tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from ledgerfold.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cursor = db.execute(registry.ORACLE[name])
    columns = sorted(d[0] for d in cursor.description)
    want = [dict(zip([d[0] for d in cursor.description], r, strict=True)) for r in cursor.fetchall()]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    got = [r.asDict() for r in df.collect()]
    key = lambda rows: sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)
    assert key(got) == key(want)
