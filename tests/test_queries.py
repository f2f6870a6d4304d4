"""Every query against its SQL on the smallest tables."""

import random
from datetime import date

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tabaudit.plans import queries as q

from .conftest import DATA


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = q.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    want = sorted(duck.sql(f"select {', '.join(columns)} from ({q.oracle_sql()[name]})").fetchall(), key=key)
    assert got == want


def test_halfway_means_follow_the_order_of_rows(spark, tmp_path):
    """Half of the means lie halfway, and a supplier's rows lie in all splits of two files."""
    rng = random.Random(3)
    rows = [(s, date(1992 + y, 1, 1), rng.randrange(11) / 100) for s in range(60) for y in range(6) for _ in range(20)]
    rng.shuffle(rows)
    (tmp_path / "lineitem.parquet").mkdir()
    for k in range(2):
        suppkey, shipdate, discount = zip(*rows[k::2], strict=True)
        pq.write_table(pa.table({"l_suppkey": suppkey, "l_shipdate": shipdate, "l_discount": discount}), tmp_path / f"lineitem.parquet/{k}.parquet", row_group_size=300)
    settings = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {s: spark.conf.get(s) for s in settings}
    try:
        for s in settings:
            spark.conf.set(s, "4k")
        got = sorted(map(tuple, q.queries()["duplicate_rounded_means"](spark, str(tmp_path)).select("entity", "value", "levels").collect()))
    finally:
        for s, was in before.items():
            spark.conf.set(s, was)
    c = duckdb.connect(config={"threads": 1})
    c.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(c.sql(f"select entity, value, levels from ({q.oracle_sql()['duplicate_rounded_means']})").fetchall())
