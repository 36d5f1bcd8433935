from __future__ import annotations

import duckdb
import pandas as pd
from compare import compare

from casefile.plans.catalog import load


def test_matters_without_exhibits(spark, tmp_path):
    """Matter 5 has no order, 10 one that both builds leave out, 15 one of the current and 20 one of the earlier build only."""
    orders = [(703, 10), (19, 15), (37, 20), (1, 25), (2, 26)]
    frame = pd.DataFrame([(k, c, "F", "1-URGENT") for k, c in orders], columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    frame["o_orderdate"] = pd.Timestamp("1995-01-02").as_unit("us")
    frame.to_parquet(f"{tmp_path}/orders.parquet")
    pd.DataFrame({"c_custkey": [5, 10, 15, 20, 25, 26]}).to_parquet(f"{tmp_path}/customer.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    query = load().queries["compare_builds"]
    found = query.run(spark, str(tmp_path)).toPandas()
    assert sorted(found["matter_id"]) == [15, 20, 25, 26]
    assert compare(found, connection.execute(query.sql).fetchdf()) is None
