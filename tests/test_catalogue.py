"""Each registered query against its SQL, on the smallest tables."""

import os

import pytest

from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
# Two of each family; the driver compares all of them.
NAMES = ["q_markout_30", "q_score_keepall", "q_book_state", "q_liq_window", "q_liq_runlen", "q_rolling_vol", "q_flow_features", "q_threshold_cv", "q_conditional_markout", "q_cascades", "q_phase_tags", "q_stream_sessions"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view events as select * from '{SF}/events.parquet'")
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda rows: sorted(rows, key=repr)
    clean = lambda df: key([tuple("~" if v != v or v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False)])
    assert clean(got) == clean(want)
