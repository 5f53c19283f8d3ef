"""The driver contract: registered queries, their SQL, and a sample of both."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "agg1_rtp_streams", "win2_ssrc_changes", "join3_bind_labels", "join9_ssrc_collisions", "agg5_rtcp_stats", "win5_hold_windows",
    "win7_burst_members", "fn18_parse_sdp", "fn19_parse_rs_metadata", "src5_frame_decode", "set1_all_findings", "agg15_overall_health",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql_that_parses(con):
    queries, oracle = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 150
    for name, text in oracle.items():
        con.execute("explain " + text)


@pytest.mark.parametrize("name", SAMPLE)
def test_rows_equal_the_sql(spark, con, name):
    df = entry_module.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry_module.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_entry_smoke(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "packet_count" in df.columns
