"""The registered queries and their contract."""
import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["set_id", "field", "state"] and df.count() > 0


@pytest.mark.parametrize("name", ["rec_states", "cal_apply", "reg_keys", "abs_diagnose", "lay_split_pairs", "tbl_area_tally", "st_limits", "prof_sheet_anchor"])
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    df = entry.queries()[name](spark, SMALL)
    rel = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    key = lambda rows, names: sorted(tuple(str(r[list(names).index(c)]) for c in cols) for r in rows)
    assert key(df.collect(), df.columns) == key(rel.fetchall(), rel.columns)
