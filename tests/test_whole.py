"""Queries over whole tables: rows that earlier filters left out are there."""

import duckdb
import pytest

from codeloom.operators import closure
from codeloom.plans import ORACLE_SQL, QUERIES

from .test_queries import TABLES, rows_of


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def same(df, want):
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(want.columns, want.fetchall())
    assert got == want
    return got


def test_callers_closure_follows_every_edge(spark, duck, sf_dir):
    assert any("view" in r for r in same(QUERIES["callers_closure"](spark, sf_dir), duck.sql(ORACLE_SQL["callers_closure"])))


def test_fingerprint_covers_every_order(spark, duck, sf_dir):
    assert same(QUERIES["fingerprint"](spark, sf_dir), duck.sql(ORACLE_SQL["fingerprint"]))


def test_lexical_df_has_rare_tokens(spark, duck, sf_dir):
    assert any(1 in r for r in same(QUERIES["lexical_df"](spark, sf_dir), duck.sql(ORACLE_SQL["lexical_df"])))


def test_symbol_tail_takes_rare_references(spark, duck, sf_dir):
    same(QUERIES["symbol_tail"](spark, sf_dir), duck.sql(ORACLE_SQL["symbol_tail"]))


def test_symbol_tail_of_an_unreferenced_part(spark, duck, sf_dir, tmp_path):
    """A part that nobody bought, beside the others."""
    for t in TABLES:
        part = " union all by name select * replace (-1 as p_partkey, 'lone part' as p_name) from part where p_partkey = (select min(p_partkey) from part)" if t == "part" else ""
        duck.sql(f"copy (select * from {t}{part}) to '{tmp_path}/{t}.parquet' (format parquet)")
    assert {r["name"].split("_")[0] for r in QUERIES["symbol_tail"](spark, str(tmp_path)).collect()} == {"lone part", "lone"}


def test_source_callers_beyond_the_caps(spark, duck, tmp_path):
    """More suppliers call a region's nations than a walk's caps let through; the SQL has none."""
    for t in TABLES:
        rows = "select s.* replace (i as s_suppkey, n_nationkey as s_nationkey) from (from supplier limit 1) s, range(600) g(i), (select min(n_nationkey) as n_nationkey from nation where n_regionkey = 0)" if t == "supplier" else f"select * from {t}"
        duck.sql(f"copy ({rows}) to '{tmp_path}/{t}.parquet' (format parquet)")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet')")
    assert len(same(QUERIES["source_callers"](spark, str(tmp_path)), con.sql(ORACLE_SQL["source_callers"]))) > 600


def test_call_closure_without_caps(spark):
    first = [(f"f{i}", 1, f"c{i}", 1, "core", "x", 1, "F", "call") for i in range(600)]
    second = [(f"g{i}", 2, f"d{i}", 2, f"f{i}", f"c{i}", 1, "F", "call") for i in range(600)]
    calls = spark.createDataFrame(first + second, "caller_file string, caller_line int, caller_name string, caller_decl_line int, callee_file string, callee_name string, callee_line int, callee_kind string, kind string")
    got = {(r["file"], r["depth"], r["via"], r["truncated"]) for r in closure.call_closure(calls, "core", "x", 3, frontier_cap=None, node_cap=None).collect()}
    assert got == {(f"f{i}", 1, None, False) for i in range(600)} | {(f"g{i}", 2, f"f{i}:c{i}:1", False) for i in range(600)}
