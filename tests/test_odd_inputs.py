"""Queries against their SQL on small tables of values that the given ones lack."""

import compare
import duckdb
import pytest

import __spark_entry__ as E


@pytest.fixture
def check(spark, tmp_path):
    """check(query, table=(SQL of its rows)): what differs from the query's SQL."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet')")
        return compare.difference(E.queries()[name](spark, str(tmp_path)), con, E.oracle_sql()[name])

    return run


def test_counts_without_a_known_condition(check):
    """Customer 0 has orders, 1 has none, 2 only unknown ones, 3 none that count."""
    orders = "SELECT * FROM (VALUES (0::BIGINT, 'F', 200000.0::DOUBLE), (0, NULL, 5), (2, NULL, NULL), (3, 'O', 1)) t(o_custkey, o_orderstatus, o_totalprice)"
    assert check("a10_coverage_counts", customer="SELECT range AS c_custkey FROM range(4)", orders=orders) == ""


def test_rendered_cents(check):
    """Every amount from -50.00 to 149.99, and a negative one that rounds to zero."""
    assert check("p11_render", customer="SELECT range AS c_custkey, round((range - 5000) / 100.0::DOUBLE, 2) AS c_acctbal, CAST(range % 25 AS INTEGER) AS c_nationkey FROM range(20000)") == ""


def test_private_ranks_leave_excluded_suppliers_out(check):
    """Every fifth supplier is deep in debt."""
    n = "range AS"
    supplier = f"SELECT {n} s_suppkey, 's' AS s_name, 1 AS s_nationkey, CASE WHEN range % 5 = 0 THEN -950.0 ELSE 100.0 + range END::DOUBLE AS s_acctbal FROM range(20)"
    customer = f"SELECT {n} c_custkey, CASE WHEN range % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS c_mktsegment FROM range(4)"
    orders = f"SELECT {n} o_orderkey, range % 4 AS o_custkey, 90000.0::DOUBLE + 100 * range AS o_totalprice FROM range(40)"
    lineitem = f"SELECT {n} l_orderkey, range % 20 AS l_suppkey, 1000.0::DOUBLE * (range % 37) AS l_extendedprice, (range % 11) / 100.0::DOUBLE AS l_discount, (range % 7)::DOUBLE AS l_quantity, CASE WHEN range % 3 = 0 THEN 'R' ELSE 'N' END AS l_returnflag FROM range(400)"
    assert check("d3_private_ranks", supplier=supplier, customer=customer, orders=orders, lineitem=lineitem) == ""


def test_decoded_targets_of_any_length(check):
    """Urls of 20 to 219 signs; base64 of more than 57 bytes comes in lines."""
    assert check("p23_url_join", pages="SELECT range AS page_id, 'https://example.org/' || repeat('a', range::INTEGER) AS url FROM range(200)") == ""


def test_ranks_of_scores_rounded_at_ties(check):
    """Averages of 2017 / 640 and 1913 / 607: a fifth of each rounds to 0.630313, the first from 0.6303125."""
    n = "CASE s.range WHEN 1 THEN {} ELSE {} END"
    lineitem = f"SELECT s.range AS l_suppkey, CASE WHEN r.range < {n.format(97, 92)} THEN 4.0 ELSE 3.0 END::DOUBLE AS l_quantity, 0.05::DOUBLE AS l_discount, 0.02::DOUBLE AS l_tax FROM range(1, 3) s, range(640) r WHERE r.range < {n.format(640, 607)}"
    assert check("w2_rank_scenarios", lineitem=lineitem) == ""
