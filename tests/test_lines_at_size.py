"""Queries that group all lines: tasks grow with the lines, each line is moved once, odd rows answer as in SQL."""

from __future__ import annotations

import re

import duckdb
import pytest

from tests.oracle import assert_same, connect
from verspan.plans import bindings, graph_queries
from verspan.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Lines without an order, part or supplier, an order without a date."""
    d, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN l_orderkey % 11 = 3 THEN -l_orderkey ELSE l_orderkey END AS l_orderkey, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_partkey END AS l_partkey, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_suppkey END AS l_suppkey) FROM '{SF}/lineitem.parquet') TO '{d}/lineitem.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 13 = 5 THEN NULL ELSE o_orderdate END AS o_orderdate) FROM '{SF}/orders.parquet') TO '{d}/orders.parquet'")
    for t in ("nation", "customer"):
        con.execute(f"COPY (SELECT * FROM '{SF}/{t}.parquet') TO '{d}/{t}.parquet'")
    return str(d)


def test_verdicts_of_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(bindings, "LINES_AT_ONCE", 1000)
    assert assert_same(QUERIES["validate_verdicts"](spark, odd), ORACLES["validate_verdicts"], connect(odd)) > 0


def test_verdicts_move_no_row_of_a_version(spark):
    plan = QUERIES["validate_verdicts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan  # versions are added after the last shuffle or join by a key
    assert not re.search(r"(RepartitionByExpression|Join|Aggregate)", plan.split("Generate explode")[0])
    assert plan.count("Repartition") == 3 and plan.count("lineitem") <= 1  # orders, lines, parts


def test_tasks_grow_with_the_lines(spark, monkeypatch):
    n = bindings.tasks_for(spark, SF)
    monkeypatch.setattr(bindings, "LINES_AT_ONCE", 1000)
    assert n == 1 and bindings.tasks_for(spark, SF) == -(-bindings.table(spark, SF, "lineitem").count() // 1000)


def test_side_index_deals_lines_out_before_they_are_grouped(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(bindings, "LINES_AT_ONCE", 1000)
    monkeypatch.setattr(graph_queries.SideIndex, "build", lambda self, rows, pairs, force=False: seen.append(rows))
    graph_queries._side_refs(spark, SF)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[v#\d+L, part#\d+L, sup#\d+L\][^\n]*\n[^\n]*RepartitionByExpression \[part", plan), plan
