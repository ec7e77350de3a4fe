"""Line items folded as they are read, against the graph with every line item in it."""

import pytest
from pyspark.sql import functions as F

from taxospark import catalog, queries
from taxospark.model import Graph
from taxospark.operators import damage, expand, threads

LINES = [(1, 1, 10, 7), (1, 2, 10, 8), (2, 1, 11, 7), (2, 1, 12, 8), (3, 1, 99, 7), (4, 1, 99, 99), (5, 1, 10, 7), (5, 1, 10, 7), (None, 1, 11, 8), (None, 2, 10, 8), (6, None, 12, 7), (7, 1, 13, 7), (8, 1, None, None)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Repeated lines, lines of several parts, unknown parts and suppliers, nulls in keys and classes."""
    path = str(tmp_path_factory.mktemp("odd"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    put("lineitem", LINES, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    put("part", [(10, "T1", "B1"), (11, "T1", "B2"), (12, "T2", "B1"), (13, None, "B1")], "p_partkey long, p_type string, p_brand string")
    put("supplier", [(7, 1), (8, 2)], "s_suppkey long, s_nationkey int")
    put("nation", [(1, 1), (2, 1)], "n_nationkey int, n_regionkey int")
    put("region", [(1,)], "r_regionkey int")
    return path


def bag(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_classes_of_lines(spark, odd):
    folded = catalog.folded_lines(spark, odd)
    assert bag(folded.select("instance", F.explode("concepts").alias("concept"))) == bag(catalog.line_items(spark, odd).where("concept is not null"))
    assert folded.count() == folded.select("instance").distinct().count()
    assert folded.select("set_id", "concepts").distinct().count() == folded.select("set_id").distinct().count()


def test_expected_pairs(spark, odd):
    assert bag(queries.expected_pairs(spark, odd)) == bag(threads.expected_pairs(expand.expand(catalog.trade_graph(spark, odd))))


def test_weighted_coverage(spark, odd):
    dual = expand.expand(catalog.trade_graph(spark, odd))
    bad = Graph(dual.nodes, damage.corrupt(dual, "E-SO", 0.05, queries.SEED)[0].edges)
    assert bag(queries.trade_coverage(spark, odd)) == bag(threads.concept_coverage(bad))


def test_no_graph_of_lines(spark, odd, monkeypatch):
    """The graph that is expanded has a stand-in for each set of classes, not a node for each line."""
    seen = []
    whole = expand.expand
    monkeypatch.setattr(expand, "expand", lambda flat, *more: seen.append(flat) or whole(flat, *more))
    sets = catalog.folded_lines(spark, odd).select("set_id").distinct().count()
    for query in (queries.expected_pairs, queries.trade_coverage):
        query(spark, odd)
        assert seen.pop().nodes.where("kind = 'instance'").count() == sets < len({row[:2] for row in LINES})
