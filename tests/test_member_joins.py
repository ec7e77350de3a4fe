"""Tables of members meet by shuffle, so that none is broadcast through the driver."""

import re

import pytest
from pyspark.sql import functions as F

from taxospark.operators import damage, expand, metrics, repair, threads
from taxospark.sources import build
from taxospark.storage import kept

#: Members are joined by their id, or by the ends of a typed edge.
OF_MEMBERS = re.compile(r"BroadcastHashJoin \[[^\]]*(instance#|dst#[^\]]*relation#)")


@pytest.fixture(scope="module")
def graphs(spark):
    tax = spark.createDataFrame([("a", "m"), ("b", "m"), ("m", "top"), ("b", "top")], "child string, parent string")
    inst = spark.createDataFrame([(f"i{k}", "ab"[k % 2]) for k in range(20)] + [("i1", "m")], "instance string, concept string")
    flat = build.flat_graph(tax, inst)
    return flat, expand.expand(flat)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_broadcast_of_members(graphs, monkeypatch):
    flat, dual = graphs
    plans = []
    for module in (repair, metrics, damage):
        monkeypatch.setattr(module, "kept", lambda df, *what: plans.append(plan(df)) or kept(df, *what))
    bad, removed, _ = damage.corrupt(dual, "E-MIX", 0.3, 1)
    plans.append(plan(bad.edges))
    expected = kept(threads.expected_pairs(dual))
    report = kept(threads.validate(bad, expected))
    _, gated = repair.repair(bad, report, min_confidence=0.0, max_new_edges=None)
    oracle = metrics.freeze_oracle(dual)
    added, can = gated.where("applied"), metrics.recoverable(removed, oracle, bad.nodes)
    last = [metrics.edge_recall(added, can), metrics.edge_quality(added, dual.edges), metrics.closure_quality(added, oracle), threads.has_thread(bad, expected), damage.single_node_valid(flat, expected), metrics.newly_valid(report, report), metrics.false_memberships(bad, expected)]
    plans += map(plan, last)
    assert len(plans) > 8
    assert [p for p in plans if OF_MEMBERS.search(p)] == []


def test_paths_of_sets(spark, graphs):
    """A member of several classes, members without a thread, and pairs with nulls or of unknown classes."""
    _, dual = graphs
    more = spark.createDataFrame([("i1", "nowhere"), ("ghost", "a"), ("i2", None), (None, "a"), ("i1", "m"), ("i1", "m")], "instance string, concept string")
    got = {(r[0], r[1]): r[2] for r in threads.thread_paths(dual, threads.expected_pairs(dual).unionByName(more)).collect()}
    assert got[("i1", "m")] == ["abstract:m", "extension:m", "i1"]
    assert got[("i3", "top")] == ["abstract:top", "extension:top", "extension:b", "i3"]
    assert got[("i0", "top")] == ["abstract:top", "extension:top", "extension:m", "extension:a", "i0"]
    assert [got[k] for k in (("i1", "nowhere"), ("ghost", "a"), ("i2", None), (None, "a"))] == [None] * 4
    assert threads.thread_paths(dual, more).where(F.col("instance") == "i1").count() == 2
