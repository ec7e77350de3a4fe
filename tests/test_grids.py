"""Grids of trials against one trial at a time, and draws in the complement."""

import collections

import pytest
from pyspark.sql import functions as F

from taxospark.model import Graph
from taxospark.operators import damage, experiment, expand, metrics, repair, threads
from taxospark.operators.damage import KEY
from taxospark.sources import build


def stored(g):
    return Graph(experiment.kept(g.nodes, "nodes"), experiment.kept(g.edges, "edges"))


@pytest.fixture(scope="module")
def dag(spark):
    """A layered graph with extra parents, and members of several classes and of an inner one."""
    tax, inst = build.layered_dag(spark, 4, 2, 0.5, 2, 1)
    leaves = [r[0] for r in inst.select("concept").distinct().orderBy("concept").collect()]
    more = [(f"m{i}", leaves[(i * 3 + j) % len(leaves)]) for i in range(5) for j in range(2)] + [("inner", "c1_1"), ("m0", "c1_0")]
    flat = build.flat_graph(tax, inst.select("instance", "concept").unionByName(spark.createDataFrame(more, "instance string, concept string")))
    flat = stored(flat)
    return flat, stored(expand.expand(flat))


def close(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_coverage_grid_by_trial(spark, dag):
    flat, dual = dag
    trials = experiment.factor_table(spark, arm=["E-SO", "E-HE", "E-MIX", "N-REM", "E-HX"], rho=[0.4], seed=[1])
    got = {r["trial"]: r for r in experiment.run_grid(flat, dual, trials).collect()}
    removed, gone = (df.cache() for df in experiment.removed_edges(dual, trials))
    expected = threads.expected_pairs(dual).cache()
    wanted = {tuple(r) for r in expected.select("instance", "concept").collect()}
    truth = {tuple(r) for r in dual.edges.select(*KEY).collect()}
    single_changes = []
    for t in trials.collect():
        cut = removed.where(F.col("trial") == t["trial"]).select(*KEY)
        nodes = dual.nodes.join(gone.where(F.col("trial") == t["trial"]).select("id"), "id", "left_anti")
        bad = stored(Graph(nodes, dual.edges.join(cut, list(KEY), "left_anti")))
        report = experiment.kept(threads.validate(bad, expected), "report")
        fixed, gated = repair.repair(bad, report, repair.prior_scorer, 0.0, None)
        cover = lambda g: threads.validate(g, expected).where("is_valid").count() / len(wanted)
        added = {tuple(r) for r in gated.where("applied").select(*KEY).collect()}
        found = {tuple(r) for r in threads.expected_from_flat(damage.without_edges(flat, damage.flat_preimage(cut))).select("instance", "concept").collect()}
        r = got[t["trial"]]
        assert r["n_expected"] == len(wanted) and r["removed"] == cut.count()
        assert close(r["cov_corrupt"], report.where("is_valid").count() / len(wanted)), t
        assert close(r["cov_repair"], cover(fixed)), t
        assert close(r["edge_precision"], len(added & truth) / len(added) if added else None), t
        assert (r["single_fn"], r["single_fp"]) == (len(wanted - found), len(found - wanted)), t
        assert close(r["cov_single"], len(wanted & found) / len(wanted)), t
        single_changes.append(r["single_fn"])
    assert max(single_changes) > 0 and min(r["cov_corrupt"] for r in got.values()) < 1


def test_threshold_grid_by_theta(spark, dag):
    flat, dual = dag
    trials = experiment.factor_table(spark, rewire=[0.5], seed=[1])
    thetas = (0.0, 0.45, 0.6, 0.75, 0.9, 1.01)
    got = {(r["confidence"], r["theta"]): r for r in experiment.run_threshold_grid(dual, trials, thetas, 0.4).collect()}
    assert len(got) == 12
    removed, cut, put = (experiment.kept(df, "part") for df in experiment.rewired_trials(dual, trials, 0.4))
    oracle = metrics.freeze_oracle(dual)
    edges = dual.edges.select(*KEY).join(removed.unionByName(cut).select(*KEY), list(KEY), "left_anti").unionByName(put.select(*KEY)).distinct()
    bad = stored(Graph(dual.nodes, edges))
    expected = oracle.expected.cache()
    n = expected.count()
    before = experiment.kept(threads.validate(bad, expected), "before")
    report = experiment.kept(threads.validate(bad), "report")
    can = experiment.kept(metrics.recoverable(removed, oracle, bad.nodes), "can")
    seen = collections.Counter()
    for name, scorer in (("prior", repair.prior_scorer), ("corroboration", repair.corroboration_scorer())):
        for theta in (0.0, 0.6, 0.9) if name == "corroboration" else (0.0,):
            fixed, gated = repair.repair(bad, report, scorer, theta, None)
            added = gated.where("applied")
            after = threads.validate(fixed, expected)
            valid, first = after.where("is_valid").count(), before.where("is_valid").count()
            exact, closed = metrics.edge_quality(added, dual.edges).first(), metrics.closure_quality(added, oracle).first()
            r = got[name, theta]
            assert r["n_added"] == exact["n_added"], (name, theta)
            assert close(r["edge_precision"], exact["edge_precision"]) and close(r["hallucination"], exact["hallucination"])
            assert close(r["edge_precision_closure"], closed["closure_precision"]) and close(r["hallucination_closure"], closed["closure_hallucination"])
            assert close(r["edge_recall"], metrics.edge_recall(added, can).first()["edge_recall"])
            assert close(r["cov_after"], valid / n), (name, theta)
            assert close(r["pair_recall"], (valid - first) / (n - first) if n > first else None)
            seen[r["n_added"]] += 1
    assert len(seen) > 1 and got["prior", 0.0]["cov_after"] < 1


def abstract(spark, names, edges):
    nodes = spark.createDataFrame([(f"abstract:{x}", "abstract") for x in names], "id string, kind string")
    return Graph(nodes, spark.createDataFrame([(f"abstract:{a}", f"abstract:{b}", "subClassOf") for a, b in edges], "src string, dst string, relation string"))


def test_rewire_puts_an_edge_for_each_cut(spark):
    """Five parents of one class, and another class: each edge gets a new parent while any is free."""
    names = ["c", "d", *"pqrst", "x", "y"]
    g = abstract(spark, names, [("c", p) for p in "pqrst"] + [("d", p) for p in "pqrst"])
    for seed in range(4):
        cut, put = damage.rewired(g, 1.0, seed)
        new = [(r["src"], r["dst"]) for r in put.collect()]
        assert cut.count() == len(new) == len(set(new)) == 10
        assert all(a != b for a, b in new)
    # Two nodes only: no other parent is free.
    cut, put = damage.rewired(abstract(spark, ["a", "b"], [("a", "b")]), 1.0, 1)
    assert cut.count() == 1 and put.count() == 0
    # Freed targets are free again: with three nodes the two edges can only change places.
    cut, put = damage.rewired(abstract(spark, ["a", "b", "c"], [("a", "b"), ("a", "c")]), 1.0, 1)
    assert cut.count() == 2 and {r["dst"] for r in put.collect()} <= {"abstract:b", "abstract:c"} and put.count() >= 1


def test_distractors_are_as_many_as_wanted(spark):
    names = [f"n{i}" for i in range(6)]
    edges = [(a, b) for a in names for b in names if a < b]
    g = abstract(spark, names, edges)  # 15 of 30 pairs are free
    for rate, n in ((0.2, 3), (0.8, 12), (1.0, 15), (2.0, 15)):
        for seed in (1, 2):
            new = {(r["src"][9:], r["dst"][9:]) for r in damage.distractors(g, rate, seed).collect()}
            assert len(new) == n and not new & set(edges) and all(a != b for a, b in new), rate
    assert damage.distractors(abstract(spark, ["a"], []), 1.0, 1).count() == 0


def test_draws_are_even(spark):
    """Each free parent is drawn about as often."""
    names = [f"n{i}" for i in range(8)]
    g = abstract(spark, names, [("n0", "n1"), ("n0", "n2")])
    cut = spark.range(4000).select(F.col("id").alias("trial"), F.lit("abstract:n0").alias("src"), F.lit("abstract:n1").alias("dst"))
    put = damage.wrong_parents(g.nodes, g.edges, cut, F.col("trial").cast("string"), ("trial",))
    times = {r["dst"]: r["count"] for r in put.groupBy("dst").count().collect()}
    assert set(times) == {f"abstract:n{i}" for i in range(3, 8)} and sum(times.values()) == 4000
    assert all(650 < n < 950 for n in times.values())


def test_folded_validity(spark, dag):
    """Counts over sets of members equal those over pairs, for derived and for given pairs; a hub, a lost member, repeats."""
    _, dual = dag
    lost = dual.edges.where(~((F.col("relation") == "hasElement") & F.col("dst").startswith("c3_1")) & ~((F.col("relation") == "supersetOf") & (F.col("dst") == "extension:c2_4")))
    bad = stored(Graph(dual.nodes, lost.unionByName(lost.where("relation = 'hasElement'"))))
    given = threads.expected_pairs(dual)
    given = experiment.kept(given.unionByName(given).unionByName(spark.createDataFrame([("nobody", "c0_0"), ("m1", "unknown")], "instance string, concept string")), "given")
    reach = {(r["instance"], r["concept"]) for r in threads.thread_pairs(bad).collect()}
    for expected in (None, given):
        rows = {tuple(r) for r in threads.validate(bad, expected).select("instance", "concept", "is_valid").collect()}
        assert rows and all(ok == ((i, c) in reach) for i, c, ok in rows)
        assert expected is None or {r[:2] for r in rows} == {tuple(r) for r in given.select("instance", "concept").collect()}
        want = collections.Counter(c for _, c, _ in rows), collections.Counter(c for _, c, ok in rows if ok)
        got = {r["concept"]: (r["n_expected"], r["n_valid"]) for r in threads.concept_coverage(bad, expected).collect()}
        assert got == {c: (n, want[1][c]) for c, n in want[0].items()}
        assert len(rows) == threads.validate(bad, expected).count()
