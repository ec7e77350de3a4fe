import random

import pytest
from pyspark.sql import functions as F

from taxospark import queries
from taxospark.model import Graph
from taxospark.operators import damage, expand, metrics, repair, threads
from taxospark.plans import closure as plans
from taxospark.sources import build, files, slices

TAX = [("mammal", "animal"), ("bird", "animal"), ("dog", "mammal"), ("cat", "mammal"), ("eagle", "bird"), ("car", "vehicle"), ("truck", "vehicle"), ("boat", "vehicle")]
INST = [("rex", "dog"), ("fido", "dog"), ("whiskers", "cat"), ("freckles", "bird"), ("sammy", "eagle"), ("my_tesla", "car"), ("big_rig", "truck"), ("titanic", "boat")]


@pytest.fixture(scope="module")
def flat(spark):
    return build.flat_graph(spark.createDataFrame(TAX, "child string, parent string"), spark.createDataFrame(INST, "instance string, concept string"))


@pytest.fixture(scope="module")
def dual(flat):
    g = expand.expand(flat)
    return Graph(g.nodes.cache(), g.edges.cache())


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def without(g, *gone):
    keep = g.edges
    for s, d in gone:
        keep = keep.where(~((F.col("src") == s) & (F.col("dst") == d)))
    return Graph(g.nodes, keep)


def test_sizes(flat, dual):
    assert flat.nodes.count() == 18 and flat.edges.count() == 16
    assert dual.nodes.count() == 28 and dual.edges.count() == 34
    assert rows(expand.describe(dual), "name", "n") >= {("hasExtension", 10), ("supersetOf", 8), ("subClassOf", 8), ("hasElement", 8)}


def test_expected_and_paths(spark, dual):
    pairs = threads.expected_pairs(dual)
    assert pairs.count() == 20
    assert threads.validate(dual).where("is_valid").count() == 20
    asked = spark.createDataFrame([("rex", "animal"), ("rex", "vehicle"), ("rex", "cat")], "instance string, concept string")
    got = {(r["instance"], r["concept"]): r["path"] for r in threads.thread_paths(dual, asked).collect()}
    assert got[("rex", "animal")] == ["abstract:animal", "extension:animal", "extension:mammal", "extension:dog", "rex"]
    assert got[("rex", "vehicle")] is None and got[("rex", "cat")] is None


def test_queries(flat, dual):
    assert threads.flat_direct(flat, "animal").count() == 0
    five = {("fido",), ("freckles",), ("rex",), ("sammy",), ("whiskers",)}
    assert rows(threads.flat_transitive(flat, "animal"), "instance") == five
    assert rows(threads.threaded_instances(dual, "animal"), "instance") == five


def test_break_and_repair(dual):
    bad = without(dual, ("extension:animal", "extension:mammal"))
    expected = threads.expected_pairs(dual)
    report = threads.validate(bad, expected).cache()
    assert report.where("not is_valid").count() == 3
    assert rows(threads.validate(bad), "instance", "concept", "is_valid") == rows(report, "instance", "concept", "is_valid")
    fixed, gated = repair.repair(bad, report)
    assert rows(gated.where("applied"), "src", "dst") == {("extension:animal", "extension:mammal")}
    assert threads.validate(fixed, expected).where("not is_valid").count() == 0


def test_repair_two_edges_and_gate(dual):
    bad = without(dual, ("extension:animal", "extension:mammal"), ("abstract:car", "extension:car"))
    report = threads.validate(bad, threads.expected_pairs(dual))
    _, gated = repair.repair(bad, report)
    assert rows(gated.where("applied"), "src", "dst") == {("extension:animal", "extension:mammal"), ("abstract:car", "extension:car")}
    lost = without(dual, ("extension:dog", "rex"))
    report = threads.validate(lost, threads.expected_pairs(dual)).cache()
    _, gated = repair.repair(lost, report)
    assert gated.where("applied").count() == 0 and gated.where("relation = 'hasElement'").first()["skip_reason"].startswith("confidence 0.55 <")
    fixed, _ = repair.repair(lost, report, min_confidence=0.5)
    assert threads.validate(fixed, threads.expected_pairs(dual)).where("not is_valid").count() == 0


def test_cap(dual):
    bad = without(dual, ("extension:animal", "extension:mammal"), ("extension:animal", "extension:bird"))
    _, gated = repair.repair(bad, threads.validate(bad, threads.expected_pairs(dual)), max_new_edges=1)
    assert gated.where("applied").count() == 1
    assert "max_new_edges" in gated.where("not applied").first()["skip_reason"]


def test_no_cap(spark, dual, monkeypatch):
    """What the queries measure is not cut: neither by repair's own cap nor by one of a million."""
    bad = without(dual, ("extension:animal", "extension:mammal"), ("extension:vehicle", "extension:car"), ("extension:bird", "sammy"))
    _, gated = repair.repair(bad, threads.validate(bad, threads.expected_pairs(dual)), min_confidence=0.5, max_new_edges=None)
    assert gated.count() == gated.where("applied and skip_reason is null").count() > 1
    low = repair.gate(gated.drop("applied", "skip_reason"), 0.95, None)
    assert rows(low, "applied", "skip_reason") == {(False, "confidence 0.9 < min_confidence 0.95")}
    many = spark.range(1_000_001).select(F.lit("a").alias("src"), F.col("id").cast("string").alias("dst"), F.lit("hasElement").alias("relation"), F.lit(0.55).alias("confidence"))
    assert repair.gate(many, 0.5, None).where("applied").count() == 1_000_001
    asked = []
    one = Graph(spark.createDataFrame([("p", "instance")], "id string, kind string"), dual.edges)
    nothing = spark.createDataFrame([("p", "c", True)], "instance string, concept string, is_valid boolean")
    monkeypatch.setattr(queries, "_damaged", lambda *a: (one, dual, one, dual.edges.limit(0), None))
    monkeypatch.setattr(threads, "validate", lambda *a: nothing)
    monkeypatch.setattr(repair, "repair", lambda *a, max_new_edges=repair.MAX_NEW_EDGES: asked.append(a[4] if len(a) > 4 else max_new_edges) or (one, gated))
    for name in ("edge_quality", "closure_quality", "recall_of_repair", "enforcement_delta", "newly_valid"):
        getattr(queries, name)(spark, "")
    assert asked == [None] * 5


def test_partial_expansion(spark, flat):
    chosen = spark.createDataFrame([("animal",), ("dog",), ("nobody",)], "id string")
    part = expand.expand(flat, chosen)
    report = threads.validate(part)
    assert report.count() and report.where("not is_valid").count() == 0
    assert ("mammal", "extension:dog") in rows(part.edges, "src", "dst")
    assert rows(expand.select_concepts(flat, chosen)[1], "id") == {("nobody",)}


def test_corroboration(spark):
    sub = [("abstract:C", "abstract:M"), ("abstract:M", "abstract:P"), ("abstract:C", "abstract:P")]
    sup = [("extension:P", "extension:M"), ("extension:M", "extension:C")]
    edges = spark.createDataFrame([(*e, "subClassOf") for e in sub] + [(*e, "supersetOf") for e in sup], "src string, dst string, relation string")
    g = Graph(spark.createDataFrame([], "id string, kind string, label string, concept string"), edges)
    p = spark.createDataFrame([("supersetOf", 0.9, "P", "C"), ("supersetOf", 0.9, "W", "C"), ("hasExtension", 1.0, None, None)], "relation string, base_confidence double, parent_concept string, child_concept string")
    score = lambda **k: [round(r["confidence"], 9) for r in repair.corroboration_scorer(**k)(p, g).orderBy(F.desc("relation"), "parent_concept").collect()]
    assert score() == [0.6, 0.0, 1.0]
    assert score(use_superset=False) == [0.45, 0.0, 1.0]
    assert score(floor=1.0) == [0.9, 0.9, 1.0]
    with pytest.raises(ValueError):
        repair.corroboration_scorer(floor=2)


def test_metrics(spark, dual):
    e = lambda rows_: spark.createDataFrame([(*r, "supersetOf") for r in rows_], "src string, dst string, relation string")
    q = metrics.edge_quality(e([("a", "b"), ("x", "y")]), e([("a", "b"), ("c", "d")])).first()
    assert (q["edge_precision"], q["hallucination"]) == (0.5, 0.5)
    assert metrics.edge_quality(e([("a", "b")]).limit(0), e([("a", "b")])).first()["edge_precision"] is None
    with pytest.raises(AssertionError):
        metrics.freeze_oracle(without(dual, ("extension:animal", "extension:mammal")))
    wrong = Graph(dual.nodes, dual.edges.unionByName(e([("extension:vehicle", "extension:dog")]), allowMissingColumns=True))
    assert rows(metrics.false_memberships(wrong, threads.expected_pairs(dual)), "instance", "concept") == {("rex", "vehicle"), ("fido", "vehicle")}


def test_closure_on_random_graphs_with_cycles(spark):
    rng = random.Random(4)
    for _ in range(2):
        pairs = {(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(12)}
        reach = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
        for _ in range(9):
            for a in reach:
                reach[a] |= {c for b in list(reach[a]) for c in reach.get(b, ())}
        want = {(a, b) for a, bs in reach.items() for b in bs if a != b}
        df = spark.createDataFrame(list(pairs), "src string, dst string")
        assert rows(plans.closure(df), "src", "dst") == want
        assert plans.is_acyclic(df) == all(a not in bs for a, bs in reach.items())
        assert plans.is_acyclic(plans.break_cycles(df, "n0"))


def test_generated_dag(spark):
    for rate, extra in ((0.0, 0), (0.5, 1)):
        tax, inst = build.layered_dag(spark, 5, 3, rate, 2, 1)
        pairs = tax.select(F.col("child").alias("src"), F.col("parent").alias("dst"))
        assert inst.count() == 162 and plans.closure(pairs).count() == 426
        assert (metrics.multi_parent(pairs).count() > 0) == bool(extra)
        assert (metrics.redundancy(pairs).first()["redundancy"] > 0) == bool(extra)


def test_damage(dual):
    for arm, k in (("E-SO", 2), ("E-HX", 2), ("E-MIX", 6)):
        bad, removed, injected = damage.corrupt(dual, arm, 0.25, 3)
        assert removed.count() == k and bad.edges.count() == 34 - k and injected.count() == 0
    bad, removed, injected = damage.corrupt(dual, "E-SO", 0.0, 3, rewire=0.5)
    assert injected.count() == 4 and bad.edges.count() == 34
    with pytest.raises(ValueError):
        damage.corrupt(dual, "E-XX", 0.1, 1)
    with pytest.raises(ValueError):
        damage.corrupt(dual, "E-HX", 0.1, 1, policy="TARG")


def test_files(dual, tmp_path, spark):
    files.save_graph(dual, str(tmp_path / "g"))
    assert files.load_graph(spark, str(tmp_path / "g")).edges.count() == 34
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "kind": "concept"}, {"id": "b"}], "links": [{"source": "a", "target": "b", "relation": "subClassOf"}]}')
    g = files.load_graph(spark, str(tmp_path / "g.json"), "node_link")
    assert g.nodes.count() == 2 and rows(g.edges, "src", "dst", "relation") == {("a", "b", "subClassOf")}
    (tmp_path / "g.graphml").write_text('<graphml><key id="d0" for="node" attr.name="kind"/><key id="d1" for="edge" attr.name="relation"/><graph><node id="a"><data key="d0">concept</data></node><node id="b"/><edge source="a" target="b"><data key="d1">subClassOf</data></edge></graph></graphml>')
    g = files.load_graph(spark, str(tmp_path / "g.graphml"), "graphml")
    assert rows(g.nodes, "id", "kind") == {("a", "concept"), ("b", None)} and rows(g.edges, "relation") == {("subClassOf",)}
    with pytest.raises(ValueError):
        files.load_graph(spark, "x", "pickle")


def test_slices(spark):
    hyper = spark.createDataFrame(TAX + [("thing", "boat"), ("vehicle", "thing")], "child string, parent string")
    tax = slices.slice_by_budget(hyper, "animal", 3, 2)
    assert rows(tax, "child", "parent") == {("mammal", "animal"), ("bird", "animal"), ("eagle", "bird")}
    acyclic = plans.break_cycles(hyper.select(F.col("child").alias("src"), F.col("parent").alias("dst")), "vehicle")
    assert plans.is_acyclic(acyclic)
