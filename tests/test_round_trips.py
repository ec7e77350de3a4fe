"""Files, series over grids, and draws whose size grows with their input."""

import pytest
from pyspark.sql import functions as F

from taxospark.model import Graph
from taxospark.operators import damage, experiment, metrics, stats
from taxospark.sources import files


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([("a", "concept", 'A & "b" <c>', None), ("b", "concept", None, "b"), ("i", "instance", "i", None)], "id string, kind string, label string, concept string")
    edges = spark.createDataFrame([("b", "a", "subClassOf", "abstract", None, None), ("i", "b", "instanceOf", None, True, False)], "src string, dst string, relation string, layer string, repaired boolean, distractor boolean")
    return Graph(nodes, edges)


@pytest.mark.parametrize("fmt", ["node_link", "graphml", "json", "parquet"])
def test_graph_files(spark, graph, tmp_path, monkeypatch, fmt):
    monkeypatch.setattr(files, "DOCUMENT_ROWS", 1)  # several documents
    files.save_graph(graph, str(tmp_path / "g"), fmt)
    back = files.load_graph(spark, str(tmp_path / "g"), fmt)
    order = lambda df, *c: sorted(map(repr, (tuple(r) for r in df.select(*c).collect())))
    for own, read, columns in ((graph.nodes, back.nodes, ("id", "kind", "label", "concept")), (graph.edges, back.edges, ("src", "dst", "relation", "layer"))):
        assert order(own, *columns) == order(read, *columns)
    with pytest.raises(ValueError):
        files.save_graph(graph, str(tmp_path / "g"), "pickle")


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_grid_files(spark, tmp_path, fmt):
    grid = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "dataset string, rho double")
    files.save_grid(grid, str(tmp_path / "grid"), fmt)
    if fmt == "parquet":
        assert {tuple(r) for r in files.load_grid(spark, str(tmp_path / "grid")).select("dataset", "rho").collect()} == {("x", 1.0), ("y", 2.0)}


def test_sample_k_is_the_k_smallest_draws(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("src"), (F.col("id") % 3).alias("g"))
    drawn = sorted((r["d"], r["src"]) for r in rows.select("src", damage.draw("7", F.col("src")).alias("d")).collect())
    got = {r["src"] for r in damage.sample_k(rows, 0.1, "7", ["src"]).collect()}
    assert got == {s for _, s in drawn[:300]}
    by = damage.sample_k(rows, 0.5, "7", ["src"], ("g",)).groupBy("g").count().collect()
    assert {(r["g"], r["count"]) for r in by} == {(0, 500), (1, 500), (2, 500)}
    assert damage.sample_k(rows, 0.0, "7", ["src"]).count() == 0 == damage.sample_k(rows.limit(0), 0.5, "7", ["src"]).count()
    assert damage.sample_k(rows, 1.0, "7", ["src"]).count() == 3000


def test_ranked(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"))
    assert all(r["id"] == r["number"] for r in damage.ranked(rows, "id", per=100).collect())


def test_series(spark):
    grid = spark.createDataFrame([("d", "E-SO", 0.1, s, 0.5 + s / 10, 1.0, 1, 0) for s in range(3)], "dataset string, arm string, rho double, seed int, cov_corrupt double, cov_repair double, single_fn int, single_fp int")
    got = {r["series"]: (r["n"], round(r["mean"], 6), round(r["half"], 6)) for r in experiment.coverage_series(grid).collect()}
    assert got == {"cov_corrupt": (3, 0.6, round(1.96 * 0.1 / 3**0.5, 6)), "cov_repair": (3, 1.0, 0.0)}
    means = experiment.mean_scores(grid).first()
    assert (means["cov_corrupt"], means["single_fn"]) == (0.6, 1.0)
    wrong = experiment.detection_errors(grid, 0.1).first()
    assert (wrong["mean_fn"], wrong["mean_fp"]) == (1.0, 0.0)


def test_fidelity(spark):
    grid = spark.createDataFrame([("d", "prior", 0.1, 0.75, 0.8, 0.2), ("d", "prior", 0.1, 0.75, 0.6, 0.4), ("d", "prior", 0.1, 0.5, 0.5, 0.5)], "dataset string, confidence string, rewire double, theta double, edge_precision double, hallucination double")
    assert [round(r["hallucination"], 9) for r in experiment.fidelity(grid).collect()] == [0.3]
    assert {(r["theta"], round(r["hallucination"], 9)) for r in experiment.fidelity_surface(grid).collect()} == {(0.75, 0.3), (0.5, 0.5)}


def test_merged_tables(spark):
    exact = spark.createDataFrame([("d", 0.1, 3, 0.5)], "dataset string, redundancy double, n_trials int, ap_adv double")
    assert stats.merged_tables(exact, exact.withColumn("ap_adv", F.lit(0.6))).first().asDict() == {"dataset": "d", "redundancy": 0.1, "n_trials": 3, "ap_adv": 0.5, "ap_adv_closure": 0.6}
