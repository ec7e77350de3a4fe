import bisect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxospark.model import Graph
from taxospark.operators import metrics, stats, threads
from taxospark.plans import closure as plans


def test_wilcoxon_vectors():
    for n, p in ((6, 0.02770785), (19, 1.318339e-4), (22, 4.009965e-5)):
        d = [float(i + 1) for i in range(n)] + [0.0] * (24 - n)
        assert math.isclose(stats.wilcoxon(d, [0.0] * 24)[1], p, rel_tol=1e-5)
    assert math.isclose(stats.wilcoxon([float(i + 1) for i in range(24)], [0.0] * 24)[1], 1.192093e-7, rel_tol=1e-5)
    assert stats.wilcoxon([1, 2], [1, 2]) == (0.0, 1.0)
    with pytest.raises(ValueError):
        stats.wilcoxon([1], [1, 2])


def test_holm(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "i int, p double")
    got = {r["i"]: (round(r["holm_p"], 9), r["significant"]) for r in stats.holm(df).collect()}
    assert got == {1: (0.03, True), 2: (0.06, False), 3: (0.06, False)}


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", 0.7), ("b", None), ("c", 1.0), ("c", 2.0), ("c", 4.0)], "g string, v double")
    got = {r["g"]: tuple(r)[1:] for r in stats.bootstrap_ci(df, "v", ("g",), 500).collect()}
    assert got["a"] == (0.7, 0.7, 0.7) and got["b"] == (None, None, None)
    assert got["c"][1] <= got["c"][0] <= got["c"][2]
    assert got == {r["g"]: tuple(r)[1:] for r in stats.bootstrap_ci(df.repartition(3), "v", ("g",), 500).collect()}


def test_toy_sweep(spark):
    def grid(better):
        rows = []
        for seed in range(8):
            for conf in ("prior", "corroboration"):
                rows += [("d", 0.1, 0.2, seed, conf, 0.0, 0.6, 0.3, 2), ("d", 0.1, 0.2, seed, conf, 1.0, 0.0, None, 0)]
                if better and conf == "corroboration":
                    rows.append(("d", 0.1, 0.2, seed, conf, 0.5, 0.2, 0.9, 1))
        return spark.createDataFrame(rows, "dataset string, redundancy double, rewire double, seed int, confidence string, theta double, edge_recall double, edge_precision double, n_added int")

    row = stats.advantage_table(grid(True), "edge_precision").first()
    assert row["ap_adv"] > 0 and row["significant"]
    row = stats.advantage_table(grid(False), "edge_precision").first()
    assert row["ap_adv"] == 0 and row["wilcoxon_p"] == 1.0


def test_rank_sums_over_ranges(spark):
    """Sums from ranges of sizes equal those of whole samples: ties, zeros, undefined sides, several ranges of a group."""
    rng = random.Random(5)
    rows = [(g, None if rng.random() < 0.02 else rng.choice([rng.random(), rng.randrange(4) / 4]), rng.choice([rng.random(), 0.25, float("nan") if rng.random() < 0.05 else 0.5])) for g in ("a", "b", None) for _ in range(200)]
    rows += [("same", 0.5, 0.5)] * 5 + [("few", 0.1 * i, 0.01 * i * i) for i in range(1, 8)] + [("none", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(3)
    for parts in (1, 7):
        sums = {r["g"]: r for r in stats.rank_sums(df, ("g",), "x", "y", parts).collect()}
        assert set(sums) == {"a", "b", None, "same", "few"}
        for g, r in sums.items():
            d = [x - y for h, x, y in rows if h == g and x is not None and y == y]
            sizes = sorted(abs(z) for z in d if z)
            rank = {z: (bisect.bisect_left(sizes, z) + bisect.bisect_right(sizes, z) + 1) / 2 for z in set(sizes)}
            assert (r["n_pairs"], r["n"], r["n_zero"], r["n_sizes"]) == (len(d), len(sizes), len(d) - len(sizes), len(rank))
            assert abs(r["plus"] - sum(rank[z] for z in d if z > 0)) < 1e-6
    got = {r["g"]: (r["n"], r["statistic"], r["p"]) for r in stats.paired_tests(df, ("g",), "x", "y").collect()}
    for g in ("a", "few", "same"):
        own = [(x, y) for h, x, y in rows if h == g and x is not None and y == y]
        low, p = stats.wilcoxon(*zip(*own))
        assert got[g][0] == len(own) and abs(got[g][1] - low) < 1e-6 and abs(got[g][2] - p) < 1e-9


def test_bootstrap_over_tasks(spark):
    """The interval is near the normal one, and the same however rows are dealt."""
    rng = random.Random(6)
    rows = [("a", rng.gauss(3, 1)) for _ in range(300)] + [("b", float(rng.randrange(3))) for _ in range(500)] + [("one", 0.7), ("none", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    got = [{r["g"]: tuple(r)[1:] for r in stats.bootstrap_ci(df.repartition(n), "x", ("g",), 1000).collect()} for n in (1, 5)]
    assert set(got[0]) == {"a", "b", "one", "none"}
    assert all(u == v or abs(u - v) < 1e-9 for g in got[0] for u, v in zip(got[0][g], got[1][g]))
    assert got[0]["one"] == (0.7, 0.7, 0.7) and got[0]["none"] == (None, None, None)
    for g in ("a", "b"):
        x = np.array([v for h, v in rows if h == g and v == v])
        half = 1.96 * x.std(ddof=1) / len(x) ** 0.5
        stat, lo, hi = got[0][g]
        assert abs(stat - x.mean()) < 1e-9 and abs(lo - (x.mean() - half)) < 0.3 * half and abs(hi - (x.mean() + half)) < 0.3 * half
    other = stats.bootstrap_ci(df.where("g = 'a'"), "x", ("g",), 200, statistic=np.median).first()
    assert other["ci_lo"] <= other["stat"] <= other["ci_hi"]


def test_components_of_a_path_and_others(spark):
    n = 1500
    order = list(range(n))
    random.Random(2).shuffle(order)
    path = [(f"p{order[i]:05d}", f"p{order[i + 1]:05d}") for i in range(n - 1)]
    rows = path + [("x", "x"), ("s", "t"), ("t", "s"), ("u", "t"), ("v", None), (None, "w")] + [("hub", f"leaf{i}") for i in range(300)]
    got = {r["id"]: r["component"] for r in plans.components(spark.createDataFrame(rows, "src string, dst string")).collect()}
    assert {got[f"p{i:05d}"] for i in range(n)} == {"p00000"} and {got[c] for c in "stu"} == {"s"}
    assert got["x"] == "x" and got["v"] == "v" and got["w"] == "w" and {got[f"leaf{i}"] for i in range(300)} == {"hub"} == {got["hub"]}
    two = plans.components(spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (2, "a", "d")], "t int, src string, dst string"), ("t",))
    assert {tuple(r) for r in two.collect()} == {(1, "a", "a"), (1, "b", "a"), (2, "b", "b"), (2, "c", "b"), (2, "a", "a"), (2, "d", "a")}
    assert plans.components(two.limit(0).select(F.col("id").alias("src"), F.col("id").alias("dst"))).count() == 0


def test_has_thread_and_recovery(spark):
    edges = [("abstract:a", "extension:a", "hasExtension"), ("extension:a", "extension:b", "supersetOf"), ("extension:b", "i", "hasElement")]
    nodes = [("abstract:a", "abstract"), ("extension:a", "extension"), ("abstract:b", "abstract"), ("extension:b", "extension"), ("i", "instance")]
    g = Graph(spark.createDataFrame(nodes, "id string, kind string"), spark.createDataFrame(edges, "src string, dst string, relation string"))
    asked = spark.createDataFrame([("i", "a"), ("i", "b"), ("j", "a"), (None, "a")], "instance string, concept string")
    assert [tuple(r) for r in threads.has_thread(g, asked).collect()] == [("i", "a")]
    f = spark.createDataFrame([(0.8, 1.0), (1.0, 1.0), (0.5, 0.75)], "b double, a double").select(metrics.recovery_fraction(F.col("b"), F.col("a")).alias("r"))
    assert [None if r["r"] is None else round(r["r"], 9) for r in f.collect()] == [1.0, None, 0.5]
