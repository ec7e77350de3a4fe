"""Loops over append-only logs against brute force, and what they write."""

import random
from itertools import product

import pytest

from taxospark.plans import closure as plans
from taxospark.storage import Log, shared_dir

PAIRS = "trial int, src string, dst string"


def drawn(seed, n=14, m=22, trials=2):
    rng = random.Random(seed)
    return [(t, f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for t in range(trials) for _ in range(m)]


def closed(pairs):
    out = set(pairs)
    while True:
        more = {(t, a, d) for (t, a, b), (u, c, d) in product(out, out) if t == u and b == c} - out
        if not more:
            return out
        out |= more


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_writes_each_pair_once(spark, seed, monkeypatch):
    made = []

    class Seen(Log):
        def __init__(self, first, what="log"):
            super().__init__(first, what)
            made.append(self)

    monkeypatch.setattr(plans, "Log", Seen)
    pairs = drawn(seed)  # repeated pairs, loops and cycles among them
    got = plans.closure(spark.createDataFrame(pairs + pairs[:5], PAIRS), ("trial",)).collect()
    want = closed(pairs)
    assert sorted(tuple(r) for r in got) == sorted(p for p in want if p[1] != p[2])
    assert len(made) == 1 and sorted(tuple(r) for r in made[0].table().collect()) == sorted(want)


@pytest.mark.parametrize("seed", [3, 4])
def test_widest_paths(spark, seed):
    rng = random.Random(seed)
    weighted = [(*p, rng.choice([0.0, 0.3, 0.5, 0.5, 0.9])) for p in drawn(seed)]
    best = {}
    for *p, w in weighted:
        best[tuple(p)] = max(best.get(tuple(p), -1.0), w)
    for _ in range(20):
        for (t, a, b), (u, c, d) in product(list(best), list(best)):
            if t == u and b == c:
                best[t, a, d] = max(best.get((t, a, d), -1.0), min(best[t, a, b], best[u, c, d]))
    got = plans.widest(spark.createDataFrame(weighted, PAIRS + ", weight double"), ("trial",)).collect()
    assert {(r["trial"], r["src"], r["dst"]): r["width"] for r in got} == {k: w for k, w in best.items() if k[1] != k[2]}
    assert len(got) == sum(k[1] != k[2] for k in best)


def test_empty_and_missing(spark):
    none = spark.createDataFrame([], PAIRS)
    assert plans.closure(none, ("trial",)).isEmpty()
    assert plans.widest(spark.createDataFrame([], PAIRS + ", weight double"), ("trial",)).isEmpty()
    assert plans.shortest_paths(none.drop("trial"), none.drop("trial")).isEmpty()
    unweighted = spark.createDataFrame([("a", "b", None), ("b", "c", 0.5)], "src string, dst string, weight double")
    assert {(r["src"], r["dst"]) for r in plans.widest(unweighted).collect()} == {("a", "b"), ("b", "c"), ("a", "c")}


def test_walks_keep_their_first_distance(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert {r["id"]: r["depth"] for r in plans.levels(pairs, "a").collect()} == {"a": 0, "b": 1, "c": 1}
    assert {r["id"] for r in plans.reach(pairs, spark.createDataFrame([("b",)], "id string")).collect()} == {"a", "b", "c"}


def test_parts_take_the_columns_of_the_first(spark):
    log = Log(spark.createDataFrame([(1, "a")], "n int, s string"), "toy")
    part = log.add(spark.createDataFrame([("b", 2)], "s string, n int"))
    assert [tuple(r) for r in part.collect()] == [(2, "b")] and sorted(tuple(r) for r in log.table().collect()) == [(1, "a"), (2, "b")]
    assert log._base.startswith(shared_dir(spark))
