"""Strong components and shortest-path shares against brute force."""

import random
from collections import deque

from pyspark.sql import functions as F

from taxospark.plans import closure as plans

SCHEMA = "src string, dst string"


def reached(pairs):
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
        ahead.setdefault(b, set())
    out = {}
    for a in ahead:
        seen, todo = set(), list(ahead[a])
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += ahead[b]
        out[a] = seen
    return ahead, out


def strong(pairs):
    _, reach = reached(pairs)
    return {a: min(b for b in reach[a] if a in reach[b]) for a in reach if a in reach[a]}


def got(spark, pairs):
    rows = plans.strong_components(spark.createDataFrame(list(pairs), SCHEMA)).collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: r["component"] for r in rows}


def test_strong_components_on_random_graphs(spark):
    rng = random.Random(11)
    for n, m in ((40, 48), (14, 30)):
        pairs = [(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)]
        assert got(spark, pairs + pairs[:5]) == strong(pairs)


def test_strong_components_of_special_shapes(spark):
    loops = [("a", "a"), ("b", "c"), ("c", "b"), ("c", "v"), ("v", "d"), ("d", "e"), ("e", "d"), (None, "a"), ("q", None), ("x", "y")]
    ears = [("r", "s1"), ("s1", "s2"), ("s2", "r"), ("r", "t1"), ("t1", "t2"), ("t2", "r"), ("r", "far"), ("far", "u"), ("u", "w"), ("w", "u"), ("w", "k"), ("k", "w")]
    pairs = loops + ears
    # v lies between two cycles and far leads to one: neither is on a cycle
    assert got(spark, pairs) == strong([p for p in pairs if None not in p])
    assert got(spark, [("x", "y"), ("y", "z")]) == {} and plans.strong_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_cycle_needs_few_rounds(spark, monkeypatch):
    n, rng, rounds = 3000, random.Random(3), []
    order = list(range(n))
    rng.shuffle(order)
    real = plans.kept
    monkeypatch.setattr(plans, "kept", lambda df, what="table": (rounds.append(what), real(df, what))[1])
    cycle = [(f"c{a:05d}", f"c{b:05d}") for a, b in zip(order, order[1:] + order[:1])]
    assert got(spark, cycle) == {f"c{i:05d}": "c00000" for i in range(n)}
    assert len(rounds) < 60
    df = spark.createDataFrame([*cycle, ("top", "root"), ("mid", "root")], SCHEMA)
    acyclic = plans.break_cycles(df, "root")
    assert {tuple(r) for r in acyclic.collect()} >= {("top", "root"), ("mid", "root")}
    # beyond the root's reach the order is the id's: only pairs to a smaller id stay
    assert {tuple(r) for r in acyclic.where(F.col("src").startswith("c")).collect()} == {(a, b) for a, b in cycle if b < a}


def shares(pairs):
    ahead, _ = reached(pairs)
    n, out = len(ahead), {}
    for s in ahead:
        dist, count, order, todo = {s: 0}, {s: 1.0}, [], deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in ahead[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    count[w] = 0.0
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    count[w] += count[v]
        for t in order[1:]:  # every path of this pair of ends, walked from its end
            paths = [(t,)]
            while paths and paths[0][0] != s:
                paths = [(v, *p) for p in paths for v in ahead if p[0] in ahead[v] and dist.get(v, -1) == dist[p[0]] - 1]
            assert len(paths) == count[t]
            for p in paths:
                for e in zip(p, p[1:]):
                    out[e] = out.get(e, 0.0) + 1 / len(paths)
    return {e: x / (n * (n - 1)) for e, x in out.items()}


def test_betweenness_against_all_shortest_paths(spark):
    rng = random.Random(5)
    pairs = {(f"n{rng.randrange(12):02d}", f"n{rng.randrange(12):02d}") for _ in range(26)} | {("n00", "n00")}
    made = {(r["src"], r["dst"]): r["score"] for r in plans.betweenness(spark.createDataFrame(sorted(pairs), SCHEMA)).collect()}
    want = shares(pairs)
    assert made.keys() == want.keys() and all(abs(made[e] - want[e]) < 1e-12 for e in want)
    assert plans.betweenness(spark.createDataFrame([("a", "a")], SCHEMA)).count() == 0
    assert plans.betweenness(spark.createDataFrame([], SCHEMA)).count() == 0
