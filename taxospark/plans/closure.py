"""Closures, walks, shortest paths and components as loops over joins.

Each round writes what it found to the shared folder, which cuts the lineage; what a loop has found before is a log of
such parts and never written again. Loops end on cycles too. Their tables are as large as the taxonomy's closure;
memberships never take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Log, kept


def closure(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, src, dst) for every dst that is reached from src over one or more pairs, without (x, x).

    Doubling: a round joins what is new with all that is known, on either side, so rounds grow with the logarithm of
    the depth. Every pair of the closure is written once.
    """
    key = [*by, "src", "dst"]
    log = Log(pairs.select(*key).distinct(), "closure")
    new = log.last()
    while True:
        total = log.table()
        ahead = new.join(total.select(*by, F.col("src").alias("dst"), F.col("dst").alias("far")), [*by, "dst"])
        behind = total.join(new.select(*by, F.col("src").alias("dst"), F.col("dst").alias("far")), [*by, "dst"])
        found = ahead.unionByName(behind).select(*by, "src", F.col("far").alias("dst")).distinct()
        new = log.add(found.join(total, key, "left_anti"))
        if new.isEmpty():
            return total.where("src <> dst")


def reflexive(closed: DataFrame, ids: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The closure with (x, x) for each of ids (by, id)."""
    return closed.select(*by, "src", "dst").unionByName(ids.select(*by, F.col("id").alias("src"), F.col("id").alias("dst")).distinct())


def reach(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ids that are reached from seeds (id) over pairs, the seeds among them: a walk of the frontier alone."""
    log = Log(seeds.select("id").distinct(), "reach")
    frontier = log.last()
    while True:
        seen = log.table()
        nxt = pairs.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = log.add(nxt.join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            return seen


def shortest_paths(pairs: DataFrame, wanted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, src, dst, path) for the wanted (by, src, dst): shortest, then lexicographically smallest, as an array of ids.

    src = dst gives the path of one id if wanted. Levels are walked only from wanted sources to nodes not yet reached.
    """
    edges = pairs.select(*by, F.col("src").alias("at"), F.col("dst").alias("to")).distinct()
    start = wanted.select(*by, "src").distinct()
    log = Log(start.select(*by, "src", F.col("src").alias("dst"), F.array("src").alias("path")), "paths")
    level = log.last()
    while True:
        seen = log.table()
        step = level.join(edges, [*(level[c] == edges[c] for c in by), level["dst"] == edges["at"]])
        step = step.select(*(level[c] for c in by), "src", F.col("to").alias("dst"), F.concat("path", F.array("to")).alias("path"))
        best = step.join(seen.select(*by, "src", "dst"), [*by, "src", "dst"], "left_anti").groupBy(*by, "src", "dst").agg(F.min("path").alias("path"))
        level = log.add(best)
        if level.isEmpty():
            return seen.join(wanted.select(*by, "src", "dst").distinct(), [*by, "src", "dst"], "left_semi")


def widest(weighted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, src, dst, width): the largest, over all paths, of a path's smallest weight. weighted: (by, src, dst, weight).

    Doubling as in closure; a round joins only the pairs whose width rose, and writes only those that rise again.
    """
    key = [*by, "src", "dst"]
    log = Log(weighted.groupBy(*key).agg(F.max("weight").alias("width")), "widest")
    new = log.last()
    while True:
        total = log.table().groupBy(*key).agg(F.max("width").alias("width"))
        on = lambda t: t.select(*by, F.col("src").alias("dst"), F.col("dst").alias("far"), F.col("width").alias("w"))
        longer = new.join(on(total), [*by, "dst"]).unionByName(total.join(on(new), [*by, "dst"]))
        found = longer.groupBy(*by, "src", F.col("far").alias("dst")).agg(F.max(F.least("width", "w")).alias("width"))
        known = total.select(*key, F.col("width").alias("before"), F.lit(True).alias("known"))
        rises = "known is null or width > before or (before is null and width is not null)"
        new = log.add(found.join(known, key, "left").where(rises))
        if new.isEmpty():
            return total.where("src <> dst")


def component_of(pairs: DataFrame, root: str) -> DataFrame:
    """Ids of the weakly connected component that holds root."""
    both = pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return reach(kept(both, "both"), pairs.sparkSession.createDataFrame([(root,)], "id string"))


def components(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, id, component): the smallest id of each weakly connected component, for every id of the pairs (by, src, dst).

    Every id is linked to the smallest one of its neighbourhood, in turn by its larger and by its smaller neighbours, until
    the links are stars; rounds grow with the logarithm of the longest path. A hub's links are aggregated before they are
    shuffled, and no round makes more links than it got, but for one each id.
    """
    by = list(by)
    ids = kept(pairs.select(*by, F.col("src").alias("id")).unionByName(pairs.select(*by, F.col("dst").alias("id"))).where("id is not null").distinct(), "ids")
    pair = F.struct(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    links = kept(pairs.where(F.col("src") != F.col("dst")).select(*by, pair.alias("p")).select(*by, "p.*").distinct(), "links")
    seen = None
    while True:
        both = links.unionByName(links.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy(*by, "u").agg(F.min("v").alias("m")).select(*by, "u", F.least("u", "m").alias("m"))
        large = both.join(lowest, [*by, "u"]).where(F.col("v") > F.col("u")).select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy(*by, "u").agg(F.min("v").alias("m"))
        small = large.join(lower, [*by, "u"]).select(*by, F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = kept(small.where(F.col("u") != F.col("v")).distinct(), "links")
        h = F.xxhash64(*by, "u", "v")  # equal sets have equal counts, sums and exclusive sums of hashes
        now = links.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
        if now == seen:
            break
        seen = now
    return ids.join(links.select(*by, F.col("u").alias("id"), F.col("v").alias("component")), [*by, "id"], "left").withColumn("component", F.coalesce("component", "id"))


def cyclic_core(pairs: DataFrame) -> DataFrame:
    """The pairs that stay when nodes without way in or without way out are peeled off, again and again."""
    left = kept(pairs.select("src", "dst").distinct(), "core")
    n = left.count()
    while n:
        peeled = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        peeled = peeled.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        left = kept(peeled, "core")
        m = left.count()
        if m == n:
            break
        n = m
    return left


def is_acyclic(pairs: DataFrame) -> bool:
    return cyclic_core(pairs).isEmpty()


def _highest(pairs: DataFrame, order: Column) -> DataFrame:
    """(id, top): for every id of the pairs the highest id, in the given order of src, that reaches it, itself included.

    A round takes the tops of the neighbours before and the top of the own top, which is reached by it, so rounds grow with
    the logarithm of the way where tops are far apart.
    """
    ids = pairs.select("src").union(pairs.select("dst")).distinct()
    tops = kept(ids.select(F.col("src").alias("id"), F.struct(order.alias("o"), F.col("src").alias("i")).alias("top")), "tops")
    while True:
        ahead = pairs.join(tops.select(F.col("id").alias("src"), "top"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("top").alias("top"))
        over = tops.select("id", F.col("top.i").alias("via")).join(tops.select(F.col("id").alias("via"), "top"), "via").select("id", "top")
        best = ahead.unionByName(over).groupBy("id").agg(F.max("top").alias("best"))
        now = kept(tops.join(best, "id", "left").select("id", F.greatest("top", "best").alias("top"), (F.col("best") > F.col("top")).alias("rose")), "tops")
        tops = now.select("id", "top")
        if now.where("rose").isEmpty():
            return tops.select("id", F.col("top.i").alias("top"))


def _coloured(pairs: DataFrame) -> DataFrame:
    """(id, component) by forward and backward colouring. The ids that share a highest id before them form a colour; those
    that also reach it inside the colour are its component. All colours are worked on at once; what is left over goes on
    inside its colour. The pairs are a cyclic core; ids on no cycle may form components of one."""
    done, left = None, pairs
    while not left.isEmpty():
        before = _highest(left, F.xxhash64("src"))  # mixed, so that few colours hold many components behind one another
        own = left.join(before.select(F.col("id").alias("src"), "top"), "src").join(before.select(F.col("id").alias("dst"), F.col("top").alias("other")), "dst")
        inside = kept(own.where(F.col("top") == F.col("other")).select("src", "dst"), "inside")
        after = _highest(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), F.xxhash64("src"))
        found = kept(before.join(after.withColumnRenamed("top", "back"), "id").where(F.col("top") == F.col("back")).select("id", F.col("top").alias("component")), "strong")
        done = found if done is None else done.unionByName(found)
        rest = inside.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti")
        left = cyclic_core(rest)
    return pairs.select(F.col("src").alias("id"), F.col("src").alias("component")).where("false") if done is None else done


def _strong(pairs: DataFrame) -> DataFrame:
    """(id, component) as _coloured, with runs of nodes that have one way in and one way out drawn together first.

    Such a run is one pair from the node before it to the node after it; it belongs to their component if they share one.
    A run without a node before it is a whole cycle. The contraction is repeated while it takes a quarter of the pairs.
    """
    core = cyclic_core(pairs)
    ends = core.groupBy(F.col("src").alias("id")).count().where("count = 1").select("id")
    single = kept(ends.join(core.groupBy(F.col("dst").alias("id")).count().where("count = 1").select("id"), "id"), "single")
    n, m = core.count(), single.count()
    if 4 * m < n or not m:
        return _coloured(core)
    flag = lambda side: single.select(F.col("id").alias(side), F.lit(True).alias(f"{side}_in"))
    marked = kept(core.join(flag("src"), "src", "left").join(flag("dst"), "dst", "left").fillna(False, ["src_in", "dst_in"]), "marked")
    linked = components(marked.where("src_in and dst_in").select("src", "dst"))
    runs = kept(single.join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("run")), "runs")
    first = marked.where("not src_in and dst_in").join(runs.select(F.col("id").alias("dst"), "run"), "dst").select("run", F.col("src").alias("u"))
    last = marked.where("src_in and not dst_in").join(runs.select(F.col("id").alias("src"), "run"), "src").select("run", F.col("dst").alias("w"))
    bridges = kept(first.join(last, "run"), "bridges")
    rest = marked.where("not src_in and not dst_in").select("src", "dst").unionByName(bridges.select(F.col("u").alias("src"), F.col("w").alias("dst")))
    inner = kept(_strong(rest), "strong")
    at = lambda side: inner.select(F.col("id").alias(side), F.col("component").alias(f"{side}_part"))
    closed = bridges.join(at("u"), "u").join(at("w"), "w").where("u_part = w_part").select("run", F.col("u_part").alias("component"))
    whole = runs.join(bridges.select("run"), "run", "left_anti").select("id", F.col("run").alias("component"))
    return inner.unionByName(runs.join(closed, "run").select("id", "component")).unionByName(whole)


def strong_components(pairs: DataFrame) -> DataFrame:
    """(id, component): for every id on a cycle of the pairs (src, dst) the smallest id that it can reach and that reaches
    it. Ids on no cycle, null ids and all ids of an empty table have no row; repeated pairs count once, and a pair of an id
    with itself is a cycle. No closure is made: the tables are as large as the cyclic core."""
    pairs = pairs.select("src", "dst").where("src is not null and dst is not null").distinct()
    parts = kept(_strong(pairs), "strong")
    sizes = parts.groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    loops = pairs.where("src = dst").select(F.col("src").alias("id"), F.lit(True).alias("loop"))
    named = parts.join(sizes, "component").join(loops, "id", "left").where("n > 1 or loop")
    return named.select("id", F.col("least").alias("component"))


def break_cycles(pairs: DataFrame, root: str) -> DataFrame:
    """child -> parent pairs without cycles: inside a strongly connected part only pairs that lead towards the root in
    the order of (distance to the root, id) stay."""
    parts = kept(strong_components(pairs), "parts")
    own = pairs.select("src", "dst").distinct().join(parts.select(F.col("id").alias("src"), F.col("component").alias("a")), "src")
    inside = own.join(parts.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst").where("a = b").select("src", "dst")
    down = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    depth = kept(levels(down, root), "depth")
    far = lambda side: depth.select(F.col("id").alias(side), F.col("depth").alias(f"{side}_depth"))
    ranked = inside.join(far("src"), "src", "left").join(far("dst"), "dst", "left")
    rank = lambda side: F.struct(F.coalesce(f"{side}_depth", F.lit(1 << 30)).alias("d"), F.col(side).alias("i"))
    bad = ranked.where(~(rank("dst") < rank("src"))).select("src", "dst")
    return pairs.select("src", "dst").distinct().join(bad, ["src", "dst"], "left_anti")


def levels(pairs: DataFrame, root: str, limit: int | None = None) -> DataFrame:
    """(id, depth): distance from root over pairs."""
    spark = pairs.sparkSession
    log = Log(spark.createDataFrame([(root, 0)], "id string, depth int"), "levels")
    frontier, depth = log.last(), 0
    while limit is None or depth < limit:
        depth += 1
        nxt = pairs.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = log.add(nxt.join(log.table(), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
    return log.table()


def betweenness(pairs: DataFrame) -> DataFrame:
    """(src, dst, score): share of shortest paths over an edge, summed over all ordered pairs, by n(n-1).

    Path counts go forward from each source level by level, dependencies come back level by level: the last edge into a
    node carries its share of the node's own pair and of all that was carried beyond it. The tables have a row for each
    source and edge on a shortest path from it; sources and targets never meet.
    """
    edges = kept(pairs.select("src", "dst").distinct(), "edges")
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    log = Log(ids.select(F.col("id").alias("s"), F.col("id").alias("t"), F.lit(0).alias("d"), F.lit(1.0).cast("double").alias("paths")), "sigma")
    level, depth = log.last(), 0
    while True:
        seen = log.table()
        step = level.join(edges, level["t"] == edges["src"]).groupBy("s", F.col("dst").alias("t")).agg((F.first("d") + 1).alias("d"), F.sum("paths").alias("paths"))
        level = log.add(step.join(seen.select("s", "t"), ["s", "t"], "left_anti"))
        if level.isEmpty():
            break
        depth += 1
    near = edges.join(seen.select("s", F.col("t").alias("src"), (F.col("d") + 1).alias("d"), F.col("paths").alias("before")), "src")
    steps = kept(near.join(seen.select("s", F.col("t").alias("dst"), "d", "paths"), ["s", "dst", "d"]).select("s", "src", "dst", "d", (F.col("before") / F.col("paths")).alias("share")), "steps")
    beyond, scores = None, None
    for d in range(depth, 0, -1):
        here = steps.where(F.col("d") == d)
        here = here.withColumn("more", F.lit(0.0)) if beyond is None else here.join(beyond, ["s", "dst"], "left").fillna(0.0, ["more"])
        carried = kept(here.select("s", "src", "dst", (F.col("share") * (F.col("more") + 1)).alias("score")), "carried")
        beyond = carried.groupBy("s", F.col("src").alias("dst")).agg(F.sum("score").alias("more"))
        part = carried.select("src", "dst", "score")
        scores = part if scores is None else scores.unionByName(part)
    n = ids.count()
    if scores is None:
        return edges.where("false").withColumn("score", F.lit(0.0))
    return scores.groupBy("src", "dst").agg((F.sum("score") / F.lit(float(n * (n - 1) or 1))).alias("score"))
