"""Controlled damage: exactly k seeded draws without replacement, and what they do to a graph.

A draw orders rows by md5 of the seed and the row, so it does not depend on partitions. k is rho * n, rounded half to
even, at most n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import draw
from ..model import ABSTRACT, EXTENSION, RELATIONS, Graph, Relations
from ..plans.closure import betweenness
from ..storage import by_shuffle, kept

KEY = ("src", "dst", "relation")
ARMS = {"E-HX": "has_extension", "E-SO": "superset_of", "E-HE": "has_element"}


def sample_k(rows: DataFrame, rho: float | Column, seed, on: list[str], by: tuple[str, ...] = (), few: bool = False) -> DataFrame:
    """Of each group the k rows with the smallest draws. few: there are few groups, of a number that the caller bounds (such
    as a table of factors); what they cut at is then broadcast and no row is shuffled to be dropped.

    Draws fall into 65,536 bins by their first 16 bits. Whole bins below the one that holds the k-th draw are taken as
    they are; only the rows of that bin are ranked, so no task sorts a group.
    """
    share = rho if isinstance(rho, Column) else F.lit(float(rho))
    seeds = seed if isinstance(seed, (list, tuple)) else [seed]
    drawn = rows.withColumn("_draw", draw(*seeds, *(F.col(c) for c in on))).withColumn("_bin", F.conv(F.substring("_draw", 1, 4), 16, 10).cast("int"))
    bins = drawn.withColumn("_share", share).groupBy(*by, "_bin").agg(F.count("*").alias("_n"), F.max("_share").alias("_share"))
    w = Window.partitionBy(*by)  # over at most 65,536 rows of a group
    bins = bins.withColumns({"_to": F.sum("_n").over(w.orderBy("_bin")), "_all": F.sum("_n").over(w)})
    k = F.least(F.bround(F.col("_share") * F.col("_all")), F.col("_all")).cast("long")
    cut = bins.where(F.col("_to") >= k).groupBy(*by).agg(F.min(F.struct(F.col("_bin").alias("bin"), (k - F.col("_to") + F.col("_n")).alias("rest"))).alias("_cut"))
    if by:
        drawn = drawn.join(F.broadcast(cut) if few else cut, list(by))
    else:
        found = cut.first()  # one row: an aggregation without groups
        last, rest = (found["_cut"]["bin"], found["_cut"]["rest"]) if found and found["_cut"] else (0, 0)
        drawn = drawn.withColumn("_cut", F.struct(F.lit(last).alias("bin"), F.lit(rest).alias("rest")))
    sure = drawn.where(F.col("_bin") < F.col("_cut.bin"))
    edge = drawn.where(F.col("_bin") == F.col("_cut.bin"))
    edge = edge.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_bin").orderBy("_draw", *on))).where(F.col("_rank") <= F.col("_cut.rest"))
    return sure.select(*rows.columns).unionByName(edge.select(*rows.columns))


def ranked(rows: DataFrame, *order: Column | str, per: int = 1_000_000) -> DataFrame:
    """rows with a dense number from 0 on in a global order that no two rows share. The numbers come from the sizes of
    ranges of some `per` rows, so no task holds more than one range."""
    rows = kept(rows, "rows")
    ranged = rows.repartitionByRange(max(1, rows.count() // per), *order).withColumn("_p", F.spark_partition_id())
    # Written: a second evaluation could sample other ranges.
    own = kept(ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order))), "ranked")
    sizes = own.groupBy("_p").agg(F.count("*").alias("_n"))  # one row for each range
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return own.join(before, "_p").select(*rows.columns, (F.col("_before") + F.col("_i") - 1).alias("number"))


def corrupt(graph: Graph, arm: str, rho: float, seed: int, policy: str = "UNIF", guidance_removal: float = 0.0, distractor: float = 0.0, rewire: float = 0.0, rel: Relations = RELATIONS) -> tuple[Graph, DataFrame, DataFrame]:
    """(damaged graph, removed edges, injected edges). Arms: E-HX, E-SO, E-HE (one relation), E-MIX (each of the three),
    N-REM (extension nodes with their edges). Policy TARG removes the supersetOf edges of highest betweenness."""
    spark = graph.nodes.sparkSession
    edges, nodes = graph.edges, graph.nodes
    typed = edges.select(*KEY).distinct()
    if arm in ARMS:
        own = typed.where(F.col("relation") == getattr(rel, ARMS[arm]))
        if policy == "TARG":
            if arm != "E-SO":
                raise ValueError("policy TARG is defined for arm E-SO only")
            removed = targeted(own, rho)
        elif policy == "UNIF":
            removed = sample_k(own, rho, seed, list(KEY))
        else:
            raise ValueError(f"unknown policy {policy!r}")
    elif arm == "E-MIX":
        removed = sample_k(typed.where(F.col("relation").isin(rel.has_extension, rel.superset_of, rel.has_element)), rho, seed, list(KEY), ("relation",), few=True)
    elif arm == "N-REM":
        gone = sample_k(nodes.where(F.col("kind") == EXTENSION).select("id").distinct(), rho, seed, ["id"])
        removed = typed.join(gone.select(F.col("id").alias("src")), "src", "left_semi").unionByName(typed.join(gone.select(F.col("id").alias("dst")), "dst", "left_semi")).distinct()
        nodes = nodes.join(gone, "id", "left_anti")
    else:
        raise ValueError(f"unknown arm {arm!r}")
    injected = spark.createDataFrame([], "src string, dst string, relation string")
    # The other arms take edges of the taxonomy only.
    gone_edges = by_shuffle if arm in ("E-HE", "E-MIX", "N-REM") else lambda df: df
    left = lambda: edges.join(gone_edges(removed.select(*KEY)), list(KEY), "left_anti")
    if guidance_removal > 0:
        sub = left().where(F.col("relation") == rel.sub_class_of).select(*KEY).distinct()
        removed = removed.select(*KEY).unionByName(sample_k(sub, guidance_removal, f"{seed}g", list(KEY)))
    damaged = left()
    if distractor > 0:
        injected = injected.unionByName(distractors(Graph(nodes, damaged), distractor, seed, rel))
    if rewire > 0:
        cut, put = rewired(Graph(nodes, damaged), rewire, seed, rel)
        removed, injected = removed.select(*KEY).unionByName(cut), injected.unionByName(put)
        damaged = left()
    marked = injected.withColumn("layer", F.lit("abstract")).withColumn("distractor", F.lit(True))
    return Graph(nodes, damaged.unionByName(marked, allowMissingColumns=True)), removed.select(*KEY), injected


def targeted(superset: DataFrame, rho: float) -> DataFrame:
    """The top k edges by betweenness, ties by edge."""
    scores = betweenness(superset)
    k = superset.agg(F.bround(F.lit(float(rho)) * F.count("*")).cast("int")).first()[0]
    top = ranked(scores, F.bround("score", 12).desc(), "src", "dst").where(F.col("number") < k)
    return superset.join(top.select("src", "dst"), ["src", "dst"], "left_semi").select(*KEY)


def _numbered(nodes: DataFrame) -> tuple[DataFrame, int]:
    """Abstract nodes with a dense number each in order of id, and how many there are."""
    ids = nodes.where(F.col("kind") == ABSTRACT).select("id").distinct()
    return ranked(ids, "id"), ids.count()


def number(parts) -> Column:
    """A drawn number of 48 bits."""
    return F.conv(F.substring(draw(*parts), 1, 12), 16, 10).cast("long")


def free_number(blocked: Column, rank: Column) -> Column:
    """The number of that rank (from 0) among those that the sorted array lacks."""
    return F.aggregate(blocked, rank, lambda at, taken: F.when(taken <= at, at + 1).otherwise(at))


def _targets(edges: DataFrame, sources: DataFrame, numbered: DataFrame, by: list[str]) -> DataFrame:
    """(by, src, targets): numbers of the abstract nodes that an edge of any relation leads to, for the sources (by, src)."""
    own = edges.select("src", "dst").distinct().join(sources, "src").join(numbered.select(F.col("id").alias("dst"), "number"), "dst")
    return own.groupBy(*by, "src").agg(F.collect_set("number").alias("targets"))


def distractors(graph: Graph, rate: float, seed: int, rel: Relations = RELATIONS) -> DataFrame:
    """New wrong subClassOf edges between abstract nodes: rate * max(number of subClassOf edges, 1), none that exists in
    any relation, all different; fewer only where fewer pairs are free.

    A free pair has a rank, by its source and its place among the source's free targets; prefix sums of how many targets
    each source has free lead from a rank to the pair. The drawn ranks are the first different ones of a sequence of
    draws, or, where more than half of all are wanted, those of the smallest draws.
    """
    spark = graph.nodes.sparkSession
    n_sub = graph.edges.where(F.col("relation") == rel.sub_class_of).count()
    wanted = int(spark.range(1).select(F.bround(F.lit(rate * max(n_sub, 1)))).first()[0])
    numbered, n = _numbered(graph.nodes)
    numbered = kept(numbered, "numbered")
    named = numbered.select(F.col("id").alias("src"), F.col("number").alias("a"))
    taken = graph.edges.select("src", "dst").distinct().join(numbered.select(F.col("id").alias("dst")), "dst", "left_semi").where("src <> dst").groupBy("src").agg(F.count("*").alias("taken"))
    free = named.join(taken, "src", "left").select("src", "a", (F.lit(n - 1) - F.coalesce("taken", F.lit(0))).alias("free"), F.floor(F.col("a") / 100_000).alias("part"))
    free = kept(free, "free")
    parts = free.groupBy("part").agg(F.sum("free").alias("_all"))  # one row for each 100,000 nodes
    parts = parts.select("part", (F.sum("_all").over(Window.orderBy("part")) - F.col("_all")).alias("_before"))
    within = F.sum("free").over(Window.partitionBy("part").orderBy("a")) - F.col("free")
    starts = kept(free.withColumn("_in", within).join(parts, "part").select("src", "a", "free", (F.col("_in") + F.col("_before")).alias("start")), "starts")
    total = starts.agg(F.coalesce(F.sum("free"), F.lit(0))).first()[0]
    wanted = min(wanted, total)
    if 2 * wanted >= total:
        ranks = sample_k(spark.range(total).withColumnRenamed("id", "rank"), wanted / total if total else 0.0, f"{seed}d", ["rank"])
    else:
        tries = 2 * wanted + 16
        while True:
            first = spark.range(tries).select((number([seed, "d", F.col("id")]) % total).alias("rank"), F.col("id").alias("attempt")).groupBy("rank").agg(F.min("attempt").alias("attempt"))
            first = kept(first, "ranks")
            if first.count() >= wanted:
                break
            tries *= 2
        ranks = ranked(first, "attempt").where(F.col("number") < wanted).select("rank")
    # Sources and ranks meet by ranges of the mean length: a source lies in few of them, a range holds few sources.
    width = max(1, -(-total // max(n, 1)))
    place = lambda c: F.floor(c / F.lit(width))
    spread = starts.where("free > 0").withColumn("range", F.explode(F.sequence(place(F.col("start")), place(F.col("start") + F.col("free") - 1))))
    hit = ranks.withColumn("range", place(F.col("rank"))).join(spread, "range").where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("free")))
    hit = kept(hit.select("src", "a", (F.col("rank") - F.col("start")).alias("rank")), "drawn")
    blocked = F.array_sort(F.array_distinct(F.concat(F.coalesce("targets", F.array().cast("array<bigint>")), F.array("a"))))
    found = hit.join(_targets(graph.edges, hit.select("src").distinct(), numbered, []), "src", "left").select("src", free_number(blocked, F.col("rank")).alias("number"))
    return found.join(numbered.select("number", F.col("id").alias("dst")), "number").select("src", "dst", F.lit(rel.sub_class_of).alias("relation"))


def wrong_parents(nodes: DataFrame, edges: DataFrame, cut: DataFrame, seed: str | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, src, dst): a drawn new parent for each edge of cut (by, src, dst), one edge of a child after the other.

    A new parent is an abstract node, neither child nor old parent, to which the child has no edge at that time: edges cut
    before are gone, new ones are there. It is the one of drawn rank among those, so an edge gets none only if none is free.
    Children do not depend on each other; one child's parents are an array, which is as long as it has parents.
    """
    by = list(by)
    numbered, n = _numbered(nodes)
    numbered = kept(numbered, "numbered")
    at = lambda side, name: numbered.select(F.col("id").alias(side), F.col("number").alias(name))
    lot = draw(seed, "to", F.col("src"), F.col("dst"))
    steps = cut.join(at("dst", "old"), "dst", "left").groupBy(*by, "src").agg(F.array_sort(F.collect_list(F.struct(lot.alias("lot"), F.coalesce("old", F.lit(-1).cast("long")).alias("old")))).alias("steps"))
    child = steps.join(at("src", "own"), "src", "left").join(_targets(edges, cut.select(*by, "src").distinct(), numbered, by), [*by, "src"], "left")

    def turn(s: Column, step: Column) -> Column:
        there = F.array_remove(s["there"], step["old"])
        blocked = F.array_sort(F.filter(F.array_distinct(F.concat(there, F.array(step["old"], F.coalesce("own", F.lit(-1).cast("long"))))), lambda x: x >= 0))
        drawn = F.conv(F.substring(step["lot"], 1, 12), 16, 10).cast("long")
        # One-element arrays hold what is used more than once.
        new = F.transform(F.array(F.struct(there.alias("there"), blocked.alias("blocked"))), lambda t: F.struct(t["there"].alias("there"), F.when(F.size(t["blocked"]) < n, free_number(t["blocked"], drawn % (F.lit(n) - F.size(t["blocked"])))).alias("new")))
        return F.transform(new, lambda t: F.struct(F.when(t["new"].isNull(), t["there"]).otherwise(F.array_append(t["there"], t["new"])).alias("there"), F.when(t["new"].isNull(), s["put"]).otherwise(F.array_append(s["put"], t["new"])).alias("put")))[0]

    none = F.array().cast("array<bigint>")
    start = F.struct(F.coalesce("targets", none).alias("there"), none.alias("put"))
    put = child.select(*by, "src", F.explode(F.aggregate("steps", start, turn, lambda s: s["put"])).alias("number"))
    return put.join(numbered.select("number", F.col("id").alias("dst")), "number").select(*by, "src", "dst")


def rewired(graph: Graph, rate: float, seed: int, rel: Relations = RELATIONS) -> tuple[DataFrame, DataFrame]:
    """(removed, injected): a share of the subClassOf edges, each led to a drawn wrong parent (see wrong_parents)."""
    sub = graph.edges.where(F.col("relation") == rel.sub_class_of).select(*KEY).distinct()
    cut = kept(sample_k(sub, rate, f"{seed}w", list(KEY)), "cut")
    put = wrong_parents(graph.nodes, graph.edges, cut.select("src", "dst"), str(seed))
    return cut, put.select("src", "dst", F.lit(rel.sub_class_of).alias("relation")).distinct()


def holdout(pairs: DataFrame, share: float, seed: int) -> DataFrame:
    """pairs (instance, concept) with held: true for exactly round(share * n) of them."""
    key = ["instance", "concept"]
    own = pairs.select(*key).distinct()
    chosen = sample_k(own, share, seed, key).withColumn("held", F.lit(True))
    return own.join(by_shuffle(chosen), key, "left").withColumn("held", F.coalesce("held", F.lit(False)))


def flat_preimage(removed: DataFrame, rel: Relations = RELATIONS, by: tuple[str, ...] = ()) -> DataFrame:
    """The flat edges that removed dual edges stand for; hasExtension stands for none."""
    from ..functions.ids import name_of

    u, v = name_of(F.col("src")), name_of(F.col("dst"))
    r = F.col("relation")
    turned = r.isin(rel.superset_of, rel.has_element)
    kept_rows = removed.where(turned | (r == rel.sub_class_of))
    return kept_rows.select(*by, F.when(turned, v).otherwise(u).alias("src"), F.when(turned, u).otherwise(v).alias("dst"), F.when(r == rel.has_element, rel.instance_of).otherwise(rel.sub_class_of).alias("relation")).distinct()


def without_edges(flat: Graph, gone: DataFrame) -> Graph:
    key = [*flat.by, *KEY]
    return Graph(flat.nodes, flat.edges.join(by_shuffle(gone.select(*key)), key, "left_anti"), flat.by)


def single_node_valid(flat: Graph, expected: DataFrame, rel: Relations = RELATIONS) -> DataFrame:
    """Expected pairs that the flat graph still yields."""
    from .threads import expected_from_flat

    key = [*flat.by, "instance", "concept"]
    return expected_from_flat(flat, rel).join(by_shuffle(expected.select(*key)), key, "left_semi")
