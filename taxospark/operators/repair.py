"""Repair: propose the edges that broken pairs lack, score them, gate and cap them, add them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import abstract_id, concept_of, extension_id, name_of
from ..model import RELATIONS, Graph, Relations
from ..plans.closure import closure, reflexive, shortest_paths
from ..storage import by_shuffle, kept
from .threads import memberships, taxonomy

# Prior confidence by relation (fixed values).
PRIOR = {"hasExtension": 1.0, "supersetOf": 0.9, "hasElement": 0.55}
MIN_CONFIDENCE, MAX_NEW_EDGES = 0.75, 100

Scorer = Callable[[DataFrame, Graph], DataFrame]


def _tax_nodes(tax: DataFrame, by: list[str]) -> DataFrame:
    return tax.select(*by, F.col("src").alias("id")).unionByName(tax.select(*by, F.col("dst").alias("id"))).distinct()


def leaf_concepts(graph: Graph, report: DataFrame, closed: DataFrame, tax: DataFrame, rel: Relations = RELATIONS) -> DataFrame:
    """(by, instance, leaf) for instances with a broken pair: direct concepts; without any, the expected concepts in the
    taxonomy below which no other expected one lies."""
    by = list(graph.by)
    broken = report.where("not is_valid").select(*by, "instance").distinct()
    direct = memberships(graph, rel).join(by_shuffle(broken), [*by, "instance"], "left_semi").select(*by, "instance", F.col("concept").alias("leaf"))
    bare = broken.join(by_shuffle(direct.select(*by, "instance").distinct()), [*by, "instance"], "left_anti")
    wanted = report.join(by_shuffle(bare), [*by, "instance"], "left_semi").select(*by, "instance", "concept").distinct()
    above = wanted.join(closed.select(*by, F.col("src").alias("concept"), "dst"), [*by, "concept"]).select(*by, "instance", F.col("dst").alias("concept")).distinct()
    lowest = wanted.join(by_shuffle(above), [*by, "instance", "concept"], "left_anti").join(_tax_nodes(tax, by).withColumnRenamed("id", "concept"), [*by, "concept"], "left_semi")
    return direct.unionByName(lowest.select(*by, "instance", F.col("concept").alias("leaf")))


def proposals(graph: Graph, report: DataFrame, rel: Relations = RELATIONS, drop_self_loops: bool = False) -> DataFrame:
    """(by, src, dst, relation, base_confidence, reason, parent_concept, child_concept, concept, leaf_concept, instance).

    Edges between existing nodes only, none that is there already, each once. Paths are worked out for distinct (leaf,
    concept), not for pairs. An unexpanded concept with a broken pair yields a loop on itself unless that is dropped.
    """
    by = list(graph.by)
    tax = kept(taxonomy(graph, rel), "taxonomy")
    closed = kept(closure(tax, graph.by), "closure")
    leaves = kept(leaf_concepts(graph, report, closed, tax, rel), "leaves")
    broken = report.where("not is_valid").select(*by, "instance", "concept")
    routes = broken.join(by_shuffle(leaves), [*by, "instance"])
    known = reflexive(closed, _tax_nodes(tax, by), graph.by).select(*by, F.col("src").alias("leaf"), F.col("dst").alias("concept"))
    routes = kept(routes.join(known, [*by, "leaf", "concept"], "left_semi"), "routes")
    paths = shortest_paths(tax, routes.select(*by, F.col("leaf").alias("src"), F.col("concept").alias("dst")).distinct(), graph.by)
    ids = graph.nodes.select(*by, "id").distinct()

    def side(df: DataFrame, column: str, make, out: str) -> DataFrame:
        """The dual node of a concept where it exists, else the concept's own id."""
        twin = ids.where(concept_of(F.col("id")).isNotNull()).select(*by, F.col("id").alias("_twin"))  # no members
        named = df.withColumn("_twin", make(F.col(column)))
        return named.join(twin.withColumn("_there", F.lit(True)), [*by, "_twin"], "left").withColumn(out, F.when(F.col("_there"), F.col("_twin")).otherwise(F.col(column))).drop("_twin", "_there")

    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    heads = paths.select(*by, F.col("dst").alias("concept")).distinct()
    heads = side(side(heads, "concept", abstract_id, "u"), "concept", extension_id, "v")
    first = heads.select(*by, F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(rel.has_extension).alias("relation"), F.lit(PRIOR["hasExtension"]).alias("base_confidence"), F.format_string("%s should have an extension node of its own", "concept").alias("reason"), *none("parent_concept", "child_concept"), F.col("concept"), *none("leaf_concept", "instance"))
    steps = paths.where(F.size("path") > 1).select(*by, F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("child"), F.element_at("path", i + 1).alias("parent")))).alias("s")).select(*by, "s.child", "s.parent").distinct()
    steps = side(side(steps, "parent", extension_id, "u"), "child", extension_id, "v")
    middle = steps.select(*by, F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(rel.superset_of).alias("relation"), F.lit(PRIOR["supersetOf"]).alias("base_confidence"), F.format_string("the taxonomy places %2$s below %1$s", "parent", "child").alias("reason"), F.col("parent").alias("parent_concept"), F.col("child").alias("child_concept"), *none("concept", "leaf_concept", "instance"))
    ends = side(routes.select(*by, "leaf", "instance").distinct(), "leaf", extension_id, "u")
    last = ends.select(*by, F.col("u").alias("src"), F.col("instance").alias("dst"), F.lit(rel.has_element).alias("relation"), F.lit(PRIOR["hasElement"]).alias("base_confidence"), F.format_string("new member of %s: %s", "leaf", "instance").alias("reason"), *none("parent_concept", "child_concept", "concept"), F.col("leaf").alias("leaf_concept"), F.col("instance"))
    found = first.unionByName(middle).unionByName(last)
    for end in ("src", "dst"):
        found = found.join(by_shuffle(ids.select(*by, F.col("id").alias(end))), [*by, end], "left_semi")
    key = [*by, "src", "dst", "relation"]
    found = found.join(by_shuffle(graph.edges.select(*key).distinct()), key, "left_anti").dropDuplicates(key)
    if drop_self_loops:
        found = found.where("src <> dst")
    return found.select(*key, "base_confidence", "reason", "parent_concept", "child_concept", "concept", "leaf_concept", "instance")


def prior_scorer(found: DataFrame, graph: Graph) -> DataFrame:
    return found.withColumn("confidence", F.col("base_confidence"))


def corroboration_scorer(floor: float = 0.0, cap: int = 5, use_subclass: bool = True, use_superset: bool = True, rel: Relations = RELATIONS) -> Scorer:
    """Scores a supersetOf proposal by the other routes that entail it: k neighbours, in either layer, through which the
    far end is still reached without the direct edge. base * (floor + (1 - floor) * (1 - 1 / (1 + k))), k at most cap."""
    if not 0.0 <= floor <= 1.0:
        raise ValueError("floor must lie in [0, 1]")

    def score(found: DataFrame, graph: Graph) -> DataFrame:
        by = list(graph.by)
        key = [*by, "parent_concept", "child_concept"]
        asked = found.where(F.col("relation") == rel.superset_of).select(*key).distinct()
        layers = []
        if use_subclass:
            layers.append((taxonomy(graph, rel), "child_concept", "parent_concept"))
        if use_superset:
            named = graph.relation(rel.superset_of).select(*by, name_of(F.col("src")).alias("src"), name_of(F.col("dst")).alias("dst")).distinct()
            layers.append((named, "parent_concept", "child_concept"))
        routes = None
        for pairs, near, far in layers:
            closed = closure(pairs, graph.by)
            nb = asked.join(pairs.select(*by, F.col("src").alias(near), F.col("dst").alias("nb")), [*by, near]).where(F.col("nb") != F.col(far))
            nb = nb.join(closed.select(*by, F.col("src").alias("nb"), F.col("dst").alias(far)), [*by, "nb", far], "left_semi").select(*key)
            routes = nb if routes is None else routes.unionByName(nb)
        counted = asked.withColumn("k", F.lit(0)) if routes is None else routes.groupBy(*key).agg(F.least(F.count("*"), F.lit(cap)).alias("k"))
        k = F.coalesce("k", F.lit(0)).cast("double")
        value = F.col("base_confidence") * (F.lit(floor) + F.lit(1.0 - floor) * (F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + k)))
        return found.join(counted, key, "left").withColumn("confidence", F.when(F.col("relation") == rel.superset_of, value).otherwise(F.col("base_confidence"))).drop("k")

    return score


def gate(scored: DataFrame, min_confidence: float = MIN_CONFIDENCE, max_new_edges: int | None = MAX_NEW_EDGES, by: tuple[str, ...] = ()) -> DataFrame:
    """scored with applied and skip_reason: confidence first, then the cap, in order of (confidence desc, src, dst,
    relation). A top-k for one graph; for many, a window for each. None is no cap: a filter without order."""
    low = F.concat(F.lit("confidence "), F.col("confidence").cast("string"), F.lit(f" < min_confidence {min_confidence}"))
    if max_new_edges is None:
        enough = F.coalesce(F.col("confidence") >= min_confidence, F.lit(False))
        return scored.withColumn("applied", enough).withColumn("skip_reason", F.when(~F.col("applied"), low))
    order = [F.col("confidence").desc(), "src", "dst", "relation"]
    passed = scored.where(F.col("confidence") >= min_confidence)
    key = [*by, "src", "dst", "relation"]
    if by:
        from pyspark.sql import Window

        chosen = passed.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= max_new_edges)
    else:
        chosen = passed.orderBy(*order).limit(max_new_edges)
    marked = scored.join(chosen.select(*key).withColumn("applied", F.lit(True)), key, "left").withColumn("applied", F.coalesce("applied", F.lit(False)))
    reason = F.when(F.col("applied"), F.lit(None).cast("string")).when(F.col("confidence") < min_confidence, low).otherwise(F.lit(f"max_new_edges cap ({max_new_edges}) reached"))
    return marked.withColumn("skip_reason", reason)


def apply(graph: Graph, gated: DataFrame) -> Graph:
    """The graph with the applied edges, tagged as repaired."""
    new = gated.where("applied").select(*graph.by, "src", "dst", "relation", F.lit(True).alias("repaired"))
    return Graph(graph.nodes, graph.edges.unionByName(new, allowMissingColumns=True), graph.by)


def repair(graph: Graph, report: DataFrame, scorer: Scorer = prior_scorer, min_confidence: float = MIN_CONFIDENCE, max_new_edges: int | None = MAX_NEW_EDGES, enabled: bool = True, drop_self_loops: bool = False, rel: Relations = RELATIONS) -> tuple[Graph, DataFrame]:
    """(repaired graph, gated proposals), in one pass; scores come from the graph as it was."""
    found = kept(proposals(graph, report, rel, drop_self_loops), "proposals")
    if not enabled:
        found = found.limit(0)
    gated = kept(gate(scorer(found, graph), min_confidence, max_new_edges, graph.by), "gated")
    return apply(graph, gated), gated
