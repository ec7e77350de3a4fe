"""Threads: typed paths from a concept to its members, found for all pairs at once.

abstract:C -hasExtension-> entry -supersetOf*-> node -hasElement-> instance
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import ABSTRACT_PREFIX, abstract_id, concept_of, name_of
from ..model import ABSTRACT, INSTANCE, RELATIONS, Graph, Relations
from ..plans.closure import closure, reach, reflexive, shortest_paths
from ..storage import by_shuffle, kept
from .folding import fanned_out, fold


def taxonomy(graph: Graph, rel: Relations = RELATIONS) -> DataFrame:
    """Concept names (by, src child, dst parent): of all subClassOf edges, or of supersetOf where a graph has none."""
    by = list(graph.by)
    named = lambda r, a, b: graph.relation(r).select(*by, name_of(F.col(a)).alias("src"), name_of(F.col(b)).alias("dst")).distinct()
    sub = named(rel.sub_class_of, "src", "dst")
    if not by:
        return sub if not sub.isEmpty() else named(rel.superset_of, "dst", "src")
    return sub.unionByName(named(rel.superset_of, "dst", "src").join(sub.select(*by).distinct(), by, "left_anti"))


def memberships(graph: Graph, rel: Relations = RELATIONS) -> DataFrame:
    """(by, instance, concept): direct hasElement parents of instance nodes."""
    by = list(graph.by)
    held = graph.relation(rel.has_element).select(*by, F.col("dst").alias("instance"), name_of(F.col("src")).alias("concept")).distinct()
    return held.join(by_shuffle(instances(graph)), [*by, "instance"], "left_semi")


def instances(graph: Graph) -> DataFrame:
    return graph.nodes.where(F.col("kind") == INSTANCE).select(*graph.by, F.col("id").alias("instance")).distinct()


def _held(graph: Graph, rel: Relations = RELATIONS) -> DataFrame:
    """(by, instance, item): the nodes that hold each id over hasElement."""
    return graph.relation(rel.has_element).select(*graph.by, F.col("dst").alias("instance"), F.col("src").alias("item"))


def _folded_members(graph: Graph, rel: Relations = RELATIONS) -> tuple[DataFrame, DataFrame]:
    """(members, sets) of the instance nodes, by the array `nodes` of what holds them."""
    kind = graph.nodes.where(F.col("kind") == INSTANCE).select(*graph.by, F.col("id").alias("instance"), F.lit(INSTANCE).alias("item"))
    return fold(graph.by, ("nodes", "kind"), nodes=_held(graph, rel), kind=kind)


def bytes_of(array: str) -> Column:
    return F.aggregate(array, F.lit(0), lambda total, x: total + F.octet_length(x["concept"]) + 24)


def expected_pairs(graph: Graph, rel: Relations = RELATIONS, closed: DataFrame | None = None) -> DataFrame:
    """(by, instance, concept): direct concepts and all their ancestors, as the graph itself has them.

    Members are shuffled once, by instance; the ancestors of their classes are united for each distinct set of classes.
    """
    by = list(graph.by)
    members, sets = _folded_members(graph, rel)
    closed = closure(taxonomy(graph, rel), graph.by) if closed is None else closed
    found = expected_of_sets(sets, closed, by).groupBy(*by, "set_id").agg(F.collect_list(F.struct("concept")).alias("concepts"))
    return fanned_out(members, found, by, "concepts", bytes_of("concepts"))


def expected_of_sets(sets: DataFrame, closed: DataFrame, by: list[str], array: str = "nodes") -> DataFrame:
    """(by, set_id, concept): the concepts of a set's nodes and all their ancestors."""
    own = sets.select(*by, "set_id", F.explode(F.transform(array, name_of)).alias("concept"))
    above = own.join(closed.select(*by, F.col("src").alias("concept"), "dst"), [*by, "concept"]).select(*by, "set_id", F.col("dst").alias("concept"))
    return own.unionByName(above).distinct()


def expected_from_flat(flat: Graph, rel: Relations = RELATIONS) -> DataFrame:
    by = list(flat.by)
    own = flat.relation(rel.instance_of).select(*by, F.col("src").alias("instance"), F.col("dst").alias("concept")).distinct()
    closed = closure(flat.relation(rel.sub_class_of), flat.by)
    above = own.join(closed.select(*by, F.col("src").alias("concept"), "dst"), [*by, "concept"]).select(*by, "instance", F.col("dst").alias("concept"))
    return own.unionByName(above).distinct()


def entries(graph: Graph, rel: Relations = RELATIONS) -> DataFrame:
    """(by, concept, start, entry): where a concept's threads enter the extension side.

    With a node abstract:C, only over its hasExtension edges. Without one, over those of C itself, and if it has none,
    at C itself.
    """
    by = list(graph.by)
    out = graph.relation(rel.has_extension).select(*by, F.col("src").alias("start"), F.col("dst").alias("entry")).distinct()
    abstract = graph.nodes.where(F.col("id").startswith(ABSTRACT_PREFIX)).select(*by, F.col("id").alias("start"), concept_of(F.col("id")).alias("concept"))
    plain = graph.nodes.where(concept_of(F.col("id")).isNull()).select(*by, F.col("id").alias("concept"), abstract_id(F.col("id")).alias("twin"))
    plain = plain.join(abstract.select(*by, F.col("start").alias("twin")), [*by, "twin"], "left_anti").select(*by, F.col("concept").alias("start"), "concept")
    reached = abstract.unionByName(plain).join(out, [*by, "start"]).select(*by, "concept", "start", "entry")
    alone = plain.join(out.select(*by, "start"), [*by, "start"], "left_anti").where(F.col("start").isNotNull()).select(*by, "concept", "start", F.col("start").alias("entry"))
    return reached.unionByName(alone)


def reachable_leaves(graph: Graph, rel: Relations = RELATIONS) -> DataFrame:
    """(by, concept, node): extension nodes below a concept's entries, themselves included. Taxonomy-sized."""
    by = list(graph.by)
    start = entries(graph, rel)
    down = closure(graph.relation(rel.superset_of), graph.by)
    full = reflexive(down, start.select(*by, F.col("entry").alias("id")), graph.by)
    return start.join(full.select(*by, F.col("src").alias("entry"), F.col("dst").alias("node")), [*by, "entry"]).select(*by, "concept", "node").distinct()


def thread_pairs(graph: Graph, rel: Relations = RELATIONS) -> DataFrame:
    """(by, concept, instance) of every thread. Memberships meet the reachability table once, on the holding node."""
    by = list(graph.by)
    held = graph.relation(rel.has_element).select(*by, F.col("src").alias("node"), F.col("dst").alias("instance")).distinct()
    return held.join(reachable_leaves(graph, rel), [*by, "node"]).select(*by, "concept", "instance").distinct()


def has_thread(graph: Graph, pairs: DataFrame, rel: Relations = RELATIONS) -> DataFrame:
    """The pairs (by, instance, concept) that have a thread."""
    key = [*graph.by, "instance", "concept"]
    return pairs.select(*key).join(by_shuffle(thread_pairs(graph, rel).select(*key)), key, "left_semi")


def thread_paths(graph: Graph, pairs: DataFrame, rel: Relations = RELATIONS) -> DataFrame:
    """pairs (by, instance, concept) with path: the shortest thread, the lexicographically smallest of those; else null."""
    by = list(graph.by)
    asked = pairs.select(*by, "instance", "concept").distinct()
    start = entries(graph, rel)
    # A thread's last step alone depends on the member: paths are chosen for each set of concepts and holding nodes.
    members, sets = fold(by, ("concepts",), concepts=asked.withColumnRenamed("concept", "item"), nodes=_held(graph, rel).where("instance is not null"))
    wanted = sets.select(*by, "set_id", F.explode("concepts").alias("concept"))
    steps = kept(wanted.join(start, [*by, "concept"]).join(sets.select(*by, "set_id", F.explode("nodes").alias("node")), [*by, "set_id"]), "steps")
    walks = shortest_paths(graph.relation(rel.superset_of), steps.select(*by, F.col("entry").alias("src"), F.col("node").alias("dst")).distinct(), graph.by)
    found = steps.join(walks.select(*by, F.col("src").alias("entry"), F.col("dst").alias("node"), "path"), [*by, "entry", "node"])
    head = F.when(F.col("start") == F.col("entry"), F.array().cast("array<string>")).otherwise(F.array("start"))
    whole = F.concat(head, "path")
    best = found.groupBy(*by, "set_id", "concept").agg(F.min(F.struct(F.size(whole).alias("n"), whole.alias("path")))["path"].alias("path"))
    chosen = wanted.join(best, [*by, "set_id", "concept"], "left").groupBy(*by, "set_id").agg(F.collect_list(F.struct("concept", "path")).alias("chosen"))
    bytes_ = F.aggregate("chosen", F.lit(0), lambda total, x: total + F.octet_length(x["concept"]) + 24 + F.coalesce(F.octet_length(F.array_join(x["path"], "")) + 16 * F.size(x["path"]), F.lit(0)))
    out = fanned_out(members, chosen, by, "chosen", bytes_).select(*by, "instance", "concept", F.concat("path", F.array("instance")).alias("path"))
    # Arrays of concepts hold no null.
    return out.unionByName(asked.where("concept is null").withColumn("path", F.lit(None).cast("array<string>")))


def validate(graph: Graph, expected: DataFrame | None = None, rel: Relations = RELATIONS) -> DataFrame:
    """(by, instance, concept, is_valid) for every expected pair.

    Validity is decided for each distinct set of holding nodes (and of expected concepts, where a table of pairs is
    given), then fanned out to the members: no table of pairs meets another.
    """
    by = list(graph.by)
    members, decided = decide(graph, expected, rel)
    return fanned_out(members, decided, by, "decided", bytes_of("decided"))


def decide(graph: Graph, expected: DataFrame | None = None, rel: Relations = RELATIONS) -> tuple[DataFrame, DataFrame]:
    """(members, sets): members has (by, instance, set_id), sets has (by, set_id, n, decided: structs of concept, is_valid)."""
    by = list(graph.by)
    reachable = reachable_leaves(graph, rel)
    if expected is None:
        members, sets = _folded_members(graph, rel)
        wanted = expected_of_sets(sets, closure(taxonomy(graph, rel), graph.by), by)
    else:
        pairs = expected.select(*by, "instance", F.col("concept").alias("item"))
        members, sets = fold(by, ("concepts",), concepts=pairs, nodes=_held(graph, rel))
        wanted = sets.select(*by, "set_id", F.explode("concepts").alias("concept"))
    # A member of several nodes is valid for a concept if one of its threads is.
    found = sets.select(*by, "set_id", F.explode("nodes").alias("node")).join(reachable, [*by, "node"]).select(*by, "set_id", "concept").distinct()
    flagged = wanted.join(found.withColumn("ok", F.lit(True)), [*by, "set_id", "concept"], "left")
    decided = flagged.groupBy(*by, "set_id").agg(F.collect_list(F.struct("concept", F.coalesce("ok", F.lit(False)).alias("is_valid"))).alias("decided"))
    return members, sets.select(*by, "set_id", "n").join(decided, [*by, "set_id"])


def concept_coverage(graph: Graph, expected: DataFrame | None = None, rel: Relations = RELATIONS, weights: DataFrame | None = None) -> DataFrame:
    """(by, concept, n_expected, n_valid): counted over sets of members, without a table of pairs. With weights (by, instance,
    n), an instance counts for n members."""
    members, sets = decide(graph, expected, rel)
    if weights is not None:
        total = members.join(weights, [*graph.by, "instance"]).groupBy(*graph.by, "set_id").agg(F.sum("n").alias("n"))
        sets = sets.drop("n").join(total, [*graph.by, "set_id"])
    rows = sets.select(*graph.by, "n", F.inline("decided"))
    return rows.groupBy(*graph.by, "concept").agg(F.sum("n").alias("n_expected"), F.sum(F.when(F.col("is_valid"), F.col("n")).otherwise(0)).alias("n_valid"))


def per_instance(graph: Graph, report: DataFrame) -> DataFrame:
    """(by, instance, n_valid): valid pairs of every instance node, 0 without one."""
    key = [*graph.by, "instance"]
    counts = report.groupBy(*key).agg(F.count_if("is_valid").alias("n_valid"))
    return instances(graph).join(by_shuffle(counts), key, "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))


def flat_direct(flat: Graph, concept: str, rel: Relations = RELATIONS) -> DataFrame:
    """Instances whose own class is the concept."""
    return flat.relation(rel.instance_of).where(F.col("dst") == concept).select(F.col("src").alias("instance")).distinct()


def flat_transitive(flat: Graph, concept: str, rel: Relations = RELATIONS) -> DataFrame:
    """Instances of the concept or of a class below it: a walk that starts at the concept."""
    down = flat.relation(rel.sub_class_of).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    below = reach(down, flat.nodes.sparkSession.createDataFrame([(concept,)], "id string"))
    members = flat.relation(rel.instance_of).select(F.col("src").alias("instance"), F.col("dst").alias("id"))
    return members.join(below, "id", "left_semi").select("instance").distinct()


def threaded_instances(graph: Graph, concept: str, rel: Relations = RELATIONS) -> DataFrame:
    """Instances that a thread leads to from the concept: a walk that starts at its entries."""
    start = entries(graph, rel).where(F.col("concept") == concept).select(F.col("entry").alias("id"))
    below = reach(graph.relation(rel.superset_of), start)
    return graph.relation(rel.has_element).join(below.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("instance")).distinct()


def threaded_concepts(graph: Graph, rel: Relations = RELATIONS) -> DataFrame:
    """(by, instance, concept): thread pairs over taxonomy nodes and direct concepts."""
    by = list(graph.by)
    tax = taxonomy(graph, rel)
    names = tax.select(*by, F.col("src").alias("concept")).unionByName(tax.select(*by, F.col("dst").alias("concept"))).unionByName(memberships(graph, rel).select(*by, "concept")).distinct()
    return thread_pairs(graph, rel).join(names, [*by, "concept"], "left_semi").select(*by, "instance", "concept")


def query_comparison(flat: Graph, dual: Graph, concept: str, rel: Relations = RELATIONS) -> DataFrame:
    """(instance, direct, transitive, threaded, missed_by_direct): which query finds an instance of the concept."""
    out = None
    for name, df in (("direct", flat_direct(flat, concept, rel)), ("transitive", flat_transitive(flat, concept, rel)), ("threaded", threaded_instances(dual, concept, rel))):
        flagged = df.withColumn(name, F.lit(True))
        out = flagged if out is None else out.join(flagged, "instance", "full_outer")
    out = out.select("instance", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("direct", "transitive", "threaded")))
    return out.withColumn("missed_by_direct", F.col("transitive") & ~F.col("direct"))
