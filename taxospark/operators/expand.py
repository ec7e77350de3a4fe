"""Rewriting a flat graph into abstract and extension nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import abstract_id, concept_of, extension_id
from ..model import ABSTRACT, CONCEPT, EXTENSION, RELATIONS, Graph, Relations


def select_concepts(flat: Graph, selected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(concepts to expand, selected names that are no concept), each by id. Without a selection, all concepts."""
    concepts = flat.nodes.where(F.col("kind") == CONCEPT).select("id")
    if selected is None:
        return concepts, concepts.limit(0)
    names = selected.select("id").distinct()
    return concepts.join(names, "id", "left_semi"), names.join(concepts, "id", "left_anti")


def expand(flat: Graph, selected: DataFrame | None = None, rel: Relations = RELATIONS) -> Graph:
    """Dual-node expansion of all concepts (a narrow rewrite) or of the selected ones (joins with the selection).

    Each expanded concept C becomes abstract:C and extension:C with hasExtension between. subClassOf gives supersetOf
    from the parent's to the child's extension side, and its mirror if both ends are expanded; instanceOf gives
    hasElement from the concept's extension side. Other relations are dropped.
    """
    by = list(flat.by)
    if selected is None:
        is_in = flat.nodes.withColumn("own", F.col("kind") == CONCEPT)
        ends = flat.edges.withColumn("src_in", F.lit(True)).withColumn("dst_in", F.lit(True))
    else:
        chosen = select_concepts(flat, selected)[0].distinct().withColumn("own", F.lit(True))
        is_in = flat.nodes.join(chosen, "id", "left").withColumn("own", F.coalesce("own", F.lit(False)))
        ends = flat.edges
        for side in ("src", "dst"):
            ends = ends.join(chosen.select(F.col("id").alias(side), F.col("own").alias(f"{side}_in")), side, "left").withColumn(f"{side}_in", F.coalesce(f"{side}_in", F.lit(False)))
    i = F.col("id")
    node = lambda id_, kind, label, concept: F.struct(id_.alias("id"), kind.alias("kind"), label.alias("label"), concept.alias("concept"))
    two = F.array(node(abstract_id(i), F.lit(ABSTRACT), F.col("label"), i), node(extension_id(i), F.lit(EXTENSION), F.col("label"), i))
    one = F.array(node(i, F.col("kind"), F.col("label"), F.col("concept")))
    nodes = is_in.select(*by, F.explode(F.when(F.col("own"), two).otherwise(one)).alias("n")).select(*by, "n.*")

    edge = lambda u, v, r, layer: F.struct(u.alias("src"), v.alias("dst"), F.lit(r).alias("relation"), F.lit(layer).alias("layer"))
    outer = lambda side, ext: F.when(F.col(f"{side}_in"), (extension_id if ext else abstract_id)(F.col(side))).otherwise(F.col(side))
    is_sub = F.col("relation") == rel.sub_class_of
    rows = F.array(
        F.when(is_sub, edge(outer("dst", True), outer("src", True), rel.superset_of, "extension")),
        F.when(is_sub & F.col("src_in") & F.col("dst_in"), edge(abstract_id(F.col("src")), abstract_id(F.col("dst")), rel.sub_class_of, "abstract")),
        F.when(F.col("relation") == rel.instance_of, edge(outer("dst", True), F.col("src"), rel.has_element, "extension")),
    )
    edges = ends.select(*by, F.explode(F.array_compact(rows)).alias("e")).select(*by, "e.*")
    own = is_in.where("own").select(*by, edge(abstract_id(i), extension_id(i), rel.has_extension, None).alias("e")).select(*by, "e.src", "e.dst", "e.relation", F.col("e.layer").cast("string").alias("layer"))
    return Graph(nodes, edges.unionByName(own), flat.by)


def dual_pairs(graph: Graph) -> DataFrame:
    """(concept, abstract, extension) of each expanded concept."""
    return graph.nodes.where(F.col("kind") == ABSTRACT).select(F.coalesce("concept", concept_of(F.col("id"))).alias("concept")).select("concept", abstract_id(F.col("concept")).alias("abstract"), extension_id(F.col("concept")).alias("extension"))


def typed_edges(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return edges.select(*by, "src", "dst", "relation").distinct()


def describe(graph: Graph) -> DataFrame:
    """(what, name, n): counts of node kinds and of relations; a missing one counts as '?'."""
    nodes = graph.nodes.groupBy(F.coalesce("kind", F.lit("?")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("what"), "name", "n")
    edges = graph.edges.groupBy(F.coalesce("relation", F.lit("?")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("relation").alias("what"), "name", "n")
    return nodes.unionByName(edges)
