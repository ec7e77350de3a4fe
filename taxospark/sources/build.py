"""Graphs from edge tables, and a generated layered graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import draw
from ..model import CONCEPT, INSTANCE, RELATIONS, Graph, Relations


def flat_graph(taxonomy: DataFrame, instances: DataFrame, rel: Relations = RELATIONS) -> Graph:
    """taxonomy (child, parent), instances (instance, concept). Nodes are made on first mention; an id that is used as
    both concept and instance is an instance. Repeated rows count once."""
    edges = taxonomy.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit(rel.sub_class_of).alias("relation")).unionByName(
        instances.select(F.col("instance").alias("src"), F.col("concept").alias("dst"), F.lit(rel.instance_of).alias("relation"))
    )
    named = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), (F.col("relation") == rel.instance_of).alias("member")), F.struct(F.col("dst").alias("id"), F.lit(False).alias("member")))).alias("n"))
    nodes = named.groupBy(F.col("n.id").alias("id")).agg(F.when(F.bool_or("n.member"), INSTANCE).otherwise(CONCEPT).alias("kind"))
    return Graph(nodes.select("id", "kind", F.col("id").alias("label"), F.lit(None).cast("string").alias("concept")), edges.distinct())


def layered_dag(spark: SparkSession, levels: int, branching: int, mi_rate: float, per_leaf: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """taxonomy and instances of a tree of `levels` layers with, at rate mi_rate, one more parent two or more layers up
    (a tree ancestor, so the closure is the tree's). Names: c{layer}_{offset + k}."""
    name = lambda level, k: F.concat(F.lit(f"c{level}_"), (k + sum(branching**i for i in range(level))).cast("string"))
    edges, leaves = [], None
    for level in range(1, levels):
        layer = spark.range(branching**level).withColumn("k", F.col("id"))
        edges.append(layer.select(name(level, F.col("k")).alias("child"), name(level - 1, F.floor(F.col("k") / branching)).alias("parent")))
        if level >= 2 and mi_rate > 0:
            unit = lambda *p: F.conv(F.substring(draw(seed, *p), 1, 8), 16, 10).cast("double") / float(1 << 32)
            lucky = layer.where(unit("extra", level, F.col("k")) < mi_rate)
            up = F.floor(unit("layer", level, F.col("k")) * (level - 1)).cast("int")  # 0 .. level - 2
            parent = F.coalesce(*(F.when(up == a, name(a, F.floor(F.col("k") / branching ** (level - a)))) for a in range(level - 1)))
            edges.append(lucky.select(name(level, F.col("k")).alias("child"), parent.alias("parent")))
    leaves = spark.range(branching ** (levels - 1)).select(name(levels - 1, F.col("id")).alias("concept"))
    taxonomy = edges[0]
    for e in edges[1:]:
        taxonomy = taxonomy.unionByName(e)
    members = leaves.select(F.explode(F.sequence(F.lit(1), F.lit(per_leaf))).alias("i"), "concept").select(F.concat("concept", F.lit("_i"), "i").alias("instance"), "concept")
    return taxonomy.distinct(), members
