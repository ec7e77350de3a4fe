"""Slices of a large class hierarchy: edge tables in, smaller edge tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.closure import break_cycles, component_of, levels
from ..storage import kept


def slice_by_depth(hypernyms: DataFrame, roots: DataFrame, max_depth: int, per_leaf: int) -> tuple[DataFrame, DataFrame]:
    """Taxonomy (child, parent) below roots (id) down to max_depth, and per_leaf made members under each leaf, which is
    a node without children or one that is reached at max_depth. A node that is reached at several depths may be both
    inner node and leaf."""
    level = kept(roots.select("id").distinct(), "level")
    edges, leaves = None, None
    parents = hypernyms.select(F.col("parent").alias("id")).distinct()
    for _ in range(max_depth):
        bare = level.join(parents, "id", "left_anti")
        leaves = bare if leaves is None else leaves.unionByName(bare)
        step = hypernyms.join(level.select(F.col("id").alias("parent")), "parent", "left_semi").select("child", "parent")
        edges = step if edges is None else edges.unionByName(step)
        level = kept(step.select(F.col("child").alias("id")).distinct(), "level")
    leaves = level if leaves is None else leaves.unionByName(level)
    taxonomy = edges.distinct() if edges is not None else hypernyms.limit(0).select("child", "parent")
    members = leaves.distinct().select(F.explode(F.sequence(F.lit(1), F.lit(per_leaf))).alias("i"), F.col("id").alias("concept"))
    return taxonomy, members.select(F.concat("concept", F.lit("_"), F.col("i").cast("string")).alias("instance"), "concept")


def slice_by_budget(hypernyms: DataFrame, root: str, max_depth: int, max_classes: int | None) -> DataFrame:
    """(child, parent) found walking down from root, until max_classes classes were taken up for expansion (None: all).
    Edges to children that were not taken up stay; parents within the slice are added."""
    spark = hypernyms.sparkSession
    taken = level = kept(spark.createDataFrame([(root,)], "id string"), "taken")
    edges, n = None, 1
    for _ in range(max_depth):
        step = hypernyms.join(level.select(F.col("id").alias("parent")), "parent", "left_semi").select("child", "parent").distinct()
        edges = step if edges is None else edges.unionByName(step)
        fresh = step.select(F.col("child").alias("id")).distinct().join(taken, "id", "left_anti")
        level = kept(fresh if max_classes is None else fresh.orderBy("id").limit(max(0, max_classes - n)), "level")
        got = level.count()
        if not got:
            break
        n += got
        taken = kept(taken.unionByName(level), "taken")
    if edges is None:
        return hypernyms.limit(0).select("child", "parent")
    found = kept(edges.distinct(), "edges")
    classes = found.select(F.explode(F.array("child", "parent")).alias("id")).distinct()
    induced = hypernyms.join(classes.withColumnRenamed("id", "child"), "child", "left_semi").join(classes.withColumnRenamed("id", "parent"), "parent", "left_semi").select("child", "parent")
    return found.unionByName(induced).distinct()


def leaf_classes(taxonomy: DataFrame) -> DataFrame:
    """Classes that are never a parent."""
    return taxonomy.select(F.col("child").alias("id")).distinct().join(taxonomy.select(F.col("parent").alias("id")), "id", "left_anti")


def members_per_class(instances: DataFrame, classes: DataFrame, per_class: int | None) -> DataFrame:
    """The first per_class members, by id, of each class (None: all)."""
    own = instances.select("instance", "concept").distinct().join(classes.select(F.col("id").alias("concept")), "concept", "left_semi")
    if per_class is None:
        return own.select("instance", "concept")
    ranked = own.withColumn("n", F.expr("row_number() over (partition by concept order by instance)"))
    return ranked.where(F.col("n") <= per_class).select("instance", "concept")


def with_labels(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """ids with label, the id itself where there is none."""
    return ids.join(labels.groupBy("id").agg(F.min("label").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))


def clean_slice(hypernyms: DataFrame, instances: DataFrame, root: str, max_depth: int, max_classes: int | None, per_class: int | None) -> tuple[DataFrame, DataFrame]:
    """A slice without cycles, only the root's component, members of its leaf classes that are no classes themselves."""
    raw = slice_by_budget(hypernyms, root, max_depth, max_classes)
    acyclic = kept(break_cycles(raw.select(F.col("child").alias("src"), F.col("parent").alias("dst")), root), "acyclic")
    inside = component_of(acyclic, root)
    taxonomy = kept(acyclic.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("child"), F.col("dst").alias("parent")), "taxonomy")
    classes = taxonomy.select(F.explode(F.array("child", "parent")).alias("id")).distinct()
    members = members_per_class(instances, leaf_classes(taxonomy), per_class)
    return taxonomy, members.join(classes.withColumnRenamed("id", "instance"), "instance", "left_anti")


def depths(taxonomy: DataFrame, root: str, max_depth: int | None = None) -> DataFrame:
    """(id, depth) below root."""
    return levels(taxonomy.select(F.col("parent").alias("src"), F.col("child").alias("dst")), root, max_depth)
