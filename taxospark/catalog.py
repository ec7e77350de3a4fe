"""Taxonomies with members from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Graph
from .operators.folding import set_id
from .sources.build import flat_graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def geo_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> region -> geo."""
    nation = table(spark, sf_dir, "nation").select(_id("nation:", "n_nationkey").alias("child"), _id("region:", "n_regionkey").alias("parent"))
    return nation.unionByName(table(spark, sf_dir, "region").select(_id("region:", "r_regionkey").alias("child"), F.lit("geo").alias("parent")))


def product_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type and brand of a part -> its type, its brand -> product: a graph with diamonds."""
    part = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    leaf = F.concat(F.lit("pc:"), "p_type", F.lit("|"), "p_brand")
    kind, brand = F.concat(F.lit("type:"), "p_type"), F.concat(F.lit("brand:"), "p_brand")
    rows = [part.select(leaf.alias("child"), kind.alias("parent")), part.select(leaf.alias("child"), brand.alias("parent")), part.select(kind.alias("child"), F.lit("product").alias("parent")), part.select(brand.alias("child"), F.lit("product").alias("parent"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.distinct()


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers and suppliers as members of their nation."""
    c = table(spark, sf_dir, "customer").select(_id("customer:", "c_custkey").alias("instance"), _id("nation:", "c_nationkey").alias("concept"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(_id("supplier:", "s_suppkey").alias("instance"), _id("nation:", "s_nationkey").alias("concept")))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(_id("part:", "p_partkey").alias("instance"), F.concat(F.lit("pc:"), "p_type", F.lit("|"), "p_brand").alias("concept"))


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line items as members of their part's leaf and of their supplier's nation."""
    items = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("line:"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("instance"), "l_partkey", "l_suppkey")
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("pc:"), "p_type", F.lit("|"), "p_brand").alias("concept"))
    where = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), _id("nation:", "s_nationkey").alias("concept"))
    return items.join(own, "l_partkey").select("instance", "concept").unionByName(items.join(where, "l_suppkey").select("instance", "concept")).distinct()


def folded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance, set_id, concepts): every line item with the sorted classes that line_items gives it.

    A line's two classes stay in one row, found by its keys; lines are shuffled once by part and once by their own key,
    which are numbers, and their ids are made last. The ids of all lines with a null in their key are null, as in line_items.
    """
    items = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber").isNotNull(), F.col("l_orderkey")).alias("o"), F.when(F.col("l_orderkey").isNotNull(), F.col("l_linenumber")).alias("l"), "l_partkey", "l_suppkey")
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("pc:"), "p_type", F.lit("|"), "p_brand").alias("leaf"))
    where = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), _id("nation:", "s_nationkey").alias("nation"))
    # Parts grow with the lines: a planner that goes by the size of their file would send millions of them to the driver.
    classed = items.join(own.hint("shuffle_hash"), "l_partkey", "left").join(where, "l_suppkey", "left")
    sets = classed.groupBy("o", "l").agg(F.array_sort(F.array_union(F.collect_set("leaf"), F.collect_set("nation"))).alias("concepts")).where(F.size("concepts") > 0)
    return sets.select(F.concat(F.lit("line:"), F.col("o").cast("string"), F.lit("-"), F.col("l").cast("string")).alias("instance"), set_id("concepts").alias("set_id"), "concepts")


def geo_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return flat_graph(geo_taxonomy(spark, sf_dir), customers(spark, sf_dir))


def product_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return flat_graph(product_taxonomy(spark, sf_dir), parts(spark, sf_dir))


def trade_graph(spark: SparkSession, sf_dir: str, members: DataFrame | None = None) -> Graph:
    """Both taxonomies with the line items, or other members (instance, concept), as members of several classes."""
    members = line_items(spark, sf_dir) if members is None else members
    return flat_graph(geo_taxonomy(spark, sf_dir).unionByName(product_taxonomy(spark, sf_dir)), members)


def trade_sets(sets: DataFrame) -> DataFrame:
    """(instance, concept) of one stand-in, named by its id, for each set of line items (set_id, concepts)."""
    return sets.select(F.col("set_id").alias("instance"), F.explode("concepts").alias("concept"))


#: The host of a URL: behind any scheme and user, up to a port, path, query or fragment.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_taxonomy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """host -> parent domain -> ... -> top level from page URLs, and pages as members of their host."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", HOST, 1)).alias("host")).where("host <> ''")
    parts_ = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts_)), lambda i: F.array_join(F.slice(parts_, i, F.size(parts_)), "."))
    chain = pages.select("host").distinct().select(tails.alias("t"))
    pairs = chain.where(F.size("t") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.struct(F.element_at("t", i).alias("child"), F.element_at("t", i + 1).alias("parent")))).alias("p"))
    return pairs.select("p.child", "p.parent").distinct(), pages.select(_id("page:", "page_id").alias("instance"), F.col("host").alias("concept"))
