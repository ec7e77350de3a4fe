"""Graphs and result grids in files: Parquet (native), node-link JSON and GraphML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph

_DATA = "data ARRAY<STRUCT<_VALUE: STRING, _key: STRING>>"


#: Nodes or edges that one written document of node-link JSON or GraphML holds.
DOCUMENT_ROWS = 10_000
_ATTRIBUTES = {"node": ("kind", "label", "concept"), "edge": ("relation", "layer")}


def save_graph(graph: Graph, path: str, fmt: str = "parquet") -> None:
    """parquet, json (one object a line): two folders below path. node_link, graphml: a folder of whole documents of
    bounded size, which load_graph() reads together."""
    if fmt in ("parquet", "json"):
        for name, df in (("nodes", graph.nodes), ("edges", graph.edges)):
            df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")
        return
    made = {"node_link": _node_link, "graphml": _graphml}.get(fmt)
    if made is None:
        raise ValueError(f"unknown graph format {fmt!r}")
    edges = graph.edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), *(c for c in ("relation", "layer", "repaired", "distractor") if c in graph.edges.columns))
    nodes = graph.nodes.select(*(c for c in ("id", "kind", "label", "concept") if c in graph.nodes.columns))
    docs = made(nodes, "node").unionByName(made(edges, "edge"))
    docs.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def _in_documents(rows: DataFrame) -> DataFrame:
    """One array of rows `r` for each document."""
    numbered = rows.withColumn("_doc", F.floor(F.monotonically_increasing_id() / DOCUMENT_ROWS))
    return numbered.groupBy("_doc").agg(F.collect_list("r").alias("rows"))


def _node_link(df: DataFrame, tag: str) -> DataFrame:
    filled = _in_documents(df.select(F.struct(*df.columns).alias("r")))
    return filled.select(F.to_json(F.struct(F.lit(True).alias("directed"), F.col("rows").alias(f"{tag}s"))).alias("value"))


def _graphml(df: DataFrame, tag: str) -> DataFrame:
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    datum = lambda c: F.coalesce(F.concat(F.lit(f'<data key="{c}">'), escaped(c), F.lit("</data>")), F.lit(""))
    own = [c for c in df.columns if c in ("id", "source", "target")]
    heads = [part for c in own for part in (F.lit(f' {c}="'), escaped(c), F.lit('"'))]
    row = F.concat(F.lit(f"<{tag}"), *heads, F.lit(">"), *(datum(c) for c in _ATTRIBUTES[tag] if c in df.columns), F.lit(f"</{tag}>"))
    keys = "".join(f'<key id="{c}" for="{kind}" attr.name="{c}" attr.type="string"/>' for kind, names in _ATTRIBUTES.items() for c in names)
    opening = F.lit(f'<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">')
    return _in_documents(df.select(row.alias("r"))).select(F.concat(opening, F.array_join("rows", ""), F.lit("</graph></graphml>")).alias("value"))


def load_graph(spark: SparkSession, path: str, fmt: str = "parquet") -> Graph:
    """parquet, json as save_graph() writes them; node_link: JSON documents of nodes and edges (or links); graphml."""
    if fmt in ("parquet", "json"):
        return Graph(*(spark.read.format(fmt).load(f"{path}/{name}") for name in ("nodes", "edges")))
    if fmt == "node_link":
        node = "ARRAY<STRUCT<id: STRING, kind: STRING, label: STRING, concept: STRING>>"
        edge = "ARRAY<STRUCT<source: STRING, target: STRING, relation: STRING, layer: STRING, repaired: BOOLEAN, distractor: BOOLEAN>>"
        doc = spark.read.schema(f"nodes {node}, edges {edge}, links {edge}").json(path, multiLine=True)
        edges = doc.select(F.explode(F.coalesce("edges", "links")).alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.relation", "e.layer", "e.repaired", "e.distractor")
        return Graph(doc.select(F.explode("nodes").alias("n")).select("n.*"), edges)
    if fmt == "graphml":
        keys = spark.read.format("xml").option("rowTag", "key").schema("_id STRING, `_attr.name` STRING").load(path)
        names = {r[0]: r[1] for r in keys.collect()}  # the file's attribute names

        def rows(tag: str, own: str) -> DataFrame:
            return spark.read.format("xml").option("rowTag", tag).schema(f"{own}, {_DATA}").load(path)

        nodes = rows("node", "_id STRING").select(F.col("_id").alias("id"), *(F.try_element_at(F.transform(F.filter("data", _keyed(names, n)), lambda d: d["_VALUE"]), F.lit(1)).alias(n) for n in ("kind", "label", "concept")))
        edges = rows("edge", "_source STRING, _target STRING").select(F.col("_source").alias("src"), F.col("_target").alias("dst"), *(F.try_element_at(F.transform(F.filter("data", _keyed(names, n)), lambda d: d["_VALUE"]), F.lit(1)).alias(n) for n in ("relation", "layer")))
        return Graph(nodes, edges)
    raise ValueError(f"unknown graph format {fmt!r}")


def _keyed(names: dict, name: str):
    key = next((k for k, v in names.items() if v == name), name)
    return lambda d: d["_key"] == key


def save_grid(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = "dataset") -> None:
    """A result grid as parquet or CSV with a header, partitioned by a column where it has that."""
    writer = df.write.mode("overwrite")
    if by in df.columns:
        writer = writer.partitionBy(by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown grid format {fmt!r}")


def load_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
