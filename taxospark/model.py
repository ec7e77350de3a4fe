"""The data model: a graph is a table of nodes and a table of typed edges.

All operators take an optional tuple `by` of key columns (a trial, a dataset). They are carried through every join
and grouping, so that many graphs are worked on in one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Node kinds.
CONCEPT, INSTANCE, ABSTRACT, EXTENSION = "concept", "instance", "abstract", "extension"

NODES = "id string, kind string, label string, concept string"
EDGES = "src string, dst string, relation string, layer string, repaired boolean, distractor boolean"


@dataclass(frozen=True)
class Relations:
    sub_class_of: str = "subClassOf"
    instance_of: str = "instanceOf"
    has_extension: str = "hasExtension"
    superset_of: str = "supersetOf"
    has_element: str = "hasElement"


RELATIONS = Relations()


@dataclass(frozen=True)
class Graph:
    """nodes: id, kind, label, concept. edges: src, dst, relation and optional layer, repaired, distractor."""

    nodes: DataFrame
    edges: DataFrame
    by: tuple[str, ...] = ()

    def relation(self, name: str) -> DataFrame:
        return self.edges.where(self.edges["relation"] == name)
