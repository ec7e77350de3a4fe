"""Quality of a graph and of a repair. Undefined ratios are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import name_of
from ..model import RELATIONS, Graph, Relations
from ..plans.closure import closure
from ..storage import by_shuffle, kept
from .threads import per_instance, threaded_concepts, validate

KEY = ("src", "dst", "relation")


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(empty).cast("double"))


def coverage_metrics(graph: Graph, report: DataFrame) -> DataFrame:
    """(by, n_expected, n_valid, n_broken, n_instances, coverage, avg_valid): coverage of nothing is 1."""
    by = list(graph.by)
    key = by or [F.lit(0).alias("_one")]
    pairs = report.groupBy(*key).agg(F.count("*").alias("n_expected"), F.count_if("is_valid").alias("n_valid"))
    each = per_instance(graph, report).groupBy(*key).agg(F.count("*").alias("n_instances"), F.avg("n_valid").alias("avg_valid"))
    both = pairs.join(each, by or ["_one"], "full_outer")
    both = both.na.fill(0, ["n_expected", "n_valid", "n_instances"]).na.fill(0.0, ["avg_valid"])
    return both.select(*by, "n_expected", "n_valid", (F.col("n_expected") - F.col("n_valid")).alias("n_broken"), "n_instances", ratio(F.col("n_valid"), F.col("n_expected"), 1.0).alias("coverage"), "avg_valid")


def rounded(metrics: DataFrame, places: int = 4) -> DataFrame:
    return metrics.select(*(F.bround(c, places).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes))


def enforcement_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of coverage and broken counts before and after, and their differences."""
    side = lambda m, s: m.select(*(F.col(c).alias(f"{c}_{s}") for c in ("coverage", "n_broken", "n_valid")))
    both = side(before, "before").withColumn("_one", F.lit(0)).join(side(after, "after").withColumn("_one", F.lit(0)), "_one").drop("_one")
    return both.withColumn("coverage_gain", F.col("coverage_after") - F.col("coverage_before")).withColumn("repaired_pairs", F.col("n_valid_after") - F.col("n_valid_before"))


def newly_valid(before: DataFrame, after: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs that are valid only afterwards, with a label instance~concept."""
    key = [*by, "instance", "concept"]
    new = after.where("is_valid").select(*key).join(by_shuffle(before.where("is_valid").select(*key)), key, "left_anti")
    return new.withColumn("label", F.concat_ws("~", "instance", "concept"))


class Oracle:
    """A frozen truth: expected pairs, typed edges and nodes of a complete graph, and its taxonomy closure."""

    def __init__(self, expected: DataFrame, edges: DataFrame, nodes: DataFrame, ancestors: DataFrame) -> None:
        self.expected, self.edges, self.nodes, self.ancestors = expected, edges, nodes, ancestors

    def expected_for(self, instance: str) -> DataFrame:
        return self.expected.where(F.col("instance") == instance).select("concept")


def freeze_oracle(graph: Graph, rel: Relations = RELATIONS) -> Oracle:
    """Persist the truth; a graph with a broken pair raises AssertionError."""
    by = list(graph.by)
    report = kept(validate(graph, None, rel), "expected")
    if not report.where("not is_valid").isEmpty():
        raise AssertionError("the graph to freeze has broken threads")
    named = lambda r, a, b: graph.relation(r).select(*by, name_of(F.col(a)).alias("src"), name_of(F.col(b)).alias("dst"))
    both = named(rel.sub_class_of, "src", "dst").unionByName(named(rel.superset_of, "dst", "src")).distinct()
    return Oracle(report.select(*by, "instance", "concept"), kept(graph.edges.select(*by, *KEY).distinct(), "edges"), kept(graph.nodes.select(*by, "id").distinct(), "nodes"), closure(both, graph.by))


def _hits(edges: DataFrame, truth: DataFrame, by: tuple[str, ...]) -> DataFrame:
    key = [*by, *KEY]
    return edges.select(*key).distinct().join(by_shuffle(truth.select(*key).distinct().withColumn("hit", F.lit(True))), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def edge_quality(added: DataFrame, pristine: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n_added, n_true, edge_precision, hallucination); null without an added edge."""
    counts = _hits(added, pristine, by).groupBy(*by).agg(F.count("*").alias("n_added"), F.count_if("hit").alias("n_true"))
    p = ratio(F.col("n_true"), F.col("n_added"))
    return counts.select(*by, "n_added", "n_true", p.alias("edge_precision"), (1 - p).alias("hallucination"))


def semantically_correct(added: DataFrame, oracle: Oracle, by: tuple[str, ...] = (), rel: Relations = RELATIONS) -> DataFrame:
    """added with is_true: supersetOf if the parent is an ancestor of the child or itself, hasElement if the pair is
    expected, hasExtension if both ends are of one concept; else false."""
    by = list(by)
    edges = added.select(*by, *KEY).distinct().withColumn("_u", name_of(F.col("src"))).withColumn("_v", name_of(F.col("dst")))
    above = oracle.ancestors.select(*by, F.col("src").alias("_v"), F.col("dst").alias("_u")).withColumn("_above", F.lit(True))
    member = oracle.expected.select(*by, F.col("instance").alias("dst"), F.col("concept").alias("_u")).withColumn("_member", F.lit(True))
    joined = edges.join(above, [*by, "_u", "_v"], "left").join(by_shuffle(member), [*by, "dst", "_u"], "left")
    truth = (
        F.when(F.col("relation") == rel.superset_of, (F.col("_u") == F.col("_v")) | F.coalesce("_above", F.lit(False)))
        .when(F.col("relation") == rel.has_element, F.coalesce("_member", F.lit(False)))
        .when(F.col("relation") == rel.has_extension, F.col("_u") == F.col("_v"))
        .otherwise(F.lit(False))
    )
    return joined.select(*by, *KEY, truth.alias("is_true"))


def closure_quality(added: DataFrame, oracle: Oracle, by: tuple[str, ...] = (), rel: Relations = RELATIONS) -> DataFrame:
    counts = semantically_correct(added, oracle, by, rel).groupBy(*by).agg(F.count("*").alias("n_added"), F.count_if("is_true").alias("n_true"))
    p = ratio(F.col("n_true"), F.col("n_added"))
    return counts.select(*by, "n_added", "n_true", p.alias("closure_precision"), (1 - p).alias("closure_hallucination"))


def recoverable(removed: DataFrame, oracle: Oracle, nodes: DataFrame, by: tuple[str, ...] = (), rel: Relations = RELATIONS) -> DataFrame:
    """Removed edges that a repair could bring back: pristine, of a repairable relation, both ends still there."""
    by = list(by)
    key = [*by, *KEY]
    out = removed.select(*key).distinct().where(F.col("relation").isin(rel.has_extension, rel.superset_of, rel.has_element)).join(by_shuffle(oracle.edges.select(*key)), key, "left_semi")
    for end in ("src", "dst"):
        out = out.join(by_shuffle(nodes.select(*by, F.col("id").alias(end))), [*by, end], "left_semi")
    return out


def edge_recall(added: DataFrame, can: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    counts = _hits(can, added, by).groupBy(*by).agg(F.count("*").alias("n_recoverable"), F.count_if("hit").alias("n_recovered"))
    return counts.withColumn("edge_recall", ratio(F.col("n_recovered"), F.col("n_recoverable")))


def recovery_fraction(before: Column, after: Column) -> Column:
    return F.when(before < 1.0, (after - before) / (1.0 - before))


def false_memberships(graph: Graph, expected: DataFrame, rel: Relations = RELATIONS) -> DataFrame:
    """(by, instance, concept) with a thread but not expected, for instances that have an expected pair."""
    by = list(graph.by)
    key = [*by, "instance", "concept"]
    known = expected.select(*by, "instance").distinct()
    return threaded_concepts(graph, rel).join(by_shuffle(known), [*by, "instance"], "left_semi").join(by_shuffle(expected.select(*key)), key, "left_anti")


def redundancy(pairs: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """(n_pairs, n_redundant, redundancy): share of (descendant, ancestor) pairs that start with more than one hop."""
    edges = pairs.select("src", "dst").distinct()
    closed = closure(edges) if closed is None else closed
    hop = edges.select("src", F.col("dst").alias("nb"))
    direct = edges.select("src", "dst", F.col("dst").alias("nb"))
    far = hop.join(closed.select(F.col("src").alias("nb"), "dst"), "nb").where("src <> dst").select("src", "dst", "nb")
    routes = direct.where("src <> dst").unionByName(far).distinct().groupBy("src", "dst").agg(F.count("*").alias("n"))
    counts = routes.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("n") > 1).alias("n_redundant"))
    return counts.withColumn("redundancy", ratio(F.col("n_redundant"), F.col("n_pairs"), 0.0))


def multi_parent(pairs: DataFrame) -> DataFrame:
    """(id, n_parents) of concepts with several parents."""
    return pairs.select("src", "dst").distinct().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_parents")).where("n_parents > 1")


