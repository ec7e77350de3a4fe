"""Grids of damage and repair trials as single jobs: every table carries the trial's number.

One graph is shared by all trials. Its members are folded once into sets with equal holding nodes (see folding); a trial
holds the edges that it removes, the taxonomy without them, and stand-ins for those sets of members that its removals
can change: sets below a removed edge, and sets some of whose members lost an edge of their own. A stand-in carries the
number of members that it stands for. What no removal reaches is counted once for all trials.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import name_of
from ..model import INSTANCE, RELATIONS, Graph, Relations
from ..plans.closure import closure, reflexive, widest
from ..storage import by_shuffle, kept
from . import damage
from .damage import KEY, flat_preimage, sample_k
from .folding import fold
from .metrics import Oracle, freeze_oracle, ratio, recoverable, semantically_correct
from .repair import apply, corroboration_scorer, gate, prior_scorer, proposals
from .stats import mean_ci
from .threads import entries, expected_from_flat, validate

BY = ("trial",)
#: Thresholds of the precision-recall study: steps of 0.05, and one that nothing reaches.
THETAS = (*(round(0.05 * i, 2) for i in range(21)), 1.01)


def _crossed(df: DataFrame, trials: DataFrame, *columns: str) -> DataFrame:
    """df once for each row of a factor table, which the caller made from lists of values: a narrow expansion."""
    rows = trials.select("trial", *columns).collect()
    kinds = dict(trials.dtypes)
    each = F.array(*(F.struct(*(F.lit(r[c]).cast(kinds[c]).alias(c) for c in ("trial", *columns))) for r in rows)) if rows else F.array().cast(f"array<struct<{', '.join(f'{c}:{kinds[c]}' for c in ('trial', *columns))}>>")
    return df.select("*", F.explode(each).alias("_t")).select(*df.columns, *(F.col("_t")[c].alias(c) for c in ("trial", *columns)))


def factor_table(spark, **factors) -> DataFrame:
    """All combinations of the factors' values, numbered."""
    rows = [()]
    for values in factors.values():
        rows = [(*r, v) for r in rows for v in values]
    kinds = {k: "string" if isinstance(v[0], str) else "double" if isinstance(v[0], float) else "int" for k, v in factors.items()}
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ", ".join(["trial int", *(f"{k} {t}" for k, t in kinds.items())]))


def removed_edges(graph: Graph, trials: DataFrame, rel: Relations = RELATIONS) -> tuple[DataFrame, DataFrame]:
    """(removed edges by trial, removed nodes by trial) for factors arm, rho, seed. Only what is removed is written."""
    arms = {**{a: [getattr(rel, n)] for a, n in damage.ARMS.items()}, "E-MIX": [rel.has_extension, rel.superset_of, rel.has_element]}
    typed = graph.edges.select(*KEY).distinct()
    wanted = F.lit(False)
    for arm, names in arms.items():
        wanted = wanted | ((F.col("arm") == arm) & F.col("relation").isin(*names))
    own = _crossed(typed, trials, "arm", "rho", "seed").where(wanted)
    removed = sample_k(own, F.col("rho"), [F.col("seed").cast("string")], list(KEY), ("trial", "relation"), few=True).select("trial", *KEY)
    node_trials = trials.where("arm = 'N-REM'")
    gone = sample_k(_crossed(graph.nodes.where("kind = 'extension'").select("id").distinct(), node_trials, "rho", "seed"), F.col("rho"), [F.col("seed").cast("string")], ["id"], BY, few=True)
    gone = kept(gone.select("trial", "id"), "gone")
    for end in ("src", "dst"):
        removed = removed.unionByName(typed.join(gone.select("trial", F.col("id").alias(end)), end).select("trial", *KEY))
    return kept(removed.distinct(), "removed"), gone


@dataclass(frozen=True)
class Base:
    """What all trials share: dual and flat without members; members (instance, set_id); sets (set_id, n, nodes, classes,
    kind); whole, the dual graph with one stand-in for each set."""

    dual: Graph
    flat: Graph
    members: DataFrame
    sets: DataFrame
    whole: Graph


def stand_in(set_id: str) -> Column:
    return F.concat(F.lit("members:"), set_id)


def _with_members(taxonomy: Graph, sets: DataFrame, ids: Column, array: str, rel: Relations) -> Graph:
    """The graph with a stand-in for each row of sets, held by the nodes of its array."""
    by = list(taxonomy.by)
    nodes = sets.select(*by, ids.alias("id"), F.when(F.size("kind") > 0, F.lit(INSTANCE)).alias("kind"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("concept"))
    held = sets.select(*by, ids.alias("id"), F.explode(array).alias("node"))
    ends = (F.col("node"), F.col("id"), F.lit(rel.has_element)) if array == "nodes" else (F.col("id"), F.col("node"), F.lit(rel.instance_of))
    return Graph(taxonomy.nodes.unionByName(nodes), taxonomy.edges.unionByName(held.select(*by, *(c.alias(k) for c, k in zip(ends, KEY)))), taxonomy.by)


def fold_graphs(dual: Graph, flat: Graph | None = None, rel: Relations = RELATIONS) -> Base:
    flat = Graph(dual.nodes.limit(0), dual.edges.limit(0)) if flat is None else flat
    held = dual.relation(rel.has_element).select(F.col("dst").alias("instance"), F.col("src").alias("item"))
    classes = flat.relation(rel.instance_of).select(F.col("src").alias("instance"), F.col("dst").alias("item"))
    kind = dual.nodes.where(F.col("kind") == INSTANCE).select(F.col("id").alias("instance"), F.lit(INSTANCE).alias("item"))
    members, sets = fold((), nodes=held, classes=classes, kind=kind)
    sets = kept(sets.where((F.size("nodes") > 0) | (F.size("classes") > 0)), "sets")
    columns = ("id", "kind", "label", "concept")
    own = lambda g, r: Graph(kept(g.nodes.where("kind is null or kind <> 'instance'").select(*columns), "nodes"), kept(g.edges.where(F.col("relation") != r).select(*KEY).distinct(), "edges"))
    base_dual, base_flat = own(dual, rel.has_element), own(flat, rel.instance_of)
    whole = _with_members(base_dual, sets, stand_in("set_id"), "nodes", rel)
    return Base(base_dual, base_flat, members, sets, Graph(kept(whole.nodes, "nodes"), kept(whole.edges, "edges")))


def _below(starts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(trial, node): the starts (trial, node) and all that is below them over pairs (src above dst)."""
    down = closure(pairs).select(F.col("src").alias("node"), F.col("dst").alias("low"))
    starts = kept(starts.distinct(), "starts")
    return starts.unionByName(starts.join(down, "node").select("trial", F.col("low").alias("node"))).distinct()


def _touched(base: Base, removed: DataFrame, rel: Relations) -> DataFrame:
    """(trial, set_id): sets of members below a removed edge of the taxonomy, in the dual or the flat graph."""
    up = removed.where(F.col("relation") == rel.sub_class_of)
    down = removed.where(F.col("relation").isin(rel.superset_of, rel.has_extension)).select("trial", F.col("dst").alias("node"))
    # Taxonomies are read by names: a node stands for its concept and for both of its sides.
    named = base.dual.relation(rel.superset_of).select(name_of(F.col("src")).alias("src"), name_of(F.col("dst")).alias("dst"))
    for graph in (base.dual, base.flat):
        named = named.unionByName(graph.relation(rel.sub_class_of).select(name_of(F.col("dst")).alias("src"), name_of(F.col("src")).alias("dst")))
    starts = down.unionByName(up.select("trial", F.col("src").alias("node"))).select("trial", name_of(F.col("node")).alias("node"))
    low = _below(starts, named.distinct())
    held = base.sets.select("set_id", F.explode(F.concat("nodes", "classes")).alias("node")).select("set_id", name_of(F.col("node")).alias("node")).distinct()
    return held.join(low, "node").select("trial", "set_id").distinct()


def _stand_ins(base: Base, removed: DataFrame, rel: Relations) -> DataFrame:
    """(trial, member, set_id, n, kind, nodes, classes, had): for each trial the members that its removals can change, by what
    they had before (set_id; had: its nodes) and what is left of it."""
    own = removed.where(F.col("relation") == rel.has_element)
    lost = fold(
        BY,
        lost_nodes=own.select("trial", F.col("dst").alias("instance"), F.col("src").alias("item")),
        lost_classes=flat_preimage(own, rel, BY).select("trial", F.col("src").alias("instance"), F.col("dst").alias("item")),
    )
    lots = lost[0].withColumnRenamed("set_id", "lost_id").join(by_shuffle(base.members), "instance")
    changed = lots.groupBy("trial", "set_id", "lost_id").agg(F.count("*").alias("n"))
    changed = kept(changed.join(lost[1].drop("n").withColumnRenamed("set_id", "lost_id"), ["trial", "lost_id"]), "changed")
    rest = _touched(base, removed, rel).join(changed.groupBy("trial", "set_id").agg(F.sum("n").alias("gone")), ["trial", "set_id"], "left")
    rest = rest.join(base.sets, "set_id").withColumn("n", F.col("n") - F.coalesce("gone", F.lit(0))).where("n > 0")
    rest = rest.select("trial", stand_in("set_id").alias("member"), "set_id", "n", "kind", "nodes", "classes", F.col("nodes").alias("had"))
    some = changed.join(base.sets.drop("n"), "set_id").select("trial", F.concat(stand_in("set_id"), F.lit("-"), "lost_id").alias("member"), "set_id", "n", "kind", F.array_except("nodes", "lost_nodes").alias("nodes"), F.array_except("classes", "lost_classes").alias("classes"), F.col("nodes").alias("had"))
    return kept(rest.unionByName(some), "stand-ins")


def _trial_graph(shared: Graph, trials: DataFrame, gone: DataFrame, put: DataFrame | None = None, gone_nodes: DataFrame | None = None) -> Graph:
    """The shared taxonomy once for each trial, without what is gone in it and with what is put."""
    edges = _crossed(shared.edges.select(*KEY), trials).join(gone.select("trial", *KEY), ["trial", *KEY], "left_anti")
    nodes = _crossed(shared.nodes, trials)
    if put is not None:
        edges = edges.unionByName(put.select(*edges.columns)).distinct()
    if gone_nodes is not None:
        nodes = nodes.join(gone_nodes, ["trial", "id"], "left_anti")
    return Graph(kept(nodes, "nodes"), kept(edges, "edges"), BY)


def run_grid(flat: Graph, dual: Graph, trials: DataFrame, rel: Relations = RELATIONS) -> DataFrame:
    """Per trial of (dataset, arm, rho, seed): coverage damaged, repaired with the frozen truth and single-node, edge
    precision of the repair, pairs that the single-node graph misses or invents."""
    base = fold_graphs(dual, flat, rel)
    oracle = freeze_oracle(base.whole, rel)
    removed, gone_nodes = removed_edges(dual, trials, rel)
    some = _stand_ins(base, removed, rel)
    weight = kept(some.select("trial", F.col("member").alias("instance"), "n", "set_id"), "weights")
    pair = ["trial", "instance", "concept"]

    # Expected pairs of a set are those of its stand-in in the whole graph.
    wanted = kept(oracle.expected.select(F.substring("instance", len("members:") + 1, 64).alias("set_id"), "concept"), "wanted")
    expected = kept(weight.select("trial", "instance", "set_id").join(wanted, "set_id").select(*pair), "expected")
    total = base.sets.join(wanted, "set_id").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    gone = removed.where(F.col("relation") != rel.has_element)
    graphs = _with_members(_trial_graph(base.dual, trials, gone, gone_nodes=gone_nodes), some, F.col("member"), "nodes", rel)
    graphs = Graph(kept(graphs.nodes, "nodes"), kept(graphs.edges, "edges"), BY)
    before = kept(validate(graphs, expected, rel), "before")
    gated = kept(gate(prior_scorer(proposals(graphs, before, rel), graphs), by=BY, min_confidence=0.0, max_new_edges=None), "gated")
    after = validate(apply(graphs, gated), expected, rel)

    weighed = lambda df: df.join(weight.select("trial", "instance", "n"), ["trial", "instance"])
    broken = lambda report, name: weighed(report.where("not is_valid")).groupBy("trial").agg(F.sum("n").alias(name))
    # An added edge is true if the whole graph has it; one to a stand-in, if its members had that node.
    edges = gated.where("applied").select("trial", *KEY)
    true = edges.join(oracle.edges.select(*KEY).withColumn("hit", F.lit(True)), list(KEY), "left")
    to = some.select("trial", F.col("member").alias("dst"), "n", "had")
    true = true.join(to, ["trial", "dst"], "left").select("trial", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("hit", F.array_contains("had", F.col("src")), F.lit(False)).alias("hit"))
    precision = true.groupBy("trial").agg(ratio(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)), F.sum("n")).alias("edge_precision"))

    def singles(flats: Graph, expected: DataFrame, by: list[str]) -> DataFrame:
        """(by, instance, both, missed, invented): numbers of pairs that the flat graph has or lacks."""
        key = [*by, "instance", "concept"]
        found = kept(expected_from_flat(flats, rel).withColumn("found", F.lit(True)), "single")
        joined = expected.withColumn("asked", F.lit(True)).join(found, key, "full_outer").groupBy(*by, "instance")
        return joined.agg(F.count_if(F.col("found") & F.col("asked")).alias("both"), F.count_if(F.col("asked") & F.col("found").isNull()).alias("missed"), F.count_if(F.col("asked").isNull()).alias("invented"))

    all_flat = _with_members(base.flat, base.sets, stand_in("set_id"), "classes", rel)
    at_first = kept(singles(all_flat, wanted.select(stand_in("set_id").alias("instance"), "concept"), []).select(F.substring("instance", len("members:") + 1, 64).alias("set_id"), "both", "missed", "invented"), "singles")
    sums = [F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c) for c in ("both", "missed", "invented")]
    start = base.sets.join(at_first, "set_id").agg(*sums).first()
    flats = _with_members(_trial_graph(base.flat, trials, flat_preimage(gone, rel, BY)), some, F.col("member"), "classes", rel)
    now = weighed(singles(flats, expected, ["trial"])).groupBy("trial").agg(*sums)
    was = weight.join(at_first, "set_id").groupBy("trial").agg(*(s.alias(f"{c}_was") for s, c in zip(sums, ("both", "missed", "invented"))))

    out = trials.join(broken(before, "_before"), "trial", "left").join(broken(after, "_after"), "trial", "left")
    out = out.join(removed.groupBy("trial").agg(F.count("*").cast("int").alias("removed")), "trial", "left").join(precision, "trial", "left").join(now, "trial", "left").join(was, "trial", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    count = F.lit(total).cast("long")
    single = {c: F.lit(start[c]) + none(c) - none(f"{c}_was") for c in ("both", "missed", "invented")}
    cover = lambda valid: ratio(valid, count, 1.0)
    return out.select(*trials.columns, count.alias("n_expected"), cover(count - none("_before")).alias("cov_corrupt"), cover(count - none("_after")).alias("cov_repair"), none("removed").alias("removed"), single["missed"].cast("int").alias("single_fn"), single["invented"].cast("int").alias("single_fp"), "edge_precision", cover(single["both"]).alias("cov_single"))


def rewired_trials(graph: Graph, trials: DataFrame, rho: float = 0.2, rel: Relations = RELATIONS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(removed supersetOf edges, cut subClassOf edges, put subClassOf edges) by trial, for factors rewire, seed: rho of
    supersetOf is removed, a share of subClassOf is led to drawn wrong parents."""
    typed = graph.edges.select(*KEY).distinct()
    seed = F.col("seed").cast("string")
    removed = kept(sample_k(_crossed(typed.where(F.col("relation") == rel.superset_of), trials, "seed"), rho, [seed], list(KEY), BY, few=True).select("trial", *KEY), "removed")
    sub = _crossed(typed.where(F.col("relation") == rel.sub_class_of), trials, "rewire", "seed")
    cut = kept(sample_k(sub, F.col("rewire"), [seed, "w"], list(KEY), BY, few=True).select("trial", "seed", *KEY), "cut")
    put = kept(damage.wrong_parents(graph.nodes, typed, cut.select("trial", "seed", "src", "dst"), seed, ("trial", "seed")), "put")
    return removed, cut.select("trial", *KEY), put.select("trial", "src", "dst", F.lit(rel.sub_class_of).alias("relation"))


def pair_widths(graph: Graph, scored: DataFrame, expected: DataFrame, rel: Relations = RELATIONS) -> DataFrame:
    """(by, instance, concept, width): the largest threshold at which the pair has a thread once all proposals from it on
    are added: 2 for threads that are there, null for pairs that no proposal restores."""
    by = list(graph.by)
    weighted = kept(graph.edges.select(*by, *KEY, F.lit(2.0).alias("weight")).unionByName(scored.select(*by, *KEY, F.col("confidence").alias("weight"))), "weighted")
    there = entries(graph, rel).withColumn("w0", F.lit(2.0))
    whole = entries(Graph(graph.nodes, weighted.select(*by, *KEY), graph.by), rel)
    new = whole.join(scored.where(F.col("relation") == rel.has_extension).select(*by, F.col("src").alias("start"), F.col("dst").alias("entry"), F.col("confidence").alias("w0")), [*by, "start", "entry"])
    start = kept(there.unionByName(new).groupBy(*by, "concept", "entry").agg(F.max("w0").alias("w0")), "entries")
    down = widest(weighted.where(F.col("relation") == rel.superset_of), graph.by)
    full = reflexive(down, start.select(*by, F.col("entry").alias("id")), graph.by).join(down, [*by, "src", "dst"], "left").withColumn("width", F.coalesce("width", F.lit(2.0)))
    held = weighted.where(F.col("relation") == rel.has_element).groupBy(*by, F.col("src").alias("node"), F.col("dst").alias("instance")).agg(F.max("weight").alias("w2"))
    reach = start.join(full.select(*by, F.col("src").alias("entry"), F.col("dst").alias("node"), "width"), [*by, "entry"]).groupBy(*by, "concept", "node").agg(F.max(F.least("w0", "width")).alias("w1"))
    widths = held.join(reach, [*by, "node"]).groupBy(*by, "instance", "concept").agg(F.max(F.least("w1", "w2")).alias("width"))
    return expected.select(*by, "instance", "concept").distinct().join(widths, [*by, "instance", "concept"], "left")


def run_threshold_grid(dual: Graph, trials: DataFrame, thetas=THETAS, rho: float = 0.2, dataset: str = "dataset", redundancy: float = 0.0, rel: Relations = RELATIONS) -> DataFrame:
    """Per (rewire, seed, confidence, theta): quality of a repair that infers its target from the damaged graph itself.

    Each proposal is judged once for each trial and scored by each scorer, and falls into the bin of the largest theta that
    its score reaches, as does each pair by its width. Sums over the bins from a theta on give that theta's row; nothing
    but the histograms, as long as thetas for each trial, is spread over thetas.
    """
    levels = sorted(set(map(float, thetas)))
    base = fold_graphs(dual, None, rel)
    oracle: Oracle = freeze_oracle(base.whole, rel)
    removed, cut, put = rewired_trials(dual, trials, rho, rel)
    gone = kept(removed.unionByName(cut), "gone")
    touched = _touched(base, gone, rel)
    some = kept(touched.join(base.sets, "set_id").select("trial", stand_in("set_id").alias("member"), "n", "kind", "nodes"), "stand-ins")
    graphs = _with_members(_trial_graph(base.dual, trials, gone, put), some, F.col("member"), "nodes", rel)
    graphs = Graph(kept(graphs.nodes, "nodes"), kept(graphs.edges, "edges"), BY)
    found = kept(proposals(graphs, kept(validate(graphs, None, rel), "report"), rel), "proposals")

    # Truth does not depend on the trial.
    asked = kept(found.select(*KEY).distinct(), "asked")
    is_true = asked.join(oracle.edges.select(*KEY).withColumn("hit", F.lit(1)), list(KEY), "left").join(semantically_correct(asked, oracle, (), rel), list(KEY), "left")
    can = kept(recoverable(removed, Oracle(None, _crossed(oracle.edges.select(*KEY), trials), None, None), graphs.nodes, BY, rel), "recoverable")
    weight = some.select("trial", F.col("member").alias("dst"), "n")
    judged = found.join(is_true.select(*KEY, F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce(F.col("is_true").cast("int"), F.lit(0)).alias("close")), list(KEY))
    judged = judged.join(can.withColumn("back", F.lit(1)), ["trial", *KEY], "left").join(weight, ["trial", "dst"], "left").na.fill(0, ["back"]).na.fill(1, ["n"])
    judged = kept(judged, "judged")

    # Pairs that no removal touches keep their threads.
    expected = kept(oracle.expected.join(some.select("trial", F.col("member").alias("instance"), "n"), "instance").select("trial", "instance", "concept", "n"), "expected")
    total = base.sets.join(oracle.expected.withColumn("set_id", F.substring("instance", len("members:") + 1, 64)), "set_id").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_can = can.groupBy("trial").agg(F.count("*").alias("n_can"))
    bin_of = lambda c: F.size(F.filter(F.array(*map(F.lit, levels)), lambda t: F.coalesce(c >= t, F.lit(False))))
    names = ("n_added", "n_true", "n_close", "n_back", "n_restored")
    zero = F.lit(0).cast("long")
    bars = lost = None
    for name, scorer in (("prior", prior_scorer), ("corroboration", corroboration_scorer(rel=rel))):
        scored = kept(scorer(judged, graphs), "scored")
        own = scored.groupBy("trial", bin_of(F.col("confidence")).alias("bin")).agg(F.sum("n").alias("n_added"), F.sum(F.col("n") * F.col("hit")).alias("n_true"), F.sum(F.col("n") * F.col("close")).alias("n_close"), F.sum("back").alias("n_back"), zero.alias("n_restored"))
        widths = kept(pair_widths(graphs, scored, expected, rel).join(expected, ["trial", "instance", "concept"]).where("width is null or width < 2"), "widths")
        pairs = widths.groupBy("trial", bin_of(F.col("width")).alias("bin")).agg(*(zero.alias(c) for c in names[:-1]), F.sum("n").alias("n_restored"))
        both = own.unionByName(pairs).withColumn("confidence", F.lit(name))
        bars = both if bars is None else bars.unionByName(both)
        lost = widths.groupBy("trial").agg(F.sum("n").alias("n_lost")) if lost is None else lost  # the same for both scorers
    bars = kept(bars, "bars")
    each = bars.where("bin > 0").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("bin") - 1))).groupBy("trial", "confidence", "_k").agg(*(F.sum(c).alias(c) for c in names))
    frame = trials.select("trial", "rewire", "seed", F.explode(F.array(F.lit("prior"), F.lit("corroboration"))).alias("confidence")).select("*", F.posexplode(F.array(*map(F.lit, levels))).alias("_k", "theta"))
    rows = frame.join(each, ["trial", "confidence", "_k"], "left").join(n_can, "trial", "left").join(lost, "trial", "left").na.fill(0, [*names, "n_can", "n_lost"])
    share = lambda a: ratio(F.col(a), F.col("n_added"))
    count = F.lit(total).cast("long")
    return rows.select(F.lit(dataset).alias("dataset"), F.lit(float(redundancy)).alias("redundancy"), "confidence", "rewire", "seed", "theta", F.col("n_added").cast("int").alias("n_added"), share("n_true").alias("edge_precision"), share("n_close").alias("edge_precision_closure"), ratio(F.col("n_back"), F.col("n_can")).alias("edge_recall"), (1 - share("n_true")).alias("hallucination"), (1 - share("n_close")).alias("hallucination_closure"), ratio(F.col("n_restored"), F.col("n_lost")).alias("pair_recall"), ratio(count - F.col("n_lost") + F.col("n_restored"), count, 1.0).alias("cov_after"))


def mean_scores(grid: DataFrame) -> DataFrame:
    """Means of the scores for each (dataset, arm, rho), to 3 places."""
    scores = [c for c in ("cov_corrupt", "cov_repair", "cov_single", "edge_precision", "single_fn", "single_fp") if c in grid.columns]
    by = [c for c in ("dataset", "arm", "rho") if c in grid.columns]
    return grid.groupBy(*by).agg(*(F.bround(F.avg(c), 3).alias(c) for c in scores))


def detection_errors(grid: DataFrame, rho: float) -> DataFrame:
    """Mean misses and inventions of the single-node graph at one rho, for each (dataset, arm)."""
    by = [c for c in ("dataset", "arm") if c in grid.columns]
    return grid.where(F.col("rho") == rho).groupBy(*by).agg(F.avg("single_fn").alias("mean_fn"), F.avg("single_fp").alias("mean_fp"))


def fidelity(grid: DataFrame, theta: float = 0.75) -> DataFrame:
    """Mean precision and hallucination by rewire rate and scorer at one theta."""
    return grid.where(F.col("theta") == theta).groupBy("dataset", "confidence", "rewire").agg(F.avg("edge_precision").alias("edge_precision"), F.avg("hallucination").alias("hallucination"))


def fidelity_surface(grid: DataFrame) -> DataFrame:
    """The same for every theta of the grid: hallucination and precision by (dataset, scorer, rewire rate, theta)."""
    return grid.groupBy("dataset", "confidence", "rewire", "theta").agg(F.avg("edge_precision").alias("edge_precision"), F.avg("hallucination").alias("hallucination"))


def coverage_series(grid: DataFrame) -> DataFrame:
    """(dataset, arm, rho, series, n, mean, half): coverage of the damaged, repaired and single-node graph by rho, with a
    normal 95 % interval over seeds."""
    series = [c for c in ("cov_corrupt", "cov_repair", "cov_single") if c in grid.columns]
    by = [c for c in ("dataset", "arm", "rho") if c in grid.columns]
    return mean_ci(grid.unpivot(by, series, "series", "value"), "value", (*by, "series"))
