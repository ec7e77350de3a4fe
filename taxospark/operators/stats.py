"""Curves and tests over result grids."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept


def pr_points(grid: DataFrame, precision: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, theta, recall, precision): means for each theta, to 4 places; thetas without either are left out."""
    means = grid.groupBy(*by, "theta").agg(F.bround(F.avg("edge_recall"), 4).alias("recall"), F.bround(F.avg(precision), 4).alias("precision"))
    return means.dropna(subset=["recall", "precision"])


def average_precision(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ap): best precision at a recall of at least r, on a grid of 101 recalls from 0 to the largest, trapezoids."""
    rows = points.select(*by, "recall", "precision").distinct()
    grouped = rows.groupBy(*by).agg(F.collect_list(F.struct("recall", "precision")).alias("points"), F.max("recall").alias("top"))

    def best(i: Column) -> Column:
        r = F.col("top") * i / 100.0
        return F.coalesce(F.array_max(F.transform(F.filter("points", lambda p: p["recall"] >= r - 1e-9), lambda p: p["precision"])), F.lit(0.0))

    curve = grouped.select(*by, "top", F.transform(F.sequence(F.lit(0), F.lit(100)), best).alias("curve"))
    area = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, i: a + (F.element_at("curve", i) + F.element_at("curve", i + 1)) / 2.0 * (F.col("top") / 100.0))
    return curve.select(*by, F.coalesce(area, F.lit(0.0)).alias("ap"))


def precision_advantage(grid: DataFrame, precision: str, by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """(by, ap_prior, ap_corroboration, advantage) over pooled points."""
    ap = average_precision(pr_points(grid, precision, (*by, "confidence")), (*by, "confidence"))
    side = lambda c: F.coalesce(F.max(F.when(F.col("confidence") == c, F.col("ap"))), F.lit(0.0)).alias(f"ap_{c}")
    return ap.groupBy(*by).agg(side("prior"), side("corroboration")).withColumn("advantage", F.col("ap_corroboration") - F.col("ap_prior"))


def pareto_front(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Points that no point of at least the same recall beats in precision (by more than 1e-9)."""
    w = Window.partitionBy(*by).orderBy(F.col("recall").desc(), F.col("precision").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return points.select(*by, "recall", "precision").distinct().withColumn("_top", F.max("precision").over(w)).where(F.col("_top").isNull() | (F.col("precision") > F.col("_top") + 1e-9)).drop("_top")


def paired_trial_aps(grid: DataFrame, precision: str) -> DataFrame:
    """(dataset, rewire, seed, ap_prior, ap_corroboration) of trials with both scorers."""
    trial = ("dataset", "rewire", "seed", "confidence")
    points = grid.select(*trial, F.col("edge_recall").alias("recall"), F.col(precision).alias("precision"))
    ap = grid.select(*trial).distinct().join(average_precision(points.dropna(subset=["recall", "precision"]), trial), list(trial), "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))
    side = lambda c: ap.where(F.col("confidence") == c).select("dataset", "rewire", "seed", F.col("ap").alias(f"ap_{c}"))
    return side("prior").join(side("corroboration"), ["dataset", "rewire", "seed"])


def seed_of(*parts) -> int:
    """A seed fixed by its parts."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big")


def bootstrap_ci(df: DataFrame, value: str, by: tuple[str, ...], n_boot: int = 10_000, alpha: float = 0.05, statistic: Callable | None = None, seed: int = 0) -> DataFrame:
    """(by, stat, ci_lo, ci_hi): percentile interval of the means of n_boot resamples.

    Equal values are counted first. A value that occurs m times has a weight of Poisson(m) in each resample, drawn by a
    generator that the seed, the group and the value fix; tasks sum up weights and weighted values, so a group may lie
    in any number of tasks and the result does not depend on how. Undefined values are dropped; one value is its own
    interval; without any, the row holds nulls. Another statistic, a function over an array, needs whole resamples: it
    is worked out in one task a group, so for small groups only.
    """
    if statistic is not None:
        return _resampled(df, value, by, n_boot, alpha, statistic, seed)
    by = list(by)
    x = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    counted = df.select(*by, x.alias("_x")).groupBy(*by, "_x").agg(F.count("*").alias("_m"))
    known = counted.where("_x is not null")
    base = counted.groupBy(*by).agg((F.sum(F.col("_x") * F.col("_m")) / F.sum(F.when(F.col("_x").isNotNull(), F.col("_m")))).alias("stat"), F.coalesce(F.sum(F.when(F.col("_x").isNotNull(), F.col("_m"))), F.lit(0)).alias("_n"))
    # A hash that all rows of a value share seeds its weights.
    keyed = known.select(*by, "_x", "_m", F.xxhash64(F.lit(str(seed)), *(F.col(c).cast("string") for c in by), "_x").alias("_h"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                weight = np.random.Generator(np.random.Philox(key=row[-1] & (2**64 - 1))).poisson(row[-2], n_boot)
                own = sums.setdefault(tuple(row[: len(by)]), np.zeros((2, n_boot)))
                own[0] += weight
                own[1] += weight * row[-3]
        for key, own in sums.items():
            yield pd.DataFrame({**{c: [k] * n_boot for c, k in zip(by, key)}, "_rep": np.arange(n_boot), "_w": own[0], "_wx": own[1]})

    kinds = dict(df.dtypes)
    parts = keyed.mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "_rep int, _w double, _wx double"]))
    means = parts.groupBy(*by, "_rep").agg(F.try_divide(F.sum("_wx"), F.sum("_w")).alias("_mean")).where("_mean is not null")  # a resample may be empty
    ends = means.groupBy(*by).agg(F.percentile("_mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("_ends"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    one = F.col("_n") == 1
    end = lambda i: F.when(one, F.col("stat")).otherwise(F.get("_ends", F.lit(i)))
    joined = base.alias("l").join(ends.alias("r"), same, "left") if same else base.withColumn("_one", F.lit(0)).join(ends.withColumn("_one", F.lit(0)), "_one", "left")
    return joined.select(*(F.col(f"l.{c}") for c in by), "stat", end(0).alias("ci_lo"), end(1).alias("ci_hi"))


def _resampled(df: DataFrame, value: str, by: tuple[str, ...], n_boot: int, alpha: float, statistic: Callable, seed: int) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*by, value])
        x = pdf[value].dropna().to_numpy(float)
        key = [pdf[c].iloc[0] for c in by]
        if not len(x):
            got = (None, None, None)
        elif len(x) == 1:
            got = (float(x[0]),) * 3
        else:
            rng = np.random.default_rng(seed_of(seed, *key))
            stats = [statistic(x[rng.integers(0, len(x), len(x))]) for _ in range(n_boot)]
            got = (float(statistic(x)), *(float(q) for q in np.percentile(stats, [100 * alpha / 2, 100 * (1 - alpha / 2)])))
        return pd.DataFrame([[*key, *got]], columns=[*by, "stat", "ci_lo", "ci_hi"])

    kinds = dict(df.dtypes)
    return df.select(*by, value).groupBy(*by).applyInPandas(one, ", ".join([*(f"{c} {kinds[c]}" for c in by), "stat double", "ci_lo double", "ci_hi double"]))


def rank_sums(pairs: DataFrame, by: tuple[str, ...], a: str, b: str, parts: int | None = None) -> DataFrame:
    """(by, n_pairs, n, n_zero, n_sizes, plus, ties, far): of the differences a - b without zeros (n of them, of n_sizes
    different sizes) the sum of the ranks of the positive ones, ranks by size and equal sizes with their mean rank; ties is
    the sum of t^3 - t over sizes that occur t times; far counts pairs that are not close.

    Differences are counted by size; a size's rank is how many smaller ones there are, from running sums inside ranges of
    sizes and the sums of the ranges before. No task holds a group. Pairs with an undefined side are left out.
    """
    by = list(by)
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    d = pairs.where(~F.isnan(x) & ~F.isnan(y) & x.isNotNull() & y.isNotNull()).select(*by, (x - y).alias("_d"), (F.abs(x - y) > 1e-8 + 1e-5 * F.abs(y)).alias("_far"))
    sizes = d.groupBy(*by, F.abs("_d").alias("_size")).agg(F.count("*").alias("_t"), F.count_if(F.col("_d") > 0).alias("_plus"), F.count_if("_far").alias("_far"))
    sizes = kept(sizes, "sizes")
    parts = parts or max(1, sizes.count() // 1_000_000)
    ranged = kept(sizes.where("_size > 0").repartitionByRange(parts, *by, "_size").withColumn("_p", F.spark_partition_id()), "ranged")
    within = F.sum("_t").over(Window.partitionBy("_p", *by).orderBy("_size"))
    totals = ranged.groupBy(*by, "_p").agg(F.sum("_t").alias("_all"))  # a row for each range of a group
    before = totals.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_p").alias("_q"), (F.sum("_all").over(Window.partitionBy(*by).orderBy("_p")) - F.col("_all")).alias("_before"))
    own = ranged.withColumn("_to", within).join(before, (F.col("_p") == F.col("_q")) & _all_equal(by))
    rank = F.col("_before") + F.col("_to") - (F.col("_t") - 1) / 2.0
    sums = own.groupBy(*by).agg(F.sum("_t").alias("n"), F.count("*").alias("n_sizes"), F.sum(F.col("_plus") * rank).alias("plus"), F.sum(F.pow("_t", F.lit(3)) - F.col("_t")).alias("ties"))
    all_ = sizes.groupBy(*by).agg(F.sum("_t").alias("n_pairs"), F.sum(F.when(F.col("_size") == 0, F.col("_t")).otherwise(0)).alias("n_zero"), F.sum("_far").alias("far"))
    other = sums.select(*(F.col(c).alias(f"_{c}") for c in by), "n", "n_sizes", "plus", "ties")
    out = all_.join(other, _all_equal(by), "left")
    return out.select(*by, "n_pairs", F.coalesce("n", F.lit(0)).alias("n"), "n_zero", F.coalesce("n_sizes", F.lit(0)).alias("n_sizes"), F.coalesce("plus", F.lit(0.0)).alias("plus"), F.coalesce("ties", F.lit(0.0)).alias("ties"), "far")


def _all_equal(by: list[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out


def signed_rank_p(n: int, plus: float, n_sizes: int, n_zero: int, ties: float) -> tuple[float, float]:
    """Statistic (the smaller rank sum) and two-sided p. Exact null distribution for at most 50 differences without zeros
    and ties, else the normal approximation with tie correction."""
    low = min(plus, n * (n + 1) / 2 - plus)
    if not n_zero and n_sizes == n and n <= 50:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return low, float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return low, float(min(1.0, math.erfc(abs((low - n * (n + 1) / 4) / spread) / math.sqrt(2))))


def wilcoxon(a, b) -> tuple[float, float]:
    """Signed-rank statistic and two-sided p of two small paired samples (see signed_rank_p); samples that are all close give
    (0, 1)."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if a.shape != b.shape:
        raise ValueError("samples must have equal length")
    if not len(a) or np.allclose(a, b):
        return 0.0, 1.0
    d = a - b
    n_zero, d = int((d == 0).sum()), d[d != 0]
    size, place, times = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    ranks = (np.cumsum(times) - (times - 1) / 2.0)[place]
    return signed_rank_p(len(d), float(ranks[d > 0].sum()), len(size), n_zero, float((times.astype(float) ** 3 - times).sum()))


def paired_tests(pairs: DataFrame, by: tuple[str, ...], a: str = "ap_corroboration", b: str = "ap_prior") -> DataFrame:
    """(by, n, statistic, p) for each group: ranks by rank_sums; only its sums reach the p-value."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [(0.0, 1.0) if not r.far or not r.n else signed_rank_p(int(r.n), float(r.plus), int(r.n_sizes), int(r.n_zero), float(r.ties)) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({**{c: pdf[c] for c in by}, "n": pdf["n_pairs"].astype("int32"), "statistic": [g[0] for g in got], "p": [g[1] for g in got]})

    kinds = dict(pairs.dtypes)
    return rank_sums(pairs, by, a, b).mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "n int", "statistic double", "p double"]))


def holm(tests: DataFrame, p: str = "p", alpha: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """tests with holm_p and significant."""
    w = Window.partitionBy(*by).orderBy(p, *[c for c in tests.columns if c != p])
    m = F.count("*").over(Window.partitionBy(*by))
    raw = tests.withColumn("_r", (m - F.row_number().over(w) + 1) * F.col(p))
    return raw.withColumn("holm_p", F.least(F.max("_r").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("_r").withColumn("significant", F.col("holm_p") < alpha)


def mean_ci(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """(by, n, mean, half): mean with a normal 95 % interval; one value has width 0."""
    x = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(1.96 * F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(0.0)).alias("half"))


def advantage_table(grid: DataFrame, precision: str, alpha: float = 0.05) -> DataFrame:
    """Per dataset: redundancy, trials, mean AP advantage with its interval, test, Holm, edges at the best-precision theta."""
    pairs = paired_trial_aps(grid, precision).withColumn("diff", F.col("ap_corroboration") - F.col("ap_prior"))
    base = grid.groupBy("dataset").agg(F.max("redundancy").alias("redundancy"))
    ci = bootstrap_ci(pairs, "diff", ("dataset",)).select("dataset", F.col("stat").alias("ap_adv"), "ci_lo", "ci_hi")
    tests = holm(paired_tests(pairs, ("dataset",)).select("dataset", F.col("n").alias("n_trials"), F.col("p").alias("wilcoxon_p")), "wilcoxon_p", alpha)
    points = grid.where(F.col("confidence") == "corroboration").groupBy("dataset", "theta").agg(F.avg("n_added").alias("n"), F.avg(precision).alias("prec")).where(F.col("n") >= 0.5)
    peak = points.where(F.col("prec").isNotNull()).groupBy("dataset").agg(F.max_by("n", F.struct("prec", (-F.col("theta")).alias("t"))).alias("n_edges_at_peak_prec"))
    return base.join(ci, "dataset").join(tests, "dataset").join(peak, "dataset", "left").orderBy("redundancy", "dataset")


def merged_tables(exact: DataFrame, closed: DataFrame) -> DataFrame:
    """The exact table with the closure-aware columns beside it."""
    own = closed.select("dataset", *(F.col(c).alias(f"{c}_closure") for c in closed.columns if c not in ("dataset", "redundancy", "n_trials")))
    return exact.join(own, "dataset")
