"""Quality rules: counts for every text, and a decision list that is learned from labelled counts.

DataFrame functions only. The learner is sequential covering: a rule for low quality grows one threshold condition at
a time by information gain, is pruned back on rows it did not grow from, and its rows are taken out before the next
rule grows. Every count it needs comes from a Spark aggregation over a bounded sample of labelled rows; the driver
sees only sums for each feature and threshold. The result is a chain of ordered conditional expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fenced
from .common import kept as written

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Labelled rows that a list is learned from, at most (those with the smallest hash of their id).
SAMPLE = 20_000
FEATURES = ("n_words", "word_len", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "mark_rate", "distinct_rate")
LEVELS = (0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98, 0.99, 0.995)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the rates of FEATURES.

    A null text is an empty one: all counts 0, base_failed true, rates 0. Null and repeated ids pass through, one row
    out for each row in; an empty table gives an empty result; further columns are dropped. Equal windows of three
    words are told by a 64-bit hash within their text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    d = d.select("doc_id", "text", F.filter(F.split("text", BLANKS, -1), lambda w: w != "").alias("words"))
    d = d.select(
        "doc_id",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.regexp_count("text", F.lit(SYMBOLS)).alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).alias("n_upper"),
        F.length(F.regexp_replace("text", r"[^!?|]+", "")).alias("n_marks"),
        F.filter(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != "").alias("lines"),
        F.slice(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))), F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))).alias("windows"),
    )
    # Only texts with an equal pair of windows sort them; each step is a column of its own so that it is made once.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.withColumn("ranked", F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("ranked", lambda s, j: F.coalesce(s["h"] == F.get("ranked", j - 1)["h"], F.lit(False)) | F.coalesce(s["h"] == F.get("ranked", j + 1)["h"], F.lit(False)))
    places = F.array_sort(F.transform(twice, lambda s: s["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(p - s["last"], F.lit(3))).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )
    long = lambda c: F.col(c).cast("long").alias(c)
    d = fenced(
        d,
        "doc_id",
        *(long(c) for c in ("n_words", "word_chars", "n_symbols", "n_distinct", "n_upper", "n_marks")),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return d.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "word_len": rate("word_chars", "n_words"),
            "symbol_rate": rate("n_symbols", "n_words"),
            "dup_line_rate": rate("n_dup_lines", "n_lines"),
            "repeat_rate": rate("n_repeat_words", "n_words"),
            "upper_rate": rate("n_upper", "word_chars"),
            "mark_rate": rate("n_marks", "n_words"),
            "distinct_rate": rate("n_distinct", "n_words"),
        }
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        own = F.col(self.feature).cast("double")
        return own > self.threshold if self.above else own <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class DecisionList:
    """Ordered rules, each a conjunction that rejects; a text that none takes is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def keeps(self) -> Column:
        out = None
        for rule in self.rules:
            taken = _all(rule)
            out = F.when(taken, F.lit(False)) if out is None else out.when(taken, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join([*(f"reject if {' and '.join(map(str, r))}" for r in self.rules), "else keep"])


def _all(rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _gain(bad: float, good: float, bad0: float, good0: float) -> float:
    if not bad:
        return -1.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


def learn(rows: DataFrame, label_col: str = "quality", max_rules: int = 8, max_conditions: int = 3, precision: float = 0.97, min_cover: int = 5) -> DecisionList:
    """A decision list for label 0 (low) against 1, from rows with FEATURES and the label.

    Two thirds of the rows, by a hash of the id, grow rules; the others prune them. A rule stays if on both parts at
    least `precision` of the rows that it takes are low and it takes min_cover of them. Rows whose label is neither
    0 nor 1 are left out; without low rows the list is empty.
    """
    data = rows.where(F.col(label_col).isin(0, 1)).select("doc_id", *FEATURES, (F.col(label_col) == 0).alias("bad"), (F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(3)) < 2).alias("grow"))
    cuts = data.agg(*(F.percentile(f, F.array(*map(F.lit, LEVELS))).alias(f) for f in FEATURES)).first()
    if cuts is None or any(cuts[f] is None for f in FEATURES):
        return DecisionList()
    # Thresholds lie half way between neighbouring levels, so a rule keeps its distance from both classes.
    levels = {f: sorted(set(cuts[f])) for f in FEATURES}
    thresholds = {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in levels.items() if len(v) > 1}
    features = list(thresholds)
    if not features:
        return DecisionList()
    done = DecisionList()
    for _ in range(max_rules):
        left = data.where(done.keeps())
        growing = left.where("grow")
        rule: tuple[Condition, ...] = ()
        while len(rule) < max_conditions:
            # One row for each feature, cut interval and class: sums over them give every threshold's counts.
            inside = growing.where(_all(rule))
            place = F.array(*(F.struct(F.lit(f).alias("feature"), F.size(F.filter(F.array(*map(F.lit, thresholds[f])), _below(f))).alias("bin")) for f in features))
            table = inside.select("bad", F.explode(place).alias("p")).groupBy("p.feature", "p.bin", "bad").count().collect()
            n = {(r["feature"], r["bin"], r["bad"]): r["count"] for r in table}
            bad0 = sum(v for (f, _, b), v in n.items() if b and f == features[0])
            good0 = sum(v for (f, _, b), v in n.items() if not b and f == features[0])
            if bad0 < min_cover or not good0:
                break
            best = (0.0, None)
            for f in features:
                for i, t in enumerate(thresholds[f]):
                    low_bad = sum(n.get((f, k, True), 0) for k in range(i + 1))
                    low_good = sum(n.get((f, k, False), 0) for k in range(i + 1))
                    for above, bad, good in ((False, low_bad, low_good), (True, bad0 - low_bad, good0 - low_good)):
                        gain = _gain(bad, good, bad0, good0)
                        if bad >= min_cover and gain > best[0] + 1e-9:
                            best = (gain, Condition(f, above, t))
            if best[1] is None:
                break
            rule = (*rule, best[1])
        if not rule:
            break
        sums = [F.count_if(_all(rule[:k]) & (F.col("bad") if bad else ~F.col("bad")) & (F.col("grow") if grow else ~F.col("grow"))) for k in range(1, len(rule) + 1) for grow in (True, False) for bad in (True, False)]
        got = list(left.agg(*sums).first())
        best_k, best_worth = 0, 0.0
        for k in range(1, len(rule) + 1):
            gb, gg, pb, pg = got[4 * (k - 1) : 4 * k]
            good_enough = gb + pb >= min_cover and gb >= precision * (gb + gg) and pb >= precision * (pb + pg) and pb > 0
            worth = (pb - pg) / (pb + pg) * math.log2(1 + pb + gb) if good_enough else 0.0
            if worth > best_worth:
                best_k, best_worth = k, worth
        if not best_k:
            break
        done.rules.append(rule[:best_k])
    return done


def _below(feature: str):
    return lambda t: F.col(feature).cast("double") > t


def learn_from(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> DecisionList:
    """Learn from at most `sample` labelled documents. Their ids, so bounded, are the only thing that is broadcast.

    Where a document has several labels, the lowest one counts. Texts that the base rule fails teach nothing.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).alias(label_col)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = written(chosen, "labels")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = written(counts(texts).where(~F.col("base_failed")).select("doc_id", *FEATURES), "features")
    return learn(rows.join(F.broadcast(chosen), "doc_id"), label_col)


def apply_rules(counted: DataFrame, rules: DecisionList) -> DataFrame:
    """counted (from counts()) with `kept`: false where the base rule failed, else the decision list's verdict."""
    return counted.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(rules.keeps()))
