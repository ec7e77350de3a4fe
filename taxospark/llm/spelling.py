"""Spelling variants: words that differ by one letter, and the more frequent form that each may stand for.

One edit moves a word's vector of letter counts by an L1 distance of at most two: a replaced letter takes one count and
adds another, a deleted one takes one. So near words are found by range searches in k-d trees over letter counts, one
for each pair of lengths: a tree over the words of a length, asked by words of that length and by words one longer. A
search leaves the side of a node that its word is on only by spending its one added or its one taken letter, which
prunes all other boxes. Letter order decides about what is found.

A tree's upper part is fitted on a bounded sample of the words and deals all words into cells; a word is asked in every
cell that its range reaches. Cells are dealt into blocks of bounded size, each of which has a tree of its own.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept

#: Words that the upper trees are fitted on, at most (those of smallest hash).
SAMPLE = 40_000
#: Words of a cell that its size is aimed at; rows of a block on either side, at most in the mean.
CELL, BLOCK = 10_000, 50_000
#: Points of a leaf, queries that walk a tree together, letters that are compared at a time.
LEAF, WALK, COMPARE = 24, 2048, 4_000_000
RUN = r"[a-zÀ-ÿ]+"


def altered(doc_id: Column, run: Column, every: int) -> Column:
    """The run without the letter at h % length if `every` divides h, the crc32 of <doc_id>:<run>; a null id is empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, min_chars: int = 6, min_count: int = 5, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of Latin letters (A-Z lower-cased) of at least min_chars that occur min_count times or more in all texts.

    Null texts have no runs; each row counts, repeated ids too. `every` alters some occurrences (see altered).
    """
    lower = F.translate(F.col(text_col).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    # The outer form adds no filter on the array, which would make it twice.
    runs = docs.select(F.col(id_col).alias("id"), F.explode_outer(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= min_chars)
    words = runs.select((altered(F.col("id"), F.col("run"), every) if every else F.col("run")).alias("word"))
    if every:
        words = words.where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def letter_counts(words: list[str]) -> np.ndarray:
    """How often each of the 256 Latin-1 characters is in each word."""
    raw = [w.encode("latin-1") for w in words]
    row = np.repeat(np.arange(len(raw)), np.fromiter(map(len, raw), np.int64, len(raw)))
    return np.bincount(row * 256 + np.frombuffer(b"".join(raw), np.uint8), minlength=256 * len(raw)).reshape(len(raw), 256).astype(np.int32)


class KdTree:
    """A k-d tree over count vectors: node k splits letter[k] at cut[k] (at most / more); letter -1 is a leaf."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.letter, self.cut, self.left, self.right, self.rows = [], [], [], [], []
        self.points = points
        todo = [(np.arange(len(points)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            k = len(self.letter)
            if parent is not None:
                (self.left, self.right)[side][parent] = k
            found = self._split(points[rows]) if len(rows) > leaf else None
            letter, cut = found or (-1, 0)
            for column, value in zip((self.letter, self.cut, self.left, self.right, self.rows), (letter, cut, -1, -1, rows if found is None else None)):
                column.append(value)
            if found:
                low = points[rows, letter] <= cut
                todo += [(rows[low], k, 0), (rows[~low], k, 1)]
        self.letter, self.cut, self.left, self.right = (np.array(x, np.int64) for x in (self.letter, self.cut, self.left, self.right))

    @staticmethod
    def _split(points: np.ndarray) -> tuple[int, int] | None:
        """The letter and cut that divide the points most evenly; none if all points are equal."""
        best, half = None, len(points) // 2
        low, high = points.min(axis=0), points.max(axis=0)
        varied = np.flatnonzero(low < high)
        if not len(varied):
            return None
        own = points[:, varied]
        middle = np.clip(np.partition(own, half, axis=0)[half], low[varied], high[varied] - 1)
        for cut in (middle, np.maximum(middle - 1, low[varied])):
            share = np.abs((own <= cut).sum(axis=0) - half)
            k = int(share.argmin())
            if best is None or share[k] < best[0]:
                best = (share[k], int(varied[k]), int(cut[k]))
        return best[1:]

    def reached(self, queries: np.ndarray, add: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) for every leaf whose box holds a vector with at most one count taken and `add` counts added."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        take, give = np.ones(len(q), np.int64), np.full(len(q), add)
        out = []
        while len(q):
            leaf = self.letter[node] < 0
            out.append((q[leaf], node[leaf]))
            q, node, take, give = (x[~leaf] for x in (q, node, take, give))
            own, cut = queries[q, self.letter[node]], self.cut[node]
            parts = []
            for side, free, paid, cost_take, cost_give in ((self.left, own <= cut, (own == cut + 1) & (take > 0), 1, 0), (self.right, own > cut, (own == cut) & (give > 0), 0, 1)):
                parts.append((q[free], side[node[free]], take[free], give[free]))
                parts.append((q[paid], side[node[paid]], take[paid] - cost_take, give[paid] - cost_give))
            q, node, take, give = (np.concatenate(x) for x in zip(*parts))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (q, node)


def one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replaced letter (equal widths) or one that x has more."""
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(axis=1) == 1
    n = y.shape[1]
    before, behind = x[:, :n] != y, x[:, 1:] != y
    first = np.where(before.any(axis=1), before.argmax(axis=1), n)
    last = np.where(behind.any(axis=1), n - 1 - behind[:, ::-1].argmax(axis=1), -1)
    return last < first


def near_pairs(words: list[str], points: np.ndarray, asked: list[str], vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of asked, rows of words) that are one edit apart. words: of one length; asked: all of that length or one longer.
    All pairs of a row of asked come together."""
    if not words or not asked:
        return
    add = int(len(asked[0]) == len(words[0]))
    used = np.flatnonzero(points.any(axis=0) | vectors.any(axis=0))
    points, vectors = points[:, used], vectors[:, used]
    tree = KdTree(points, LEAF)
    letters, wanted = (np.frombuffer("".join(w).encode("latin-1"), np.uint8).reshape(len(w), -1) for w in (words, asked))
    leaves = [k for k, r in enumerate(tree.rows) if r is not None]
    size = np.zeros(len(tree.letter), np.int64)
    size[leaves] = [len(tree.rows[k]) for k in leaves]
    at = np.zeros(len(tree.letter), np.int64)
    at[leaves] = np.cumsum(size[leaves]) - size[leaves]
    flat = np.concatenate([tree.rows[k] for k in leaves])
    even = np.zeros(len(tree.letter), bool)  # leaves beyond the limit hold equal vectors only
    even[leaves] = size[leaves] > LEAF
    for begin in range(0, len(asked), WALK):
        q, leaf = tree.reached(vectors[begin : begin + WALK], add)
        q = q + begin
        known = even[leaf]
        apart = np.full(len(q), 1 + add)
        apart[known] = np.abs(vectors[q[known]] - points[flat[at[leaf[known]]]]).sum(axis=1)
        q, leaf = q[apart == 1 + add], leaf[apart == 1 + add]
        order = np.argsort(q, kind="stable")
        q, leaf = q[order], leaf[order]
        total = np.cumsum(size[leaf])
        found, k = [], 0
        step = max(COMPARE // wanted.shape[1], 1)
        while k < len(q):
            end = max(int(np.searchsorted(total, (total[k - 1] if k else 0) + step, side="right")), k + 1)
            n = size[leaf[k:end]]
            i = np.repeat(q[k:end], n)
            j = flat[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[leaf[k:end]], n)]
            near = one_edit(wanted[i], letters[j])
            found.append((i[near], j[near]))
            k = end
        if found:
            yield tuple(np.concatenate(x) for x in zip(*found))


def _best(own: np.ndarray, other: np.ndarray, names: list[str], others: list[str], n: np.ndarray) -> dict:
    """For each of own: how many others it has, and of those the one of largest n (ties: the first; others are sorted)."""
    order = np.lexsort((other, -n[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return {"word": [names[k] for k in own[first]], "k": np.diff(np.append(first, len(own))), "best_n": n[other[first]], "best": [others[k] for k in other[first]]}


def _search(block: pd.DataFrame) -> pd.DataFrame:
    """Near words inside a block: those of its cell (asked = 0) and those that reach it (1: as long, 2: one longer)."""
    out = [pd.DataFrame({"word": pd.Series(dtype=str), "k": pd.Series(dtype="int64"), "best_n": pd.Series(dtype="int64"), "best": pd.Series(dtype=str)})]
    side = {k: g.sort_values("word") for k, g in block.groupby("asked")}
    if 0 in side:
        words, n = side[0]["word"].tolist(), side[0]["n"].to_numpy()
        points = letter_counts(words)
        for k in (1, 2):
            if k in side:
                asked, m = side[k]["word"].tolist(), side[k]["n"].to_numpy()
                for i, j in near_pairs(words, points, asked, letter_counts(asked)):
                    out.append(pd.DataFrame(_best(i, j, asked, words, n)))
                    if k == 2:  # words of a length ask each other, those of other lengths only one way
                        out.append(pd.DataFrame(_best(j, i, words, asked, m)))
    return pd.concat(out)


def _dealt(trees: dict[int, KdTree]):
    """Rows (size, cell, asked, word, n): a word in its own cell, and in all cells that it asks."""

    def rows(words: list[str], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        vectors, length = letter_counts(words), np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(length).tolist():
            own = np.flatnonzero(length == size)
            for asked, target in ((0, size), (1, size), (2, size - 1)):
                if target in trees:
                    i, cell = (x for x in trees[target].reached(vectors[own], asked % 2))
                    if not asked:
                        i, cell = _own_cell(trees[target], vectors[own])
                else:
                    i, cell = np.arange(len(own)), np.zeros(len(own), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), target), pa.int32()), pa.array(cell, pa.int32()), pa.array(np.full(len(i), asked), pa.int32()), pa.array([words[k] for k in own[i]], pa.string()), pa.array(n[own[i]], pa.int64())], ["size", "cell", "asked", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield from rows(batch.column(0).to_pylist(), batch.column(1).to_numpy())

    return run


def _own_cell(tree: KdTree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    node = np.zeros(len(vectors), np.int64)
    while (inner := tree.letter[node] >= 0).any():
        k = node[inner]
        node[inner] = np.where(vectors[inner, tree.letter[k]] <= tree.cut[k], tree.left[k], tree.right[k])
    return np.arange(len(vectors)), node


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best, best_n of the words that have a near one: how many, and of those the one of largest n (ties: the
    smallest in code-point order).

    words: word (distinct, of Latin-1 characters), n. Near: exactly one code point inserted, deleted or replaced.
    """
    words = kept(words.select("word", F.col("n").cast("long").alias("n")).where(F.length("word") > 0), "words")
    total = words.count()
    sample = [r["word"] for r in words.select("word").orderBy(F.xxhash64("word"), "word").limit(SAMPLE).collect()]
    trees = {}
    for size in {len(w) for w in sample}:
        own = [w for w in sample if len(w) == size]
        trees[size] = KdTree(letter_counts(own), max(CELL * len(sample) // max(total, 1), 1))
        trees[size].rows = trees[size].points = None  # only the cuts are sent
    dealt = kept(words.mapInArrow(_dealt(trees), "size int, cell int, asked int, word string, n long"), "dealt")
    place = ["size", "cell"]
    salts = lambda own: F.ceil(F.count_if(own) / BLOCK).cast("int")
    sizes = dealt.groupBy(*place).agg(salts(F.col("asked") == 0).alias("d"), salts(F.col("asked") > 0).alias("q")).where("d > 0 and q > 0")
    rows = dealt.join(sizes, place)
    lot = lambda c: F.array(F.pmod(F.xxhash64("word"), F.col(c)).cast("int"))
    each = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    is_data = F.col("asked") == 0
    rows = rows.withColumn("d", F.explode(F.when(is_data, lot("d")).otherwise(each("d")))).withColumn("q", F.explode(F.when(is_data, each("q")).otherwise(lot("q"))))
    found = rows.groupBy(*place, "d", "q").applyInPandas(_search, "word string, k long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def spelling_groups(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of words (word, n).

    form: the near word of largest n, if that is at least `times` the word's own n, else null; root: where following
    forms ends, the word itself without one. No near words give n_near 0. A form's n is larger than its word's, so
    chains end and are short; an empty table gives an empty result.
    """
    words = kept(words.select("word", "n"), "words")
    own = words.join(near_words(words), "word", "left")
    good = F.col("best_n") >= times * F.col("n")
    own = kept(own.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "forms")
    chain = kept(own.where("form is not null").select("word", F.col("form").alias("root")), "chain")
    while True:  # each round doubles the steps that have been followed
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = kept(chain.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chain")
        chain = new.select("word", "root")
        if new.where("moved").isEmpty():
            break
    return own.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
