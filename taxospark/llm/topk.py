"""Exact top-k search by integer inner product, with block-at-a-time pruning.

Vectors are dealt into blocks of neighbouring document ranges (ordered by their nearest pivot, then id). A block keeps
its forward index (the vectors) and, for each term (dimension), the largest and smallest value in it. For a query the
sum of the best term contributions bounds every score in a block; blocks are visited by falling bound, scored through
their forward index, and left as soon as the bound is below the k-th score so far. Queries and blocks meet in tiles of
bounded size, so no task holds all of either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept

BLOCK_ROWS, PIVOTS = 256, 64
#: A tile: this many blocks against this many queries.
TILE_BLOCKS, TILE_QUERIES = 128, 1024
_BLOCK = "n int, ids binary, vectors binary, dims int"


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component as a double; null for vectors that are null or hold null, NaN or infinity."""
    good = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    # A product beyond the range of doubles is clipped to it, so that floor() has a value.
    return F.when(good, F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * factor, F.lit(9e18)), F.lit(-9e18))).cast("double")))


def _padded(rows: list, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _cut(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            if not rows:
                continue
            dims = max(max(map(len, rows)), pivots.shape[1])
            v = _padded(rows, dims)
            wide = np.zeros((len(pivots), dims))
            wide[:, : pivots.shape[1]] = pivots
            near = np.argmin((wide * wide).sum(axis=1) - 2 * v @ wide.T, axis=1) if len(wide) else np.zeros(len(v), np.int64)
            order = np.lexsort((ids, near))
            out = []
            for a in range(0, len(order), BLOCK_ROWS):
                own = order[a : a + BLOCK_ROWS]
                out.append({"n": len(own), "ids": ids[own].astype(np.int64).tobytes(), "vectors": v[own].tobytes(), "dims": dims})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("dims", pa.int32())]))

    return run


def _exact_scores(block: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products as integers: in doubles while those are exact, else with Python's integers, kept in 64 bits."""
    top = np.abs(block).max(initial=0) * np.abs(queries).max(initial=0) * block.shape[1]
    if top < 2**53:
        return (block @ queries.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in block], object) @ np.array([[int(x) for x in r] for r in queries], object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def search_tile(blocks: list[tuple[np.ndarray, np.ndarray]], query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score): the k best of the tile's blocks for each query, ties to smaller ids."""
    high = np.stack([v.max(axis=0) for _, v in blocks])
    low = np.stack([v.min(axis=0) for _, v in blocks])
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = up @ high.T + down @ low.T
    slack = np.abs(bounds).max(initial=0) * 1e-12  # rounding of very large values only widens a bound
    bounds = bounds + (slack if slack > 1 else 0)
    order = np.argsort(-bounds, axis=1, kind="stable")
    out_ids = [np.zeros(0, np.int64)] * len(queries)
    out_scores = [np.zeros(0, np.int64)] * len(queries)
    active = np.arange(len(queries))
    for step in range(len(blocks)):
        still = [q for q in active if len(out_scores[q]) < k or bounds[q, order[q, step]] >= out_scores[q][-1]]
        if not still:
            break
        active = np.array(still)
        turn = order[active, step]
        for b in np.unique(turn):
            rows = active[turn == b]
            ids, vectors = blocks[b]
            scores = _exact_scores(vectors, queries[rows])
            for j, q in enumerate(rows):
                other = ids != query_ids[q]
                s = np.concatenate([out_scores[q], scores[other, j]])
                i = np.concatenate([out_ids[q], ids[other]])
                top = np.lexsort((i, -s))[:k] if len(s) else np.zeros(0, np.int64)
                out_scores[q], out_ids[q] = s[top], i[top]
    return [(int(query_ids[q]), int(i), int(s)) for q in range(len(queries)) for i, s in zip(out_ids[q], out_scores[q])]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256) -> DataFrame:
    """For each query its k highest scores over all other vectors: query_id, rank (from 1), vec_id, score.

    Ties go to the smaller id; fewer candidates give fewer rows. Vectors that are null or hold null or non-finite
    components take no part on either side, nor do rows with a null id. A shorter vector counts as padded with zeros.
    Rows that repeat an id take part once each as candidates, and once together as a query. Empty tables give an empty
    result; further columns are ignored.
    """
    def usable(df: DataFrame) -> DataFrame:
        return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col), factor).alias("v")).where(F.col("v").isNotNull())

    rows = usable(vectors)
    # A bounded sample of pivots orders the vectors; it has no influence on the result.
    chosen = [r["v"] for r in rows.orderBy(F.xxhash64("id")).limit(PIVOTS).select("v").collect()]
    pivots = _padded(chosen, max(map(len, chosen), default=0)) if chosen else np.zeros((0, 0))
    blocks = kept(rows.mapInArrow(_cut(pivots), _BLOCK), "blocks")
    asked = kept(usable(queries).dropDuplicates(["id"]), "queries")
    b_tiles = -(-blocks.count() // TILE_BLOCKS) or 1
    q_tiles = -(-asked.count() // TILE_QUERIES) or 1
    dealt_b = blocks.withColumn("bt", F.pmod(F.xxhash64("ids"), F.lit(b_tiles).cast("long"))).withColumn("qt", F.explode(F.sequence(F.lit(0), F.lit(q_tiles - 1))))
    dealt_q = asked.withColumn("qt", F.pmod(F.xxhash64("id"), F.lit(q_tiles)).cast("int")).withColumn("bt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(b_tiles - 1).cast("long"))))

    def tile(b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(b) and len(q):
            dims = max(int(b["dims"].max()), max(map(len, q["v"])))
            own = []
            for ids, raw, d, n in zip(b["ids"], b["vectors"], b["dims"], b["n"]):
                v = np.zeros((n, dims))
                v[:, :d] = np.frombuffer(raw).reshape(n, d)
                own.append((np.frombuffer(ids, np.int64), v))
            found = search_tile(own, q["id"].to_numpy(np.int64), _padded(list(q["v"]), dims), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    parts = dealt_b.groupBy("bt", "qt").cogroup(dealt_q.groupBy("bt", "qt")).applyInPandas(tile, "query_id long, vec_id long, score long")
    ranked = parts.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)")).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
