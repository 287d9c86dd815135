"""Approximate nearest neighbours by collision counting.

Largest inner product becomes nearest distance: vectors are scaled by the largest norm and
lifted onto the unit sphere by one more coordinate. A shard keeps, for each of a number of
random projections, its vectors sorted by projected value. A query opens a window around
its own value in every array and widens all of them step by step (virtual rehashing). A vector
that has been inside enough windows is verified by its true inner product. The search
ends when as many verified vectors as are wanted lie within the radius that the windows
stand for, or when the windows hold the whole shard. Nothing limits how many are verified.

Null, zero and non-finite vectors and null ids take no part; vectors are compared within their own
length, scaled by the largest norm of the shard. Ties go to the smaller id. All rows that share the
query's id count as its own and are no candidates.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweave.llm.vectors import blocks, dealt, layout, meet, unpack, usable_rows
from newsweave.session import write_out

PROJECTIONS = 40
# Half a window's width for a radius of 1, and the share of windows a vector has to be in.
HALF = 1.1
SHARE = 0.61
# Vectors of a shard whose best gives a query's first radius, the least of these, and how
# much wider each step is.
PROBED = 512
FIRST = 0.3
WIDER = 1.2
FOUND = "key long, query_id long, vec_id long, score double"


class Arrays:
    """The sorted projections of a shard."""

    def __init__(self, lifted: np.ndarray, seed: int = 1) -> None:
        drawn = np.random.default_rng(seed).standard_normal((lifted.shape[1], PROJECTIONS))
        self.directions, values = drawn, (lifted @ drawn).T
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(values, self.order, axis=1)

    def windows(self, projected: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and projection, where its window of the query's radius begins and ends."""
        low = np.empty(projected.shape, np.int64)
        high = np.empty(projected.shape, np.int64)
        for i, values in enumerate(self.values):
            low[:, i] = np.searchsorted(values, projected[:, i] - HALF * radius, "left")
            high[:, i] = np.searchsorted(values, projected[:, i] + HALF * radius, "right")
        return low, high


def nearest(
    ids: np.ndarray, vectors: np.ndarray, largest: float, keys: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, wanted: int
) -> list[tuple[int, int, int, float]]:
    """The nearest found in a shard for each query: (its key and id, id, inner product)."""
    scaled = vectors / largest
    lifted = np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1, keepdims=True)))])
    arrays = Arrays(lifted)
    lengths = np.linalg.norm(queries, axis=1)
    projected = (queries / lengths[:, None]) @ arrays.directions[:-1]
    size, need = len(ids), int(np.ceil(SHARE * PROJECTIONS))
    counts = np.zeros((len(queries), size), np.int16)
    scores = [np.zeros(0)] * len(queries)
    places = [np.zeros(0, np.int64)] * len(queries)
    before = None
    # Some vectors of the shard tell how near its nearest may be: the windows begin that wide.
    probe = np.arange(0, size, -(-size // PROBED))
    near = np.where(ids[probe] == query_ids[:, None], -np.inf, queries @ vectors[probe].T).max(axis=1)
    # On the unit sphere: distance^2 = 2 - 2 product.
    radii = np.maximum(FIRST, np.sqrt(2 - 2 * np.clip(near / (largest * lengths), -1, 1)))
    open_ = np.arange(len(queries))
    while len(open_):
        low, high = arrays.windows(projected[open_], radii[open_])
        still = []
        for at, query in enumerate(open_.tolist()):
            if before is None:
                parts = [own[a:b] for own, a, b in zip(arrays.order, low[at].tolist(), high[at].tolist(), strict=True)]
            else:
                old_low, old_high = before[0][at].tolist(), before[1][at].tolist()
                parts = [own[a:b] for own, a, b in zip(arrays.order, low[at].tolist(), old_low, strict=True)]
                parts += [own[a:b] for own, a, b in zip(arrays.order, old_high, high[at].tolist(), strict=True)]
            own = counts[query]
            passed = own >= need
            own += np.bincount(np.concatenate(parts), minlength=size).astype(np.int16)
            fresh = np.flatnonzero((own >= need) & ~passed & (ids != query_ids[query]))
            scores[query] = np.concatenate([scores[query], vectors[fresh] @ queries[query]])
            places[query] = np.concatenate([places[query], fresh])
            reach = (2 - radii[query] ** 2) / 2 * largest * lengths[query]
            whole = (low[at] == 0).all() and (high[at] == size).all()
            if not whole and (scores[query] >= reach).sum() < wanted:
                still.append(at)
        before = (low[still], high[still])
        open_ = open_[still]
        radii[open_] *= WIDER
    out = []
    for query, (found, where) in enumerate(zip(scores, places, strict=True)):
        best = np.lexsort((ids[where], -found))[:wanted]
        out += [(int(keys[query]), int(query_ids[query]), int(ids[where[b]]), float(found[b])) for b in best]
    return out


# Queries whose counts a task holds at once.
ROWS = 256


def search(embeddings: DataFrame, is_query: Column, wanted: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of each query's nearest vectors.

    A query row that repeats is searched once; an id with several vectors is a query for each of them.

    A shard returns its own nearest; one ranking per query over a bounded number of rows from
    each shard gives the result.
    """
    rows, _ = write_out(usable_rows(embeddings), "vectors")
    packed = rows.select(F.col("vec_id").alias("id"), F.lit(1).alias("weight"), F.col("embedding").alias("vector"), is_query.alias("asked"))
    places = layout(packed, F.col("asked"))
    shards = blocks(dealt(packed, places, "shard"))
    distinct = packed.where("asked").dropDuplicates(["id", "vector"])
    # Each query's key travels as its weight.
    keyed, _ = write_out(distinct.withColumn("weight", F.monotonically_increasing_id()), "queries")
    queries = blocks(dealt(keyed, places, "part"))

    def run(shard: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, float]] = []
        if len(shard) and len(part):
            ids, _, vectors = unpack(shard)
            largest = np.linalg.norm(vectors, axis=1).max()
            query_ids, keys, asked_vectors = unpack(part)
            for at in range(0, len(query_ids), ROWS):
                some = slice(at, at + ROWS)
                out += nearest(ids, vectors, largest, keys[some], query_ids[some], asked_vectors[some], wanted)
        return pd.DataFrame(out, columns=["key", "query_id", "vec_id", "score"])

    found = meet(shards, queries, places, run, FOUND)
    place = Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= wanted)
        .select("query_id", "rank", "vec_id", "score")
    )
