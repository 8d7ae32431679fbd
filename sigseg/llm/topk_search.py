"""Exact top-k inner-product search by the threshold algorithm.

Vectors are dealt into blocks of bounded size and queries into groups of
bounded size; every group meets every block (a stated query set against all
rows, in blocks). In a block each dimension has a list of the vectors sorted
by that component. A query walks all lists at once, from the end that its
weight favours, in growing steps; vectors that turn up are scored in full.
It stops when the bound, the score of a vector that would have the current
component of every list, is below the kth score so far. Ties at the kth score
keep it walking, so that the smaller vec_id wins.

No block looks for less than what k vectors are known to reach: every query is
first scored against a bounded sample of the vectors, which is broadcast.

Vectors that are null or hold null or non-finite components take no part, nor
do rows without a vec_id. Vectors are compared with queries of their own
length only. Rows that share a query's vec_id are no candidates for it; other
repeated rows are candidates each. Empty tables give empty results. Columns
other than vec_id and vector are not carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigseg.llm import textops as T

#: Vectors of a block, and queries of a group; the lists of a block are sorted once for each group.
BLOCK = 8192
GROUP = 8192
#: Entries of each list in the first step of a walk, and the factor from one step to the next.
FIRST_DEPTH, STEP = 8, 4
#: Vectors in the sample that gives the first bound.
SEEDS = 2048


def usable(vector: str | Column) -> Column:
    """Whether a vector takes part."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine, F.lit(False))


def quantize(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


class SortedLists:
    """The vectors of a block and, for each dimension, their order by that component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id].astype(np.float64)  # sums of integers below 2**53 are exact
        self.order = np.argsort(-self.vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.vectors, self.order, 0)
        self.scored = 0

    def top(self, own: int, query: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best with a score of ``floor`` at least."""
        n, dims = self.vectors.shape
        unseen = np.ones(n, bool)
        left, up = n, query >= 0
        score, place = np.zeros(0), np.zeros(0, np.int64)
        depth, kth = 0, floor
        columns = np.arange(dims)
        while left:
            to = min(n, max(FIRST_DEPTH, STEP * depth))
            rows = np.arange(depth, to)[:, None]
            new = np.zeros(n, bool)
            new[self.order[np.where(up, rows, n - 1 - rows), columns]] = True
            met = np.flatnonzero(new & unseen)
            unseen[met] = False
            left -= len(met)
            got = self.vectors[met] @ query
            good = (got >= kth) & (self.ids[met] != own)
            score, place = np.concatenate([score, got[good]]), np.concatenate([place, met[good]])
            if len(score) > k:
                best = np.lexsort((place, -score))[:k]
                score, place = score[best], place[best]
            if len(score) == k:
                kth = max(kth, score.min())
            depth = to
            edge = np.where(up, self.sorted[to - 1], self.sorted[n - to])
            if edge @ query < kth:
                break
        self.scored += n - left
        best = np.lexsort((place, -score))
        return [(int(self.ids[place[i]]), int(score[i])) for i in best]


def topk_search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k best vectors of each query.

    Both tables have ``vec_id`` and ``vector`` (``array<bigint>`` of whole
    numbers). Ties go to the smaller vec_id.
    """
    table = vectors.filter("vec_id is not null").filter(usable("vector")).select("vec_id", F.size("vector").alias("dims"), "vector")
    asked = queries.filter("vec_id is not null").filter(usable("vector"))
    asked = asked.select(F.col("vec_id").alias("vec_id"), F.size("vector").alias("dims"), F.col("vector").alias("vector")).distinct()
    n = vectors.count()
    n_blocks = max(1, -(-n // BLOCK))
    n_groups = max(1, -(-queries.count() // GROUP))
    # blocks by a hash of the whole row and its place, so that repeated ids spread
    block = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int")
    rows = table.withColumn("block", block).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    def stack(pdf: pd.DataFrame) -> np.ndarray:
        return np.stack(pdf["vector"].to_numpy()) if len(pdf) else np.zeros((0, 0))

    # a sample of about SEEDS vectors by their hash, never more than twice that
    chosen = table.filter(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(max(1, n // SEEDS))) == 0).limit(2 * SEEDS).toPandas()
    sample = vectors.sparkSession.sparkContext.broadcast({int(d): (part["vec_id"].to_numpy(), np.stack(part["vector"].to_numpy()).astype(np.float64)) for d, part in chosen.groupby("dims")})

    def bounded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for want in frames:
            floor = np.full(len(want), -np.inf)
            for d, (ids, held) in sample.value.items():
                at = np.flatnonzero(want["dims"] == d)
                if len(at) and len(ids) > k:
                    scores = stack(want.iloc[at]).astype(np.float64) @ held.T
                    scores[want["vec_id"].to_numpy()[at][:, None] == ids[None, :]] = -np.inf
                    floor[at] = np.partition(scores, -k, axis=1)[:, -k]
            want["floor"] = floor
            yield want

    asked = asked.mapInPandas(bounded, T.with_fields(asked, "floor double"))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n_groups)).cast("int"))
    wanted = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def walk(want: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(want) and len(held):
            lists = SortedLists(held["vec_id"].to_numpy(), stack(held))
            for own, vector, floor in zip(want["vec_id"], want["vector"], want["floor"], strict=True):
                hits = lists.top(own, np.asarray(vector, np.float64), k, float(floor))
                found += [(own, vector, i, s) for i, s in hits]
        return pd.DataFrame(found, columns=["query_id", "vector", "vec_id", "score"])

    keys = ["dims", "group", "block"]
    hits = wanted.groupBy(keys).cogroup(rows.groupBy(keys)).applyInPandas(walk, "query_id bigint, vector array<bigint>, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
