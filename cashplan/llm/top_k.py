"""Exact top-k search by inner product in three phases with a uniform threshold (TPUT, Cao and Wang 2004).

A score is the sum of a few lists' partial scores, a list being a slice of the dimensions.

1. Each list of each task hands in its locally best entries, with their whole scores. The k-th best of those is a
   safe cutoff: the true k-th best is no lower.
2. The cutoff is broadcast. An entry whose sum reaches it has a partial score of at least cutoff / lists in some list,
   so each list collects its entries from there on, and these suffice.
3. The collected entries' scores are resolved exactly, and the best k of each task are merged.

A task passes its rows in batches and keeps the best entries so far, so what it hands on does not grow with its rows.

Queries go out in blocks of fixed size, so that what is broadcast is bounded; all rows pass each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashplan.llm.common import slices
from cashplan.session import written

SCALE = 256
LISTS = 2
QUERIES_PER_BLOCK = 2048
ROWS_AT_ONCE = 1024
_LOWEST = np.iinfo(np.int64).min


def whole(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vector``, rows that are null or hold a null or non-finite component left out."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where("vec_id IS NOT NULL").where(x.isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("vector")
    )


def _rows(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """The vectors as whole numbers; shorter ones end in zeros."""
    out = np.zeros((len(vectors), width))
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    return np.floor(SCALE * out)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products; by doubles where those hold them exactly."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2**53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a @ b.T).astype(np.int64)


class Block:
    """Queries, with their cutoffs once there are any."""

    def __init__(self, ids: list[int], vectors: list[list[float]]):
        self.ids = np.array(ids, np.int64)
        self.width = max(map(len, vectors), default=0)
        self.vectors = _rows(vectors, self.width)
        self.cutoff = np.full(len(ids), _LOWEST)

    def partial(self, batch: pa.RecordBatch, lists: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Ids in ascending order, and each list's scores (query, row)."""
        ids = batch.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        values = [np.asarray(v, float) for v in batch.column("vector").to_pylist()]
        width = max(self.width, max(map(len, values)))
        rows = _rows(values, width)[order]
        queries = np.pad(self.vectors, ((0, 0), (0, width - self.width)))
        cuts = [width * i // lists for i in range(lists + 1)]
        return ids[order], [
            _product(queries[:, a:b], rows[:, a:b]) for a, b in zip(cuts, cuts[1:], strict=False)
        ]


def _best(query: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k entries of each query, by score, then by id."""
    order = np.lexsort((vec_id, -score, query))
    query = query[order]
    rank = np.arange(len(order)) - np.searchsorted(query, query)
    return order[rank < k]


def _entries(ids, query, vec_id, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[query]), pa.array(vec_id), pa.array(score)], ["query_id", "vec_id", "score"]
    )


class Best:
    """The first k entries of each query so far, by the first of their scores, then by id."""

    def __init__(self, k: int):
        self.k = k
        self.query, self.vec_id, *self.scores = [np.zeros(0, np.int64)] * 4

    def add(self, query: np.ndarray, vec_id: np.ndarray, by: np.ndarray, score: np.ndarray) -> None:
        mine = (self.query, self.vec_id, *self.scores)
        query, vec_id, by, score = map(np.concatenate, zip(mine, (query, vec_id, by, score), strict=True))
        kept = _best(query, by, vec_id, self.k)
        self.query, self.vec_id, self.scores = query[kept], vec_id[kept], [by[kept], score[kept]]


def _local_lists(shared, lists: int, k: int):
    """Phase 1: the best entries of each list, with their whole scores."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, found = shared.value, [Best(k) for _ in range(lists)]
        for batch in slices(batches, ROWS_AT_ONCE):
            ids, partial = block.partial(batch, lists)
            total = sum(partial)
            others = block.ids[:, None] != ids[None, :]
            n = min(k + 1, len(ids))
            for best, scores in zip(found, partial, strict=True):
                row = np.argpartition(-scores, n - 1, axis=1)[:, :n].ravel()
                query = np.repeat(np.arange(len(block.ids)), n)
                query, row = query[mine := others[query, row]], row[mine]
                best.add(query, ids[row], scores[query, row], total[query, row])
        for best in found:
            yield _entries(block.ids, best.query, best.vec_id, best.scores[1])

    return gather


def _sufficient(shared, lists: int, k: int):
    """Phases 2 and 3: the entries from the cutoff on, resolved."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = shared.value, Best(k)
        cutoff = block.cutoff[:, None]
        least = np.where(cutoff == _LOWEST, _LOWEST, -(-cutoff // lists))
        for batch in slices(batches, ROWS_AT_ONCE):
            ids, partial = block.partial(batch, lists)
            query, row = np.nonzero(reduce(np.logical_or, [scores >= least for scores in partial]))
            score = sum(scores[query, row] for scores in partial)
            kept = np.flatnonzero((score >= block.cutoff[query]) & (block.ids[query] != ids[row]))
            query, row, score = query[kept], row[kept], score[kept]
            best.add(query, ids[row], score, score)
        yield _entries(block.ids, best.query, best.vec_id, best.scores[1])

    return collect


def _ranked(entries: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    lists: int = LISTS,
    per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's k highest scores among ``vectors``.

    Both tables are ``vec_id`` and ``vector`` (see ``whole``). A component x counts as floor(256 * x); vectors of different
    lengths are compared as if the shorter one ended in zeros. Equal scores go to the smaller vec_id. Rows with the
    query's own vec_id are no candidates. A vec_id that repeats counts once as a query (its least vector), and with each of
    its rows as a candidate. With fewer candidates than k all come back; empty tables give empty ones.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score long"
    asked = written(queries.groupBy("vec_id").agg(F.min("vector").alias("vector")))
    blocks = max(1, -(-asked.count() // per_block))
    found = []
    for i in range(blocks):
        # a hash deals the queries out, so that a block holds about as many as it should
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id").collect()
        block = Block([row.vec_id for row in rows], [row.vector for row in rows])
        local = vectors.mapInArrow(_local_lists(spark.sparkContext.broadcast(block), lists, k), schema)
        cutoffs = _ranked(local.distinct(), k).where(F.col("rank") == k)
        at = {query: j for j, query in enumerate(block.ids.tolist())}
        for row in cutoffs.select("query_id", "score").collect():
            block.cutoff[at[row.query_id]] = row.score
        found.append(vectors.mapInArrow(_sufficient(spark.sparkContext.broadcast(block), lists, k), schema))
    return _ranked(reduce(DataFrame.unionByName, found), k).select("query_id", "rank", "vec_id", "score")
