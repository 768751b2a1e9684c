"""Exact top-k search by inner product with MaxScore.

A dimension is a term; a row posts its component there, and what a query can gain from a term
is bounded by its weight times the largest component of the shard in the weight's direction.
Terms whose bounds together stay below the query's threshold are non-essential: a row that
gains from these alone cannot be among the best. So a shard adds up the postings of the
essential terms, and probes the other terms one by one only for rows that can still compete.
The lists of the shards are merged. A first pass over a small part of the rows gives each
query a threshold to start from: the k-th best score there, which the k-th best of all reaches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import table
from tidewatch.llm.vectors import by_width, finite, largest, scaled
from tidewatch.plans.materialize import written


@dataclass(frozen=True)
class Search:
    """k: rows wanted for a query. scale: vectors are taken in steps of 1 / scale. every: rows
    whose id it divides are the queries. queries: about how many of them go over the rows in
    one pass, which bounds what tasks hold of them. shard: rows that share score bounds.
    first: one row in so many is in the first pass."""

    k: int = 20
    scale: int = 64
    every: int = 20
    queries: int = 8192
    shard: int = 2048
    first: int = 16


_LAST = (1 << 63) - 1
_NONE = -(1 << 63)


class Best:
    """The best rows so far of each query; ties go to the smaller id, null ids last."""

    def __init__(self, k: int, floor: np.ndarray, floor_id: np.ndarray):
        self.k, self.floor, self.floor_id = k, floor, floor_id
        self.query = np.zeros(0, np.int64)
        self.score, self.rank, self.known = self.query, self.query, self.query

    def add(self, query: np.ndarray, score: np.ndarray, rank: np.ndarray, known: np.ndarray) -> None:
        """Take in rows; ``rank`` is the id, ``known`` 1 where it is not null."""
        floor = self.floor[query]
        use = (score > floor) | ((score == floor) & (rank <= self.floor_id[query]))
        if not use.any():
            return
        parts = zip((self.query, self.score, self.rank, self.known), (query, score, rank, known))
        query, score, rank, known = (np.concatenate([old, new[use]]) for old, new in parts)
        order = np.lexsort((-known, rank, ~score, query))  # ~ falls as the score rises, also at the ends
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[place < self.k]
        self.query, self.score, self.rank, self.known = query[place < self.k], score[order][place < self.k], rank[kept], known[kept]
        last = place == self.k - 1
        self.floor[query[last]] = score[order][last]
        self.floor_id[query[last]] = rank[order][last]


def bounds(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Most that each query can gain from each term among the rows; never below 0."""
    top, bottom = np.maximum(rows.max(axis=0), 0), np.minimum(rows.min(axis=0), 0)
    return np.where(weights > 0, weights * top, weights * bottom)


def competitive(weights: np.ndarray, rows: np.ndarray, floor: np.ndarray):
    """(query, row, score) of all rows whose score reaches the query's floor."""
    gain = bounds(weights, rows)
    order = np.argsort(gain, axis=1, kind="stable")
    rising = np.cumsum(np.take_along_axis(gain, order, axis=1), axis=1)
    spare = rising < floor[:, None]  # the smallest bounds, together below the floor
    n_spare = spare.sum(axis=1)
    essential = np.ones(weights.shape, bool)
    np.put_along_axis(essential, order, ~spare, axis=1)
    scores = (weights * essential) @ rows.T
    rest = np.where(n_spare > 0, np.take_along_axis(rising, np.maximum(n_spare - 1, 0)[:, None], axis=1)[:, 0] if weights.shape[1] else 0, 0)
    query, row = np.nonzero(scores + rest[:, None] >= floor[:, None])
    score, left = scores[query, row], rest[query]
    done_query, done_row, done_score = [], [], []
    step = n_spare[query] - 1  # the greatest bound among the terms not yet probed
    while len(query):
        ended = step < 0
        if ended.any():
            done_query.append(query[ended])
            done_row.append(row[ended])
            done_score.append(score[ended])
            query, row, score, left, step = (a[~ended] for a in (query, row, score, left, step))
        term = order[query, step]
        score = score + weights[query, term] * rows[row, term]
        left = left - gain[query, term]
        step = step - 1
        able = score + left >= floor[query]
        query, row, score, left, step = (a[able] for a in (query, row, score, left, step))
    if not done_query:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(done_query), np.concatenate(done_row), _whole(np.concatenate(done_score))


def _whole(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit numbers; the nearest of them for what lies beyond."""
    if scores.dtype == object:
        return np.array([min(max(int(s), _NONE), _LAST) for s in scores], np.int64)
    return scores.astype(np.int64)


def _exact(*matrices: np.ndarray) -> list[np.ndarray]:
    """The matrices in a type in which sums of their products are exact."""
    most = math.prod(largest(m) for m in matrices) * max(1, matrices[0].shape[1])
    kind = np.float64 if most < 1 << 52 else np.int64 if most < 1 << 62 else object
    return [m.astype(kind) for m in matrices]


def search_udf(queries: pa.Table, how: Search):
    """Task function: rows (key, vec_id, x) in, the best of them for each query out.

    ``queries``: key, x, floor and floor_id of one block of queries.
    """
    known_keys = np.asarray(queries.column("key"))
    floors, floor_ids = (np.asarray(queries.column(c)).astype(np.int64) for c in ("floor", "floor_id"))
    weights = {width: (at, x) for width, at, x in by_width(queries.column("x").combine_chunks())} if len(queries) else {}

    def task(batches):
        best = Best(how.k, floors.copy(), floor_ids.copy())
        for batch in batches:
            keys, ids = np.asarray(batch.column(0)), batch.column(1)
            known = np.asarray(ids.is_valid()).astype(np.int64)
            ids = np.asarray(ids.cast(pa.int64()).fill_null(_LAST))
            for width, at, x in by_width(batch.column(2)):
                if width not in weights:
                    continue
                places, w = weights[width]
                for first in range(0, len(at), how.shard):
                    own = at[first : first + how.shard]
                    rows = x[first : first + how.shard]
                    for begin in range(0, len(places), 512):
                        some = places[begin : begin + 512]
                        q, r = _exact(w[begin : begin + 512], rows)
                        floor = best.floor[some].astype(q.dtype)  # floats hold 2 ** 63 exactly
                        if q.dtype == object:
                            floor[floor == _NONE] = -(10**60)  # no floor: below all products
                        query, row, score = competitive(q, r, floor)
                        query, row = some[query], own[row]
                        other = known_keys[query] != keys[row]
                        query, row = query[other], row[other]
                        best.add(query, score[other], ids[row], known[row])
        valid = best.known > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(known_keys[best.query]), pa.array(best.rank, mask=~valid), pa.array(best.score)],
            names=["key", "vec_id", "score"],
        )

    return task


_SCHEMA = "key long, vec_id long, score long"


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of each query key, with their rank."""
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, how: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id and score: the best rows for each query row, by inner product.

    Queries are the rows whose vec_id ``every`` divides; candidates all rows but the query's
    own, so a repeated row is a candidate of its other copies and a query of its own. Vectors
    meet those of their width only; null vectors and those with null or non-finite components
    take no part, a row with a null id is a candidate and comes last among ties. Components
    and scores beyond 64 bits count as the nearest such number.
    """
    rows = written(
        vectors.filter(finite(F.col("embedding"))).select(
            F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long").alias("vec_id"),
            scaled(F.col("embedding"), how.scale).alias("x"),
        ), "searched-vectors",
    )
    asked = rows.filter(F.col("vec_id") % how.every == 0)
    blocks = max(1, -(-asked.count() // how.queries))
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")), "search-queries")
    some = rows.filter(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(how.first)) == 0)
    found = []
    for block in range(blocks):
        own = asked.filter(F.col("block") == block).select("key", "x")
        none = own.withColumns({"floor": F.lit(_NONE), "floor_id": F.lit(_LAST)})
        start = some.mapInArrow(search_udf(none.toArrow(), how), _SCHEMA)
        last = best_of(start, how.k).filter(F.col("rank") == how.k)
        last = last.select("key", F.col("score").alias("floor"), F.coalesce("vec_id", F.lit(_LAST)).alias("floor_id"))
        queries = own.join(written(last, "search-floors"), "key", "left").na.fill({"floor": _NONE, "floor_id": _LAST})
        lists = rows.mapInArrow(search_udf(queries.toArrow(), how), _SCHEMA)  # one block of queries
        found.append(written(best_of(lists, how.k), "search-lists"))
    names = asked.select("key", F.col("vec_id").alias("query_id"))
    every = reduce(DataFrame.unionByName, found)
    return every.join(names, "key").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(c AS DOUBLE)) AS DOUBLE) FOR c IN embedding] AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
