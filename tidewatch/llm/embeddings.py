"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with a cosine of c or more are within D of each other, D squared = 2 (1 - c).
After a random rotation the coordinates are split into blocks; if two vectors are within D,
some block has at most its proportional part of D squared. So each block is range-joined on a
grid (a vector is sent to every cell that its range touches), and the union of candidates is
verified on whole vectors in double precision. Equal vectors are one class throughout.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import components, mixed, table
from tidewatch.plans.materialize import written


@dataclass(frozen=True)
class Near:
    """block: coordinates of a block; grid: how many of them its cells are made of."""

    cosine: float = 0.98
    block: int = 8
    grid: int = 4
    seed: int = 7


@cache
def rotation(dim: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))[0]


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector can link at all."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x.isNotNull() & (x != 0))
    return F.coalesce(label.isNotNull() & finite & some, F.lit(False))


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, float)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells(classes: DataFrame, how: Near) -> DataFrame:
    """Rows (k, probe, cid, x0, x1, ...): the block coordinates of a class, once in its own cell
    and, as probes, in each cell that its range touches."""
    names = [f"x{i}" for i in range(how.block)]
    slack = 1e-5  # coordinates travel as floats

    def rows(batches):
        for batch in batches:
            cid, label = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1))
            vectors = batch.column(2).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                x = _unit([vectors[i] for i in own]) @ rotation(int(dim), how.seed)
                for block, first in enumerate(range(0, int(dim), how.block)):
                    part = x[:, first : first + how.block]
                    reach = np.sqrt(2 * (1 - how.cosine) * part.shape[1] / dim) + slack
                    grid = part[:, : how.grid]
                    base = mixed(label[own].astype(np.uint64) * np.uint64(1 << 20) + np.uint64(int(dim) << 10) + np.uint64(block))

                    def key(at: np.ndarray) -> np.ndarray:
                        h = base.copy()
                        for c in at.astype(np.int64).view(np.uint64).T:
                            h = mixed(h * np.uint64(31) + c)
                        return h.view(np.int64)

                    low, high = (np.floor((grid + s * reach) / (2 * reach)) for s in (-1, 1))
                    columns = np.zeros((how.block, len(own)), np.float32)
                    columns[: part.shape[1]] = part.T
                    sent = [(key(np.floor(grid / (2 * reach))), np.ones(len(own), bool), False)]
                    for corner in product((False, True), repeat=grid.shape[1]):
                        corner = np.array(corner)
                        # Where both ends lie in one cell the vector goes there once.
                        new = (~corner | (high != low)).all(axis=1)
                        sent.append((key(np.where(corner, high, low)), new, True))
                    for k, new, probe in sent:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(k[new]), pa.array(np.full(int(new.sum()), probe)), pa.array(cid[own][new]),
                             pa.array(np.full(int(new.sum()), np.float32((reach + slack) ** 2))),
                             *(pa.array(c[new]) for c in columns)],
                            names=["k", "probe", "cid", "reach", *names],
                        )

    schema = "k long, probe boolean, cid long, reach float, " + ", ".join(f"{n} float" for n in names)
    return classes.select("cid", F.col("label").cast("long").alias("label"), "embedding").mapInArrow(rows, schema)


def candidates(classes: DataFrame, how: Near) -> DataFrame:
    """Distinct pairs (a, b) of classes that are within range in some block."""
    names = [f"x{i}" for i in range(how.block)]
    sent = written(cells(classes, how), "cells")
    home = sent.filter("not probe").select("k", F.col("cid").alias("a"), "reach", *names)
    probe = sent.filter("probe").select(F.col("k").alias("pk"), F.col("cid").alias("b"), *[F.col(n).alias(f"p{n}") for n in names])
    apart = sum(((F.col(n) - F.col(f"p{n}")) * (F.col(n) - F.col(f"p{n}")) for n in names), F.lit(0.0))
    near = (F.col("k") == F.col("pk")) & (F.col("a") < F.col("b")) & (apart <= F.col("reach"))
    return home.join(probe, near).select("a", "b").distinct()


def _cosines(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosines of paired vectors of equal lengths, in double precision."""
    out = np.zeros(len(a))
    for first in range(0, len(a), 1024):
        u, v = (np.asarray(c.slice(first, 1024).flatten(), float) for c in (a, b))
        sizes = np.asarray(a.slice(first, 1024).value_lengths())
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        # Scaled first, so that squares neither vanish nor overflow.
        u = u / np.repeat(np.maximum.reduceat(np.abs(u), at), sizes)
        v = v / np.repeat(np.maximum.reduceat(np.abs(v), at), sizes)
        dot, uu, vv = (np.add.reduceat(x, at) for x in (u * v, u * u, v * v))
        out[first : first + 1024] = dot / np.sqrt(uu * vv)
    return pa.array(out)


def linked(classes: DataFrame, how: Near) -> DataFrame:
    """Pairs (a, b) of classes whose cosine is at least the given one."""
    cosines = F.arrow_udf(_cosines, "double")
    one = classes.select(F.col("cid").alias("a"), F.col("label").alias("la"), F.col("embedding").alias("ea"))
    two = classes.select(F.col("cid").alias("b"), F.col("label").alias("lb"), F.col("embedding").alias("eb"))
    pairs = candidates(classes, how).join(one, "a").join(two, "b").filter("la = lb and size(ea) = size(eb)")
    return pairs.withColumn("cosine", cosines("ea", "eb")).filter(F.col("cosine") >= how.cosine).select("a", "b")


def near_vectors(vectors: DataFrame, how: Near = Near()) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    A vector that is null, empty, zero, or has null or non-finite components, or whose label
    is null, links with nothing: it has no links and is its own component. Vectors of other
    lengths do not link. Repeated rows link with each other. component_id is the least vec_id
    that links reach, null ids passed over; kept is false for a null id.
    """
    rows = written(
        vectors.select("vec_id", "label", "embedding", usable(F.col("embedding"), F.col("label")).alias("ok")), "vectors"
    )
    classes = written(
        rows.filter("ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
        .withColumn("cid", F.monotonically_increasing_id()), "vector-classes",
    )
    edges = written(linked(classes, how), "vector-links")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("cid").alias("b"), "n")
    others = both.join(sizes, "b").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "cid")
    found = components(edges).withColumnRenamed("node", "cid")
    member = classes.join(others, "cid", "left").join(found, "cid", "left")
    member = member.withColumn("root", F.coalesce("root", "cid")).withColumn(
        "n_links", F.col("n") - 1 + F.coalesce("others", F.lit(0))
    )
    roots = member.groupBy("root").agg(F.min("least").alias("component_id"))
    known = member.join(roots, "root").select("label", "embedding", "n_links", "component_id")
    linked_rows = rows.filter("ok").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
