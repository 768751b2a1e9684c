"""Labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def labelled(rows: DataFrame, labels: DataFrame, label: str, train: Column, sample: int) -> DataFrame:
    """``rows`` with a column ``y``: at most ``sample`` rows of either label, and its ``weight``.

    The rows are those of least hash of their ids, so the choice follows no order of the
    input. An id whose labels disagree is left out; of rows that share an id one is taken. weight is how many rows one stands for.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_most"))
        .filter("y = _most and y in (0, 1)").drop("_most")
    )
    # Ids alone meet the labels; the rows themselves meet the chosen ids, which are few.
    ids = rows.filter(train).select("doc_id").distinct().join(known, "doc_id")
    counts = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = []
    for y in (0, 1):
        n = counts.get(y, 0)
        part = ids.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        parts.append(part.withColumn("weight", F.lit(float(n) / max(1, min(n, sample)))))
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    own = [c for c in rows.columns if c != "doc_id"]
    found = rows.join(chosen, "doc_id").groupBy("doc_id", "y", "weight").agg(F.min(F.struct(*own)).alias("_row"))
    return found.select("doc_id", "y", "weight", "_row.*")
