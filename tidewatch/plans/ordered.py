"""Ordered per-key computations cut into bounded pieces.

``Window.partitionBy(key)`` puts a whole key into one task. Here a key is cut into chunks of
its order, each chunk is summarised, the few summaries are combined along the order, and
rows meet only the summary of their own chunk. No task ever holds more than one chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.plans.materialize import broadcast_if_small, fits_broadcast, written

# A chunk spans 2**20 positions; each further level joins 2**12 chunks, so the top level
# has at most 2**19 rows per key for any non-negative 64-bit position.
CHUNK_BITS = (20, 32, 44)


# Summaries that one task may order by itself; beyond it they are chunked in turn.
SUMMARY_ROWS = 1 << 19


def chunk_later_max(
    tops: DataFrame, keys: Sequence[str], bits: Sequence[int], limit: int = SUMMARY_ROWS
) -> DataFrame:
    """Per (key, chunk): the largest ``_top`` in all *later* chunks of the key.

    ``tops`` is a written table of ``_top`` per key and ``_chunk``. Columns: keys,
    ``_chunk``, ``_later`` (null in the last chunk).
    """
    levels, level = [tops], tops
    if tops.count() > limit:
        for low, high in zip(bits, bits[1:]):
            up = F.shiftright("_chunk", high - low).alias("_chunk")
            level = level.groupBy(*keys, up).agg(F.max("_top").alias("_top"))
            levels.append(level)

    def after(*group: str) -> Column:
        later = Window.partitionBy(*keys, *group).orderBy(F.desc("_chunk"))
        return F.max("_top").over(later.rowsBetween(Window.unboundedPreceding, -1))

    carry = levels[-1].select(*keys, "_chunk", after().alias("_later"))
    for i in range(len(levels) - 2, -1, -1):
        step = bits[i + 1] - bits[i]
        parent = carry.select(
            *keys, F.col("_chunk").alias("_parent"), F.col("_later").alias("_above")
        )
        inside = levels[i].withColumn("_parent", F.shiftright("_chunk", step))
        carry = (
            inside.withColumn("_near", after("_parent"))
            .join(parent, [*keys, "_parent"])
            .select(*keys, "_chunk", F.greatest("_near", "_above").alias("_later"))
        )
    return carry


def with_later_max(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    value: str,
    drop_below: float | None = None,
    bits: Sequence[int] = CHUNK_BITS,
    limit: int = SUMMARY_ROWS,
    tops: DataFrame | None = None,
) -> DataFrame:
    """Add ``_reach``: the largest ``value`` among the key's rows at or after this one.

    With ``drop_below`` = d, rows with ``value < _reach - d`` are removed; most of them go
    before the sort, by their chunk's summary alone. ``tops``, if the caller keeps it, is the
    written table of ``_top`` per key and ``_chunk``; it saves a pass over the rows and may
    count rows that are no longer in ``df``.
    """
    keys = list(keys)
    chunk = F.shiftright(seq, bits[0]).alias("_chunk")
    if tops is None:
        tops = written(df.groupBy(*keys, chunk).agg(F.max(value).alias("_top")), "chunk-max")
    later = chunk_later_max(tops, keys, bits, limit)
    # One row per chunk in both, so the written table's size is the carry's, too.
    if fits_broadcast(tops):
        later = F.broadcast(later)
    rows = df.withColumn("_chunk", chunk).join(later, [*keys, "_chunk"])
    if drop_below is not None:
        floor = F.col("_later") - drop_below
        rows = rows.filter(F.col("_later").isNull() | (F.col(value) >= floor))
    # Descending order with a growing frame is linear; an unbounded-following frame is not.
    within = Window.partitionBy(*keys, "_chunk").orderBy(F.desc(seq))
    here = F.max(value).over(within.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_reach", F.greatest(here, F.col("_later")))
    if drop_below is not None:
        rows = rows.filter(F.col(value) >= F.col("_reach") - drop_below)
    return rows.drop("_chunk", "_later")


def with_row_number(
    df: DataFrame, keys: Sequence[str], order: str, bucket: Column
) -> DataFrame:
    """Add ``_row``: position of the row within its key, from 0, exact.

    ``bucket`` must not decrease with ``order`` and bounds how many rows share one task.
    ``df`` should be a written table: it is read twice.
    """
    keys = list(keys)
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket")
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(
        *keys,
        "_bucket",
        F.coalesce(
            F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    return (
        rows.withColumn("_in", F.row_number().over(inside) - 1)
        .join(starts, [*keys, "_bucket"])
        .withColumn("_row", F.col("_start") + F.col("_in"))
        .drop("_bucket", "_start", "_in")
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], row: str, value: str, count: int, chunk_rows: int
) -> DataFrame:
    """Add ``_previous``: array of ``value`` from the ``count`` rows before each row.

    ``row`` is the dense position within the key. Each chunk borrows the last ``count`` rows
    of the chunk before it, so only ``count / chunk_rows`` of the data is copied. Rows with
    fewer predecessors are dropped.
    """
    if chunk_rows < count:
        raise ValueError("chunk_rows must be at least the number of previous rows")
    keys = list(keys)
    home = F.floor(F.col(row) / chunk_rows)
    is_tail = F.col(row) % chunk_rows >= chunk_rows - count
    chunks = F.when(is_tail, F.array(home, home + 1)).otherwise(F.array(home))
    spread = df.withColumn("_chunk", F.explode(chunks))
    frame = Window.partitionBy(*keys, "_chunk").orderBy(row).rowsBetween(-count, -1)
    return (
        spread.withColumn("_previous", F.collect_list(value).over(frame))
        .filter((F.col("_chunk") == home) & (F.size("_previous") == count))
        .drop("_chunk")
    )


# Positions of one search group, and searches that one task makes in it.
GROUP_BITS = 12
GROUP_SEARCHES = 1 << 20


def first_above(places: np.ndarray, values: np.ndarray, after: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each search the index of the first place beyond ``after`` whose value exceeds
    ``bound``, or the number of places; all searches go through the same doubling steps."""
    n = len(places)
    at = np.searchsorted(places, after, "right")
    tops = [values]
    while (1 << len(tops)) <= n:
        half = 1 << (len(tops) - 1)
        tops.append(np.maximum(tops[-1][:-half], tops[-1][half:]))
    for k in range(len(tops) - 1, -1, -1):
        fits = at + (1 << k) <= n
        low = np.zeros(len(at), bool)
        low[fits] = tops[k][at[fits]] <= bound[fits]
        at = np.where(low, at + (1 << k), at)
    return at


def _searched(
    elements: DataFrame, searches: DataFrame, keys: Sequence[str], group_bits: int, per_task: int
) -> DataFrame:
    """Searches (keys, _row, _group, _after, _bound) with ``_hit``, the first place of their
    group beyond ``_after`` with a larger ``_v``, or null. A group that very many rows search
    is given to several tasks."""
    group = [*keys, "_group"]
    loads = searches.groupBy(*group).agg((F.count(F.lit(1)) / F.lit(per_task)).cast("int").alias("_more"))
    loads = broadcast_if_small(written(loads, "search-loads"))
    own = elements.withColumn("_group", F.shiftright("_at", group_bits)).join(loads, group)
    own = own.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_more"))))
    asked = searches.join(loads, group)
    asked = asked.withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_more") + 1).cast("int"))
    # Other names on one side, as both may come from the same table.
    renamed = [F.col(c).alias(f"{c}_of") for c in (*group, "_part")]
    own = own.select(*renamed, "_at", "_v")
    asked = asked.select(*group, "_part", "_row", "_after", "_bound")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("_at")
        places, values = (left.column(c).to_numpy() for c in ("_at", "_v"))
        at = first_above(places, values, right.column("_after").to_numpy(), right.column("_bound").to_numpy())
        hit = np.append(places, -1)[at] if len(places) else np.full(len(at), -1)
        out = right.drop_columns(["_after", "_part"])
        return out.append_column("_hit", pa.array(hit, pa.int64(), mask=hit < 0))

    types = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*group, "_row", "_bound")) + ", _hit bigint"
    both = own.groupBy(*[f"{c}_of" for c in (*group, "_part")]).cogroup(asked.groupBy(*group, "_part"))
    return both.applyInArrow(search, schema)


def next_above(
    df: DataFrame,
    keys: Sequence[str],
    row: str,
    value: str,
    bound: str,
    group_bits: int = GROUP_BITS,
    per_task: int = GROUP_SEARCHES,
) -> DataFrame:
    """keys, ``_row`` and ``_next``: for each row the first later position of its key whose
    ``value`` exceeds the row's ``bound``; null where there is none.

    ``row`` is the dense position within the key; ``df`` should be a written table. The
    greatest value of each group of positions stands for the group one level up, so a row
    searches its own group, then groups of groups, and comes down to the one place.
    """
    keys = list(keys)
    last = df.agg(F.max(row)).first()[0]
    if last is None:
        return df.select(*keys, F.col(row).alias("_row"), F.lit(None).cast("bigint").alias("_next"))
    up = F.shiftright("_at", group_bits).alias("_at")
    levels = [df.select(*keys, F.col(row).cast("bigint").alias("_at"), F.col(value).cast("double").alias("_v"))]
    while last >> (group_bits * len(levels)):
        top = levels[-1].groupBy(*keys, up).agg(F.max("_v").alias("_v"))
        levels.append(written(top, "group-max"))
    names = [*keys, "_row", "_bound"]
    left = df.select(*keys, F.col(row).cast("bigint").alias("_row"), F.col(bound).cast("double").alias("_bound"))
    left = left.withColumn("_after", F.col("_row"))
    found = []
    for elements in levels:
        asked = left.select(*names, F.shiftright("_after", group_bits).alias("_group"), "_after")
        got = written(_searched(elements, asked, keys, group_bits, per_task), "group-search")
        found.append(got.filter("_hit is not null").select(*names, "_hit"))
        left = got.filter("_hit is null").select(*names, F.col("_group").alias("_after"))
    nowhere = left.select(*keys, "_row", F.lit(None).cast("bigint").alias("_next"))
    for level in range(len(levels) - 1, 0, -1):
        inside = found[level].select(
            *names, F.col("_hit").alias("_group"), (F.shiftleft("_hit", group_bits) - 1).alias("_after")
        )
        got = written(_searched(levels[level - 1], inside, keys, group_bits, per_task), "group-search")
        found[level - 1] = found[level - 1].unionByName(got.select(*names, "_hit"))
    return found[0].select(*keys, "_row", F.col("_hit").alias("_next")).unionByName(nowhere)


def with_running_sum(df: DataFrame, keys: Sequence[str], row: str, value: str, chunk_bits: int = 16) -> DataFrame:
    """Add ``_sum``: the sum of ``value`` over the key's rows up to and including this one, by
    dense position; a key is summed chunk by chunk."""
    keys = list(keys)
    rows = df.withColumn("_chunk", F.shiftright(row, chunk_bits))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_total"))
    bases = totals.select(*keys, "_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_chunk").orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_part", F.sum(value).over(within)).join(bases, [*keys, "_chunk"])
    return summed.withColumn("_sum", F.col("_base") + F.col("_part")).drop("_chunk", "_part", "_base")
