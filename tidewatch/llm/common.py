"""Helpers that several operators share: row tables, word tables, running sums, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.plans.materialize import written

# --- tables -------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_columns(df: DataFrame) -> list[Column]:
    """All columns by their names, which may hold dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def running_start(df: DataFrame, keys: list[str], chunk: str, order: list, value: str) -> DataFrame:
    """Add ``start``: the sum of ``value`` over the rows of the same keys that come before.

    ``chunk`` splits a key's rows into ranges in the given order, so a key with a third of
    all rows is summed range by range and only range totals meet in one task.
    """
    totals = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *keys, chunk, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base")
    )
    inside = (
        Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        rows.join(bases, [*keys, chunk])
        .withColumn("start", F.col("_base") + F.col("_inside"))
        .drop("_base", "_inside")
    )


def cut_spans(docs: DataFrame, spans: str, text: str = "text") -> DataFrame:
    """Take sorted, disjoint spans (start, end in code points) out of a text column.

    Rows without spans keep their text as it is; n_chars, if present, follows the new text.
    """
    old, n = F.col(text), F.size(spans)
    at = F.col(spans)

    def piece(i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(at, i - 1)["end"])
        stop = F.coalesce(F.get(at, i)["start"], F.length(old))
        return F.substring(old, begin.cast("int") + 1, F.greatest(stop - begin, F.lit(0)).cast("int"))

    rest = F.array_join(F.transform(F.sequence(F.lit(0), n), piece), "")
    cut = F.coalesce(n, F.lit(0)) > 0
    out = docs.withColumn(text, F.when(cut, rest).otherwise(old))
    if "n_chars" in docs.columns:
        length = F.length(text).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(cut, length).otherwise(F.col("n_chars")))
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root the least node.

    Large-star and small-star rounds until nothing changes; every round is a written table,
    so a lost executor costs one round's task. Nodes without edges do not appear.
    """

    def oriented(df: DataFrame) -> DataFrame:
        return df.filter("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct()

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        return tuple(row)

    now = written(oriented(edges), "edges")
    was = state(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(oriented(large), "large-star")
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        small = now.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(
            oriented(small.unionByName(least.select("a", F.col("m").alias("b")))), "small-star"
        )
        seen = state(now)
        if seen == was:
            break
        was = seen
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


# --- words of many texts at once, from Arrow buffers -----------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words that white space separates.
NOT_SPACE = ~_SPACE
#: Bytes of words made of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
SAME = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, all other bytes as they are.
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any run of ``values`` through :func:`run_hash`."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def run_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mixed((prefix[stop] - prefix[start]) * down[start])


def text_slices(
    column: pa.Array, limit: int = 1 << 20
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of a text column in runs of about ``limit`` bytes: first row, bytes, row offsets.

    A text longer than the limit is a run of its own, whole. Null is the empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        begin, end = offsets[first], offsets[last]
        yield first, data[begin:end], offsets[first : last + 1] - begin
        first = last


def find_words(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and stops of all words, and the first word of each row (one more at the end)."""
    member = inside[data]
    starts = member.copy()
    starts[1:] &= ~member[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    starts[edges] = member[edges]
    stops = member.copy()
    stops[:-1] &= ~member[1:] | starts[1:]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(stops) + 1, np.searchsorted(begin, offsets)


def word_hashes(data: np.ndarray, begin: np.ndarray, stop: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word, the same wherever the word stands; ``to`` maps bytes first."""
    return run_hash(prefix_hash(to[data].astype(np.uint64) + np.uint64(1)), begin, stop)


def md5_int(text: Column, digits: int = 12) -> Column:
    """The first hexadecimal digits of the MD5 of a text as a whole number."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")
