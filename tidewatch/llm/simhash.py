"""SimHash near-duplicates by generalised pigeonhole search.

Fingerprints within ``radius`` bits of each other are found without comparing all pairs: the
64 bits are grouped so that correlated bits stand together, each group gets a threshold of
its own (-1: the group is not used) such that thresholds plus one add up to radius + 1, and
the thresholds come from a dynamic program over estimated candidate counts. Two fingerprints
within the radius are then within the threshold of at least one group; candidates of the
index on the groups are verified on all bits.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import (
    LOWER, NOT_SPACE, components, find_words, fresh, own_columns, table, text_slices,
)
from tidewatch.plans.materialize import written

BITS = 64


@dataclass(frozen=True)
class Search:
    """words: in a shingle. radius: most differing bits of a link. bucket: members up to which
    the pairs of an index bucket are compared; larger ones are linked through shared
    neighbours, which is as exact and linear in the bucket."""

    words: int = 3
    radius: int = 2
    bucket: int = 64
    layouts: tuple[int, ...] = (1, 2, 3, 4)


def _row_fingerprints(data, offsets, width: int) -> np.ndarray:
    """Fingerprints of the texts of one slice."""
    lowered = LOWER[data]
    begin, stop, first = find_words(data, offsets, NOT_SPACE)
    lengths = stop - begin
    # The slice again, its words parted by exactly one space.
    ends = np.cumsum(lengths + 1) if len(begin) else np.zeros(0, np.int64)
    starts = ends - lengths - 1
    inside = NOT_SPACE[data]
    packed = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    if len(begin):
        shift = np.repeat(starts - begin, lengths)
        at = np.flatnonzero(inside)
        packed[at + shift] = lowered[at]
    raw = packed.tobytes()
    hashed = xxhash.xxh64_intdigest
    out = np.zeros(len(offsets) - 1, np.uint64)
    for row in range(len(out)):
        a, b = int(first[row]), int(first[row + 1])
        if a == b:
            continue
        n = max(1, b - a - width + 1)
        froms = starts[a : a + n].tolist()
        tos = (ends[min(a + width, b) - 1 : b] - 1).tolist()
        h = np.fromiter((hashed(raw[i:j], 42) for i, j in zip(froms, tos)), np.uint64, n)
        ones = np.zeros(BITS, np.int64)
        for part in range(0, n, 1 << 16):
            bits = np.unpackbits(h[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out[row] = np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprint_udf(width: int):
    """Column function: the SimHash of a text as a signed long; null and empty give 0."""

    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), np.uint64)
        for first, data, offsets in text_slices(texts):
            out[first : first + len(offsets) - 1] = _row_fingerprints(data, offsets, width)
        return pa.array(out.view(np.int64))

    return fingerprint


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each two bits are set together, over all rows."""
    schema = "i int, j int, n long"

    def count(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            values = np.asarray(batch.column(0)).astype(np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float64)
            total += np.rint(bits.T @ bits).astype(np.int64)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "n"]
        )

    both = np.zeros((BITS, BITS))
    sums = prints.select("fp").mapInArrow(count, schema).groupBy("i", "j").agg(F.sum("n").alias("n"))
    for i, j, n in sums.collect():  # at most 64 x 64 rows
        both[i, j] = n
    return prints.count(), both


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in ``m`` groups of nearly equal size, correlated ones together."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = list(range(BITS)), []
    for g in range(m):
        size = len(left) // (m - g)
        among = corr[np.ix_(left, left)] - 2 * np.eye(len(left))
        seed = int(np.argmax(among.max(axis=1)))
        group = [left.pop(seed)]
        while len(group) < size:
            gain = corr[np.ix_(left, group)].mean(axis=1)
            group.append(left.pop(int(np.argmax(gain))))
        groups.append(sorted(group))
    return groups


def _differences(p: np.ndarray, most: int) -> np.ndarray:
    """Chance that two rows differ in 0 .. most of the bits, were the bits independent."""
    chance = np.zeros(most + 1)
    chance[0] = 1
    for d in 2 * p * (1 - p):
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    return chance


def allocate(n: int, groups, p: np.ndarray, same: list[float], radius: int) -> tuple[float, list[int]]:
    """Thresholds of least cost: probes sent plus candidates met, by dynamic programming.

    ``same`` has for each group the pairs of rows that agree on it, counted over all rows;
    the pairs at a distance follow from the bits' independent differences.
    """
    budget = radius + 1
    best = {0: (0.0, [])}
    for group, pairs in zip(groups, same):
        chance = _differences(p[group], radius)
        ratio = np.cumsum(chance) / max(chance[0], 1e-300)
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, budget - spent):
                if t > len(group):
                    continue
                probes = sum(comb(len(group), k) for k in range(t + 1))
                more = 0.0 if t < 0 else n * (probes + 1) + pairs * ratio[t]
                at = spent + t + 1
                if at not in step or cost + more < step[at][0]:
                    step[at] = (cost + more, [*chosen, t])
        best = step
    return best[budget]


def _long(bits) -> str:
    """SQL literal of the signed long with these bits set."""
    value = sum(1 << b for b in bits)
    value -= (value >> 63) << 64
    return f"{value}L" if value > -(1 << 63) else "(-9223372036854775807L - 1L)"


def _neighbours(prints: DataFrame, flips) -> DataFrame:
    """Rows (fp, v): each fingerprint with the given sets of bits flipped."""
    values = ", ".join(_long(f) for f in flips)
    return prints.select("fp", F.explode(F.expr(f"array({values})")).alias("v")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("v")).alias("v")
    )


def _keys(prints: DataFrame, probes) -> DataFrame:
    """Rows (fp, g, v): the bits of each group, for ``probes`` of (group, its bits, flipped)."""
    rows = ", ".join(f"struct({g} AS g, {_long(bits)} AS mask, {_long(f)} AS flip)" for g, bits, f in probes)
    return prints.select("fp", F.expr(f"inline(array({rows}))")).select(
        "fp", "g", F.col("fp").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")).alias("v")
    )


def plan_search(prints: DataFrame, search: Search) -> tuple[list[list[int]], list[int]]:
    """Groups and thresholds for these fingerprints, from statistics over all of them."""
    n, both = bit_statistics(prints)
    p = np.diag(both) / max(1, n)
    layouts = {m: correlated_groups(n, both, m) for m in search.layouts}
    masks = [(m, g, group) for m, groups in layouts.items() for g, group in enumerate(groups)]
    same = (
        _keys(prints, [(i, group, ()) for i, (_, _, group) in enumerate(masks)])
        .groupBy("g", "v").count()
        .groupBy("g").agg(F.sum(F.expr("cast(count as double) * (count - 1) / 2")).alias("pairs"))
    )
    pairs = dict(same.collect())  # one row for each group of each layout
    found = []
    for m, groups in layouts.items():
        counts = [pairs.get(i, 0.0) for i, (k, _, _) in enumerate(masks) if k == m]
        found.append((*allocate(n, groups, p, counts, search.radius), m))
    _, thresholds, m = min(found, key=lambda x: x[0])
    return layouts[m], thresholds


def links(prints: DataFrame, search: Search) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links."""
    groups, thresholds = plan_search(prints, search)
    used = [(g, bits, t) for g, (bits, t) in enumerate(zip(groups, thresholds)) if t >= 0]
    indexed = _keys(prints, [(g, bits, ()) for g, bits, _ in used])
    probes = _keys(prints, [
        (g, bits, some) for g, bits, t in used for k in range(t + 1) for some in combinations(bits, k)
    ])
    # Rows of a bucket that too many meet are linked in another way, below.
    sizes = probes.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    hot = written(sizes.filter(F.col("n") > search.bucket).select("g", "v"), "hot-buckets")
    cold_index = indexed.join(hot, ["g", "v"], "left_anti")
    cold_probe = probes.select("g", "v", F.col("fp").alias("other"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= search.radius
    pairs = (
        cold_index.join(cold_probe, (cold_index.g == cold_probe.g) & (cold_index.v == cold_probe.v) & (F.col("fp") < F.col("other")) & close)
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )
    crowded = indexed.unionByName(probes).join(hot, ["g", "v"], "left_semi").select("fp").distinct()
    return pairs.unionByName(neighbour_links(crowded, search.radius))


def neighbour_links(prints: DataFrame, radius: int) -> DataFrame:
    """Edges that join what is within ``radius`` bits, through fingerprints half-way between.

    Rows within 2r bits share a value within r bits of both, and rows that share one are
    within 2r bits, so linking each row to the least row of every value within r bits gives
    the same components: 65 values a row for a radius of 2. For an odd radius the values of
    one row reach a bit further than those of its partner.
    """
    near = radius // 2
    flips = [s for k in range(near + 1) for s in combinations(range(BITS), k)]
    middle = _neighbours(prints, flips)
    star = middle.groupBy("v").agg(F.min("fp").alias("b"))
    reach = middle
    if radius % 2:
        reach = middle.unionByName(_neighbours(prints, combinations(range(BITS), near + 1)))
    return reach.join(star, "v").filter("fp <> b").select(F.col("fp").alias("a"), "b")


def near_duplicates(docs: DataFrame, search: Search = Search(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row.

    Null and empty texts have fingerprint 0 and are linked like any other. component_id is
    the least doc_id that links reach; a null doc_id is passed over, and a component of
    nulls alone has null. Repeated rows and ids stay rows of their own.
    """
    rows = written(
        docs.select(F.col(doc_id).alias("doc_id"), fingerprint_udf(search.words)(F.col(text)).alias("fp")), "fingerprints"
    )
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = components(links(prints, search))
    member = prints.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    roots = member.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = member.join(roots, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, search: Search = Search()) -> DataFrame:
    """The documents that stay: of each component the row with the least doc_id.

    Null ids come last; of rows with the same id and text one stays. Columns as given.
    """
    # Everything but the last join works on ids, hashes and fingerprints; texts move once.
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("th")]
    rows = written(docs.select(*own, fingerprint_udf(search.words)(F.col("text")).alias("fp")), "fingerprints")
    firsts = written(rows.groupBy("fp").agg(F.min(F.struct("id", "th")).alias("least")), "distinct-fingerprints")
    found = components(links(firsts.select("fp"), search))
    member = firsts.join(found, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    stay = member.groupBy("root").agg(F.min("least").alias("least")).select("least.*")
    own_id, own_hash = fresh(docs, "id"), fresh(docs, "th")
    keyed = docs.withColumn(own_id, own[0]).withColumn(own_hash, own[1])
    kept = keyed.join(stay.toDF(own_id, own_hash), [own_id, own_hash], "left_semi")
    return kept.dropDuplicates([own_id, own_hash]).select(*own_columns(docs))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
