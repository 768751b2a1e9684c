"""Tumbling-window state vectors of flow records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.names import match_name, state_names, text_array
from tidewatch.operators.flows import TIME_COLUMN

HIGH_PORT_ABOVE = 1024
# Features per exploded row. Four keep the aggregate's generated code small and cost a
# quarter of the rows that one feature per row would; the fastest of 1, 2, 4, 8, 13 and 20
# on 78 features.
BLOCK = 4
# Up to here all statistics of a flow's features are aggregated at once, without exploding.
DIRECT_FEATURES = 16


def _feature_named(feature_cols: Sequence[str], key: str) -> str | None:
    return next((f for f in feature_cols if match_name(f) == key), None)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _whole(feature: str) -> str:
    """Integer part; numbers beyond 64 bits share one value instead of failing the job."""
    return f"coalesce(try_cast({_quoted(feature)} AS BIGINT), bigint('{-(2**63)}'))"


def exploded_blocks(
    flows: DataFrame, feature_cols: Sequence[str], group: Sequence[Column]
) -> DataFrame:
    """One row per flow and block of features, plus one each for its port and protocol.

    ``_block`` is the block number; -1 marks the port row, -2 the protocol row, and only
    those carry ``_item``. A later count of (group, block, item) groups is then a distinct
    count, made in the same pass and with the same partial aggregation as the sums.
    """
    port = _feature_named(feature_cols, "dstport")
    protocol = _feature_named(feature_cols, "protocol")

    def block(number: int, item: str | None, cells: Sequence[str]) -> str:
        padded = [*cells, *["CAST(NULL AS DOUBLE)"] * (BLOCK - len(cells))]
        named = ", ".join(f"'_x{j}', {c}" for j, c in enumerate(padded))
        item = item or "CAST(NULL AS BIGINT)"
        return f"named_struct('_block', {number}, '_item', {item}, {named})"

    blocks = [
        block(start // BLOCK, None, [_quoted(f) for f in feature_cols[start : start + BLOCK]])
        for start in range(0, len(feature_cols), BLOCK)
    ]
    # The port row always exists: it also counts the window's flows and high ports.
    if port:
        high = f"CASE WHEN {_quoted(port)} > {HIGH_PORT_ABOVE} THEN 1.0D ELSE 0.0D END"
        blocks.append(block(-1, _whole(port), [high]))
    else:
        blocks.append(block(-1, None, ["0.0D"]))
    if protocol:
        blocks.append(block(-2, _whole(protocol), []))
    rows = F.expr("explode(array(" + ", ".join(blocks) + "))").alias("_b")
    exploded = flows.select(*group, rows)
    return exploded.select(*[c for c in exploded.columns if c != "_b"], "_b.*")


def block_statistics(std_mode: str) -> list[Column]:
    """Aggregates over one (group, block, item); all partial, so a hot window is reduced
    before the shuffle and its blocks and ports go to different tasks.

    Cleaned features are never null, so one row count serves all means.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for j in range(BLOCK):
        x = F.col(f"_x{j}")
        if std_mode == "population":
            spread = F.stddev_pop(x)
        elif std_mode == "moments":
            spread = F.sum(x * x)
        else:
            raise ValueError("std_mode must be 'population' or 'moments'")
        aggs += [
            F.sum(x).alias(f"_sum{j}"),
            spread.alias(f"_std{j}"),
            F.min(x).alias(f"_min{j}"),
            F.max(x).alias(f"_max{j}"),
        ]
    return aggs


def packed_state(std_mode: str) -> list[Column]:
    """Aggregates that put the block statistics of one window back together."""

    def cell(stat: str, j: int) -> Column:
        mean = F.col(f"_sum{j}") / F.col("_n")
        if stat == "mean":
            return mean
        if stat == "std" and std_mode == "moments":
            return F.sqrt(F.greatest(F.col(f"_std{j}") / F.col("_n") - mean * mean, F.lit(0.0)))
        return F.col(f"_{stat}{j}")

    per_stat = [
        F.array(*[cell(stat, j) for j in range(BLOCK)]).alias(stat)
        for stat in ("mean", "std", "min", "max")
    ]
    is_port, is_protocol = F.col("_block") == -1, F.col("_block") == -2
    cells = F.when(F.col("_block") >= 0, F.struct("_block", *per_stat))
    return [
        F.array_sort(F.collect_list(cells)).alias("_cells"),
        F.sum(F.when(is_port, F.col("_n"))).alias("flow_count"),
        F.sum(F.when(is_port, F.col("_sum0"))).alias("_high"),
        F.count(F.when(is_port & F.col("_item").isNotNull(), 1)).alias("_ports"),
        F.count(F.when(is_protocol, 1)).alias("_protocols"),
    ]


def state_column(feature_cols: Sequence[str]) -> Column:
    """All means, stds, minima and maxima, then the four meta dimensions."""
    width = len(feature_cols)
    stats = [
        F.slice(F.flatten(F.col(f"_cells.{stat}")), 1, width)
        for stat in ("mean", "std", "min", "max")
    ]
    meta = F.array(
        F.log1p(F.col("flow_count").cast("double")),
        F.log1p(F.col("_ports").cast("double")),
        F.col("_protocols").cast("double"),
        F.col("_high") / F.col("flow_count"),
    )
    return F.concat(*stats, meta)


def item_words(
    flows: DataFrame, feature_cols: Sequence[str], group: Sequence[Column]
) -> DataFrame | None:
    """Ports and protocols of each group as sparse bitmaps: rows (group, ``_kind``, ``_word``,
    ``_bits``) with 64 numbers to a word; kind 0 is the port, 1 the protocol.

    Words are joined bit by bit before and after the shuffle, so a group that all ports occur
    in is 1024 rows a task, and what is counted are bits. None without either feature.
    """
    found = [_feature_named(feature_cols, key) for key in ("dstport", "protocol")]
    items = [
        f"named_struct('_kind', {kind}, '_word', shiftright({_whole(name)}, 6),"
        f" '_bits', shiftleft(1L, int({_whole(name)} & 63)))"
        for kind, name in enumerate(found)
        if name
    ]
    if not items:
        return None
    rows = flows.select(*group, F.expr(f"explode(array({', '.join(items)}))").alias("_i"))
    names = [c for c in rows.columns if c != "_i"]
    return rows.select(*names, "_i.*").groupBy(*names, "_kind", "_word").agg(
        F.bit_or("_bits").alias("_bits")
    )


def window_statistics(
    flows: DataFrame, feature_cols: Sequence[str], group: Sequence[Column], std_mode: str
) -> DataFrame:
    """Per group ``flow_count``, ``high_ports`` and ``cells``: mean, std, min and max of each
    feature, in order."""
    if std_mode not in ("population", "moments"):
        raise ValueError("std_mode must be 'population' or 'moments'")
    port = _feature_named(feature_cols, "dstport")
    above = f"{_quoted(port)} > {HIGH_PORT_ABOVE}" if port else "false"
    width = len(feature_cols)
    if width <= DIRECT_FEATURES:
        features = [F.col(_quoted(f)).alias(f"_x{i}") for i, f in enumerate(feature_cols)]
        named = flows.select(*group, F.expr(above).alias("_above"), *features)
        names = named.columns[: len(group)]
        aggs = [F.count(F.lit(1)).alias("flow_count"), F.count_if("_above").alias("high_ports")]
        for i in range(width):
            aggs += _cell_aggregates(f"_x{i}", std_mode, str(i))
        flat = named.groupBy(*names).agg(*aggs)
        cells = F.array(*[_cell(str(i), F.col("flow_count"), std_mode) for i in range(width)])
        return flat.select(*names, "flow_count", "high_ports", cells.alias("cells"))
    blocks = []
    for start in range(0, width, BLOCK):
        cells = [_quoted(f) for f in feature_cols[start : start + BLOCK]]
        padded = [*cells, *["CAST(NULL AS DOUBLE)"] * (BLOCK - len(cells))]
        named = ", ".join(f"'_x{j}', {c}" for j, c in enumerate(padded))
        counted = "false" if start else above
        blocks.append(f"named_struct('_block', {start // BLOCK}, '_above', {counted}, {named})")
    rows = flows.select(*group, F.expr("explode(array(" + ", ".join(blocks) + "))").alias("_b"))
    names = [c for c in rows.columns if c != "_b"]
    aggs = [F.count(F.lit(1)).alias("_n"), F.count_if("_above").alias("_high")]
    for j in range(BLOCK):
        aggs += _cell_aggregates(f"_x{j}", std_mode, str(j))
    parts = rows.select(*names, "_b.*").groupBy(*names, "_block").agg(*aggs)
    block = F.struct("_block", F.array(*[_cell(str(j), F.col("_n"), std_mode) for j in range(BLOCK)]).alias("c"))
    packed = parts.groupBy(*names).agg(
        F.max("_n").alias("flow_count"), F.sum("_high").alias("high_ports"), F.array_sort(F.collect_list(block)).alias("_c")
    )
    return packed.select(
        *names, "flow_count", "high_ports", F.slice(F.flatten(F.col("_c.c")), 1, width).alias("cells")
    )


def _cell_aggregates(name: str, std_mode: str, tag: str) -> list[Column]:
    x = F.col(name)
    spread = F.stddev_pop(x) if std_mode == "population" else F.sum(x * x)
    return [
        F.sum(x).alias(f"_sum{tag}"), spread.alias(f"_std{tag}"),
        F.min(x).alias(f"_min{tag}"), F.max(x).alias(f"_max{tag}"),
    ]


def _cell(tag: str, n: Column, std_mode: str) -> Column:
    mean = F.col(f"_sum{tag}") / n
    std = F.col(f"_std{tag}")
    if std_mode == "moments":
        std = F.sqrt(F.greatest(std / n - mean * mean, F.lit(0.0)))
    return F.struct(
        mean.alias("mean"), std.alias("std"), F.col(f"_min{tag}").alias("min"), F.col(f"_max{tag}").alias("max")
    )


def _state(ports: Column, protocols: Column) -> Column:
    """All means, stds, minima and maxima, then the four meta dimensions."""
    meta = F.array(
        F.log1p(F.col("flow_count").cast("double")),
        F.log1p(ports.cast("double")),
        protocols.cast("double"),
        F.col("high_ports").cast("double") / F.col("flow_count"),
    )
    return F.concat(*[F.col(f"cells.{stat}") for stat in ("mean", "std", "min", "max")], meta)


def _group(window_size: str, keys: Sequence[str]) -> list[Column]:
    start = F.window(F.col(TIME_COLUMN), window_size)["start"].alias("window_start")
    return [*[F.col(k) for k in keys], start]


def window_states(
    flows: DataFrame,
    feature_cols: Sequence[str],
    window_size: str = "1 minute",
    keys: Sequence[str] = ("capture_id",),
    std_mode: str = "population",
) -> DataFrame:
    """One state vector per key and window that holds at least one flow.

    Input: cleaned flows (see ``align_flows``). Columns: keys, ``window_start``,
    ``flow_count``, ``state``. ``std_mode='moments'`` takes the standard deviation from the
    sum of squares, floored at 0, for scalers that were fitted on that form. Statistics and
    distinct items are aggregated apart, each with partial aggregation, and joined on the
    window, by which both are already dealt out.
    """
    group, names = _group(window_size, keys), [*keys, "window_start"]
    stats = window_statistics(flows, feature_cols, group, std_mode)
    words = item_words(flows, feature_cols, group)
    if words is None:
        return stats.select(*names, "flow_count", _state(F.lit(0), F.lit(0)).alias("state"))
    counts = words.groupBy(*names).agg(
        *[F.coalesce(F.sum(F.when(F.col("_kind") == k, F.bit_count("_bits"))), F.lit(0)).alias(f"_d{k}") for k in (0, 1)]
    )
    both = stats.join(counts, names)
    return both.select(*names, "flow_count", _state(F.col("_d0"), F.col("_d1")).alias("state"))


# --- states that are stored and merged -------------------------------------------------


def partial_states(
    flows: DataFrame,
    feature_cols: Sequence[str],
    window_size: str = "1 minute",
    keys: Sequence[str] = ("capture_id",),
) -> DataFrame:
    """States in a form that can be merged: keys, ``window_start``, ``flow_count``,
    ``high_ports``, ``cells`` (mean, std, min, max of each feature) and ``items`` (the words
    of the window's bitmaps of ports and protocols)."""
    group, names = _group(window_size, keys), [*keys, "window_start"]
    stats = window_statistics(flows, feature_cols, group, "population")
    words = item_words(flows, feature_cols, group)
    if words is None:
        empty = F.expr("CAST(array() AS array<struct<_kind: int, _word: bigint, _bits: bigint>>)")
        return stats.withColumn("items", empty)
    return stats.join(_collected(words, names), names)


def _collected(words: DataFrame, names: Sequence[str]) -> DataFrame:
    word = F.struct("_kind", "_word", "_bits")
    return words.groupBy(*names).agg(F.array_sort(F.collect_list(word)).alias("items"))


def merged_states(
    partials: DataFrame, window_size: str, keys: Sequence[str] = ("capture_id",)
) -> DataFrame:
    """Partial states of longer windows, from those of windows that lie within them.

    No flow is read. Deviations are taken from the merged mean, so nothing cancels; bitmaps
    are joined word by word. The same form again, so merging can go on.
    """
    start = F.window("window_start", window_size)["start"].alias("window_start")
    names = [*keys, "window_start"]
    rows = partials.select(*keys, start, "flow_count", "high_ports", "cells", "items")
    sums = rows.groupBy(*names).agg(F.sum("flow_count").alias("flow_count"), F.sum("high_ports").alias("high_ports"))
    cells = rows.select(*names, F.col("flow_count").alias("_n"), F.posexplode("cells").alias("_f", "_c"))
    cells = cells.select(*names, "_n", "_f", "_c.*")
    whole = Window.partitionBy(*names, "_f")
    mean = F.sum(F.col("_n") * F.col("mean")).over(whole) / F.sum("_n").over(whole)
    apart = F.col("mean") - F.col("_all")
    merged = cells.withColumn("_all", mean).groupBy(*names, "_f").agg(
        F.max("_all").alias("mean"),
        F.sqrt(F.sum(F.col("_n") * (F.col("std") * F.col("std") + apart * apart)) / F.sum("_n")).alias("std"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )
    cell = F.struct("_f", F.struct("mean", "std", "min", "max").alias("c"))
    packed = merged.groupBy(*names).agg(F.array_sort(F.collect_list(cell)).alias("_c"))
    packed = packed.select(*names, F.col("_c.c").alias("cells"))
    words = rows.select(*names, F.explode("items").alias("_i")).select(*names, "_i.*")
    words = words.groupBy(*names, "_kind", "_word").agg(F.bit_or("_bits").alias("_bits"))
    none = F.expr("CAST(array() AS array<struct<_kind: int, _word: bigint, _bits: bigint>>)")
    joined = sums.join(packed, names).join(_collected(words, names), names, "left")
    return joined.withColumn("items", F.coalesce("items", none))


def finished_states(partials: DataFrame, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """State vectors of partial states, as :func:`window_states` gives them."""

    def distinct(kind: int) -> Column:
        own = F.filter("items", lambda i: i["_kind"] == kind)
        return F.aggregate(own, F.lit(0), lambda n, i: n + F.bit_count(i["_bits"]))

    state = _state(distinct(0), distinct(1)).alias("state")
    return partials.select(*keys, "window_start", "flow_count", state)


def append_states(partials: DataFrame, table: str) -> None:
    """Add partial states to a table below ``date=``, by which readers skip days."""
    dated = partials.withColumn("date", F.date_format("window_start", "yyyy-MM-dd"))
    dated.repartition("date").write.mode("append").partitionBy("date").parquet(table)


def load_states(spark: SparkSession, table: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Partial states of the days from ``first`` to ``last``, both included."""
    read = spark.read.parquet(table)
    if first is not None:
        read = read.filter(F.col("date") >= first)
    if last is not None:
        read = read.filter(F.col("date") <= last)
    return read.drop("date")


def state_dimensions(states: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """Long form of the state vectors: one row per dimension, with its name."""
    names = text_array(state_names(feature_cols))
    keep = [c for c in states.columns if c != "state"]
    long = states.select(*keep, F.posexplode("state").alias("dim", "value"))
    return long.withColumn("feature", F.element_at(names, F.col("dim") + 1))
