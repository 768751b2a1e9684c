"""Tab-separated sensor logs with '#' header lines, as records of text fields.

Works on lines with an order (``file``, ``block``, ``pos``, ``value``), where a block is one
input split. The header in force at a line is the latest one above it in the file. Header
lines are few, so their states are computed first. Each block gets one row with the places
where its states begin, in which a data line searches; what a state says is kept apart, once
for each different header.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.plans.materialize import broadcast_if_small, computed_once, written
from tidewatch.schemas import DEFAULT_LOGS

# Markers in force until a header line changes them.
DEFAULT_SEPARATOR = "\t"
DEFAULT_SET_SEPARATOR = ","
DEFAULT_EMPTY = "(empty)"
DEFAULT_UNSET = "-"
DEFAULT_PATH = "unknown"

DIRECTIVE = r"^#(separator|set_separator|empty_field|unset_field|path|fields|types)\s+\S"


def positioned(text: DataFrame) -> DataFrame:
    """Lines of a text read with their file, split and order inside the split."""
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.regexp_replace("value", "[\\n\\r]+$", "").alias("value"),
    )


def log_pattern(logs: Sequence[str] = DEFAULT_LOGS) -> str:
    """File name pattern of the logs and their rotated copies."""
    stems = [name.removesuffix(".log") for name in logs]
    forms = [f"{stem}{form}" for stem in stems for form in (".log", ".*.log")]
    return "{" + ",".join(forms + [f"{form}.gz" for form in forms]) + "}"


LOG_FILES = log_pattern()


def read_log_lines(spark: SparkSession, folder: str, pattern: str = LOG_FILES) -> DataFrame:
    """Lines of the logs anywhere below ``folder``; absent logs give no rows."""
    reader = spark.read.option("recursiveFileLookup", "true")
    return positioned(reader.option("pathGlobFilter", pattern).text(folder))


def literal_split(text: Column, separator: Column) -> Column:
    """Split on a literal separator, keeping empty trailing parts."""
    by_other = F.split(text, F.concat(F.lit("\\Q"), separator, F.lit("\\E")), -1)
    # A constant tab needs no pattern to be compiled per line.
    return F.when(separator == "\t", F.split(text, "\t", -1)).otherwise(by_other)


def _separator_value(line: Column) -> Column:
    """Separator named by a '#separator' line; '\\x09' is a character code."""
    given = F.substr(line, F.lit(len("#separator ") + 1))
    code = F.conv(F.substr(given, F.lit(3)), 16, 10).try_cast("int")
    return F.when(given.startswith("\\x"), F.chr(code)).otherwise(given)


def header_states(lines: DataFrame) -> DataFrame:
    """Header state from a line on, up to the next row of the same file block.

    Each block opens with the state carried over from the blocks before it. Columns: file,
    block, from_pos, separator, set_separator, empty_field, unset_field, path, types, fields
    (null until a '#fields' line).
    """
    is_directive = F.col("value").rlike(DIRECTIVE)
    per_block = lines.groupBy("file", "block").agg(
        F.collect_list(F.when(is_directive, F.struct("pos", "value"))).alias("_h")
    )
    opening = F.array(F.struct(F.lit(-(1 << 62)).alias("pos"), F.lit("").alias("value")))
    marks = per_block.select(
        "file", "block", F.explode(F.concat(opening, F.col("_h"))).alias("_m")
    ).select("file", "block", "_m.*")

    so_far = Window.partitionBy("file").orderBy("block", "pos").rowsBetween(
        Window.unboundedPreceding, 0
    )
    word = F.split(F.trim("value"), r"\s+")
    name, argument = F.get(word, F.lit(0)), F.get(word, F.lit(1))

    def latest(directive: str, value: Column, default: str | None = None) -> Column:
        kept = F.last(F.when(name == directive, value), ignorenulls=True).over(so_far)
        return kept if default is None else F.coalesce(kept, F.lit(default))

    with_separator = marks.withColumn(
        "separator",
        latest("#separator", _separator_value(F.col("value")), DEFAULT_SEPARATOR),
    )
    # '#fields' and '#types' are cut by the separator in force on their own line.
    cells = literal_split(F.col("value"), F.col("separator"))
    names = F.slice(cells, F.lit(2), F.size(cells))
    return with_separator.select(
        "file",
        "block",
        F.col("pos").alias("from_pos"),
        "separator",
        latest("#set_separator", argument, DEFAULT_SET_SEPARATOR).alias("set_separator"),
        latest("#empty_field", argument, DEFAULT_EMPTY).alias("empty_field"),
        latest("#unset_field", argument, DEFAULT_UNSET).alias("unset_field"),
        latest("#path", argument, DEFAULT_PATH).alias("path"),
        latest("#types", names).alias("types"),
        latest("#fields", names).alias("fields"),
    )


def last_at_or_before(begins: Column, pos: Column) -> Column:
    """Index, from 0, of the last entry of a sorted array that is not beyond ``pos``.

    A binary search by halving steps; the first entry counts as never beyond.
    """
    steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])

    def move(at: Column, step: Column) -> Column:
        there = F.get(begins, at + step)  # null past the end
        return F.when(there <= pos, at + step).otherwise(at)

    within = F.filter(steps, lambda step: step < F.size(begins))
    return F.when(F.size(begins) == 1, 0).otherwise(F.aggregate(within, F.lit(0), move))


def split_lines(lines: DataFrame) -> DataFrame:
    """Data lines with the header state in force and their ``parts``.

    A line meets one row, that of its block, however many headers the block has.
    """
    states = header_states(lines)
    said = [c for c in states.columns if c not in ("file", "block", "from_pos")]
    states = states.withColumn("_header", F.sha2(F.to_json(F.struct(*said)), 256))
    states = written(states, "log-states")
    begin = F.sort_array(F.collect_list(F.struct("from_pos", "_header")))
    blocks = broadcast_if_small(
        written(
            states.groupBy("file", "block").agg(begin.alias("_s")).select(
                "file", "block", F.col("_s.from_pos").alias("_begins"), F.col("_s._header").alias("_headers")
            ),
            "log-blocks",
        )
    )
    usable = states.filter(F.size("fields") > 0).dropDuplicates(["_header"])
    headers = broadcast_if_small(written(usable.select("_header", *said), "log-headers"))
    data = lines.filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    found = F.get("_headers", last_at_or_before(F.col("_begins"), F.col("pos")))
    placed = data.join(blocks, ["file", "block"]).withColumn("_header", found)
    headed = placed.drop("_begins", "_headers").join(headers, "_header").drop("_header")
    return computed_once(headed, "parts", literal_split(F.col("value"), F.col("separator")))


def is_well_formed() -> Column:
    return F.size("parts") == F.size("fields")


def reject_counts(lines: DataFrame) -> DataFrame:
    """Data lines kept and dropped for a wrong field count, per log path."""
    good = is_well_formed()
    return split_lines(lines).groupBy("path").agg(
        F.count(F.when(good, 1)).alias("kept"), F.count(F.when(~good, 1)).alias("rejected")
    )


def parse_log(lines: DataFrame) -> DataFrame:
    """Records of well-formed data lines: ``file, block, pos, path, rec MAP<STRING,STRING>``.

    A value equal to the file's unset or empty marker is null; the empty text is not. Where
    a field name occurs twice the last one counts.
    """
    good = split_lines(lines).filter(is_well_formed())
    cleaned = F.transform(
        "parts",
        lambda v: F.when((v != F.col("unset_field")) & (v != F.col("empty_field")), v),
    )
    # Spark plans a size check of its own, so unequal lengths must not reach the map.
    record = F.when(is_well_formed(), F.map_from_arrays("fields", cleaned))
    place = ["file", "block", "pos", "path"]
    slim = good.select(*place, "parts", "fields", "unset_field", "empty_field")
    return computed_once(slim, "rec", record).select(*place, "rec")
