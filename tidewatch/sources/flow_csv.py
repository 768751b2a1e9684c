"""Flow record files: CSV with a header, every column read as text."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.plans.materialize import broadcast_if_small, computed_once, written

CORRUPT = "_corrupt_record"


#: A comma outside quotes.
COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _named(cells: Sequence[str]) -> list[str]:
    """Column names of a header's cells; an empty or repeated name gets a number."""
    seen: dict[str, int] = {}
    names = []
    for i, cell in enumerate(cells):
        name = cell if cell else f"Unnamed: {i}"
        if name in seen:
            seen[name] += 1
            name = f"{name}.{seen[name]}"
        else:
            seen[name] = 0
        names.append(name)
    return names


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names on the first line of a file."""
    first = spark.read.csv(path, header=False).first()
    return _named([cell or "" for cell in first or []])


def _lines(spark: SparkSession, paths: Sequence[str], **options: str) -> DataFrame:
    text = spark.read.options(**options).text(list(paths))
    return text.filter(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_name").alias("capture_id"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"),
        F.col("value").alias("_line"),
    )


def file_headers(lines: DataFrame) -> DataFrame:
    """The first line of each file, as a written table: _file, _header, _from."""
    first = lines.filter("_block = 0").groupBy("_file").agg(
        F.min_by("_line", "_pos").alias("_header"), F.min("_pos").alias("_from")
    )
    return written(first, "csv-headers")


def distinct_headers(headers: DataFrame) -> dict[str, list[str]]:
    """Header line -> its column names. Only different header lines reach the driver."""
    found = sorted(r[0] for r in headers.select("_header").distinct().toLocalIterator())
    return {line: _named(next(csv.reader([line]))) for line in found}


def _cut_by_own_header(
    lines: DataFrame, headers: DataFrame, known: dict[str, list[str]]
) -> DataFrame:
    """capture_id, _which (number of the header of the line's file, from 1) and _cells."""
    width = max(map(len, known.values()))
    which = F.array_position(F.array(*map(F.lit, known)), F.col("_header")).cast("int")
    place = broadcast_if_small(headers).withColumn("_which", which).drop("_header")
    rows = lines.join(place.filter("_which > 0"), "_file")
    rows = rows.filter((F.col("_block") > 0) | (F.col("_pos") > F.col("_from")))
    sizes = F.array(*[F.lit(len(names)) for names in known.values()])
    limit = F.get(sizes, F.col("_which") - 1)
    commas = F.length("_line") - F.length(F.replace(F.col("_line"), F.lit(",")))
    # Quotes are looked at only in lines with commas enough.
    too_long = F.when(commas >= limit, F.size(F.split("_line", COMMA, -1)) > limit).otherwise(False)
    fault = F.raise_error(F.concat(F.lit("too many fields in line: "), F.col("_line")))
    rows = rows.filter(F.when(too_long, fault.cast("boolean")).otherwise(True))
    shape = ", ".join(f"c{i} string" for i in range(width))
    return computed_once(rows, "_cells", F.from_csv("_line", shape)).select("capture_id", "_which", "_cells")


def _by_own_header(
    lines: DataFrame, headers: DataFrame, known: dict[str, list[str]]
) -> DataFrame:
    """Flows of files with different headers, each cut by the header of its own file."""
    rows = _cut_by_own_header(lines, headers, known)

    def column(name: str) -> Column:
        cells = [
            F.when(F.col("_which") == k, F.col(f"_cells.c{names.index(name)}"))
            for k, names in enumerate(known.values(), 1)
            if name in names
        ]
        return F.coalesce(*cells).alias(name)

    columns = list(dict.fromkeys(name for names in known.values() for name in names))
    return rows.select("capture_id", *map(column, columns))


def _by_one_header(
    spark: SparkSession, paths: Sequence[str], names: Sequence[str], **options: str
) -> DataFrame:
    """Flows of files that share a header."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    raw = spark.read.options(**options).option("columnPruning", "false").csv(
        list(paths),
        schema=schema,
        header=True,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=CORRUPT,
        # Fields are counted over the whole line even if few columns are used.
        enforceSchema=True,
    )
    # Evaluated for irregular lines only.
    fields = F.size(F.split(CORRUPT, COMMA, -1))
    too_long = F.col(CORRUPT).isNotNull() & (fields > len(names))
    # A filter, so that no choice of columns drops the check. It names a column besides the
    # corrupt one, as Spark refuses to read that alone.
    named = F.substring(F.coalesce(F.col(f"`{names[0]}`"), F.lit("")), 1, 0)
    fault = F.raise_error(F.concat(F.lit("too many fields in line: "), F.col(CORRUPT), named))
    readable = F.when(too_long, fault.cast("boolean")).otherwise(True)
    return raw.filter(readable).select(
        F.col("_metadata.file_name").alias("capture_id"), *[F.col(f"`{n}`") for n in names]
    )


def read_flow_csv(
    spark: SparkSession, path: str | Sequence[str], names: Sequence[str] | None = None, **options: str
) -> DataFrame:
    """Flows of one or more files, with ``capture_id`` = file name.

    Each file is read by its own header, columns it lacks are null; ``names`` states the
    header that all files share. A line with fewer fields than the header is filled with
    nulls; one with more fails the job, as the file is then unreadable.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if names:
        return _by_one_header(spark, paths, names, **options)
    lines = _lines(spark, paths, **options)
    headers = file_headers(lines)
    known = distinct_headers(headers)
    if not known:
        raise FileNotFoundError(f"no line in {paths}")
    if len(known) == 1:
        return _by_one_header(spark, paths, *known.values(), **options)
    return _by_own_header(lines, headers, known)


#: What counts as a capture below a folder.
CAPTURES = {"recursiveFileLookup": "true", "pathGlobFilter": "*.csv"}


def _unlike(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """Rows (capture_id, _which, flow) of all captures below a folder, and their headers."""
    lines = _lines(spark, [folder], **CAPTURES)
    headers = file_headers(lines)
    known = distinct_headers(headers)
    if not known:
        raise FileNotFoundError(f"no line in {folder}")
    rows = _cut_by_own_header(lines, headers, known)
    names = F.get(F.array(*[F.array(*map(F.lit, n)) for n in known.values()]), F.col("_which") - 1)
    cells = F.array(*[F.col(f"_cells.c{i}") for i in range(max(map(len, known.values())))])
    own = F.map_from_arrays(names, F.slice(cells, F.lit(1), F.size(names)))
    return rows.select("capture_id", "_which", F.to_variant_object(own).alias("flow")), known


def read_capture_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Captures of any headers in one table: capture_id, and flow, a VARIANT object.

    A flow has the columns of its own file as texts, with null for what a short line lacks;
    nothing is filled in for columns that only other files have. However many different
    headers there are, the files are read once for the headers and once for the lines.
    """
    return _unlike(spark, folder)[0].drop("_which")


def captured(name: str, kind: str = "string", flow: str = "flow") -> Column:
    """A column of the flows of :func:`read_capture_rows`; null if absent or not of that kind."""
    if "'" in name:
        return F.try_element_at(F.col(flow).cast("map<string,string>"), F.lit(name)).try_cast(kind)
    return F.try_variant_get(flow, f"$['{name}']", "string").try_cast(kind)


def read_captures(
    spark: SparkSession, folder: str, merge: bool = False
) -> DataFrame | list[DataFrame]:
    """All captures below a folder: one table if merged, else one table per header.

    ``capture_id`` tells the files apart in either form; merged tables get null for columns
    a file lacks. Unmerged, the lines are cut once into a written table; its row groups come
    from one file each, so the table of a header reads its own groups only.
    """
    if merge:
        return read_flow_csv(spark, folder, **CAPTURES)
    rows, known = _unlike(spark, folder)
    rows = written(rows, "captures")
    return [
        rows.filter(F.col("_which") == k).select("capture_id", *[captured(n).alias(n) for n in names])
        for k, names in enumerate(known.values(), 1)
    ]


def read_flows(
    spark: SparkSession,
    file: str | None = None,
    folder: str | None = None,
    merge: bool = False,
) -> DataFrame | list[DataFrame]:
    """Flows of a file or of a folder; merging needs a folder."""
    if merge and not folder:
        raise ValueError("merge needs a folder of captures")
    if (file is None) == (folder is None):
        raise ValueError("name either a file or a folder")
    return read_flow_csv(spark, file) if file else read_captures(spark, folder, merge)
