"""Written intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans import files
from tidewatch.session import shared_dir

# A side is broadcast only up to this many bytes, on disk and as rows.
BROADCAST_BYTES = 32 * 1024 * 1024


_scope: ContextVar[str | None] = ContextVar("scope", default=None)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables written inside at the end, as for a stream that runs for months."""
    folder = f"{shared_dir(spark)}/temporary-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield
    finally:
        _scope.reset(token)
        files.delete(spark, folder)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later jobs then start from files: nothing upstream runs twice, a lost executor costs
    one task's read, and Catalyst knows the table's real size.
    """
    path = f"{_scope.get() or shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add an expensive column that later filters and projections must not repeat.

    Catalyst moves a filter below a projection by copying the expression into it. It does
    not do so for the output of a generator, so the value goes through a one-element
    explode; that stays inside generated code and adds no rows.
    """
    return df.select(
        *[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name)
    )


def written_bytes(df: DataFrame) -> int:
    """Size on disk of a table returned by :func:`written`, from the planner's own figure."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a written table take at most ``limit`` bytes.

    Files of repeated values are far smaller than their rows, so the rows are measured, too:
    the bytes of each as text, with room for the hash table.
    """
    if written_bytes(df) > limit:
        return False
    width = F.octet_length(F.to_json(F.struct("*"))).cast("bigint") + 64
    return (df.agg(F.sum(width)).first()[0] or 0) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a written table whose rows are small enough, else ``df`` as it is."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df
