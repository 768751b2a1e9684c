"""Growing and rotated log files as a streaming source with byte offsets.

The offset of a stream is, for each file by its inode, how many bytes of whole lines have been
read. A line that is still being written waits for its end. A file that is renamed goes on
under its new name if that matches the pattern too; one that has become shorter is read from
its start, and so is a new file under an old name. Files must be on a file system that the
driver and all executors mount.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewatch.sources.zeek import LOG_FILES

# Bytes of one file that a task reads.
PIECE_BYTES = 32 * 1024 * 1024


def matching(folder: str, pattern: str) -> Iterator[tuple[str, str]]:
    """(inode, path) of the files below a folder whose name fits '{a,b}' or a plain pattern."""
    forms = pattern[1:-1].split(",") if pattern.startswith("{") and pattern.endswith("}") else [pattern]
    for base, _, names in os.walk(folder):
        for name in sorted(names):
            if any(fnmatch.fnmatchcase(name, form) for form in forms) and not name.endswith(".gz"):
                path = os.path.join(base, name)
                try:
                    yield str(os.stat(path).st_ino), path
                except FileNotFoundError:
                    continue


def whole_lines(path: str) -> int:
    """Bytes of a file up to the end of its last finished line."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            begin = max(0, at - (1 << 16))
            f.seek(begin)
            found = f.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return 0


@dataclass
class Piece(InputPartition):
    """Bytes of a file; lines that begin in them belong to it. ``first`` is where the batch's
    part of the file begins."""

    inode: str
    path: str
    first: int
    begin: int
    end: int


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str, from_now: bool, piece: int):
        self.folder, self.pattern, self.from_now, self.piece = folder, pattern, from_now, piece

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.from_now else {}

    def latestOffset(self, *_) -> dict:
        found = {}
        for inode, path in matching(self.folder, self.pattern):
            try:
                found[inode] = [path, whole_lines(path)]
            except FileNotFoundError:
                continue
        return found

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for inode, (path, size) in sorted(end.items(), key=lambda x: x[1][0]):
            done = start.get(inode, [path, 0])[1]
            first = 0 if size < done else done
            for begin in range(first, size, self.piece):
                out.append(Piece(inode, path, first, begin, min(size, begin + self.piece)))
        return out

    def read(self, piece: Piece) -> Iterator[tuple]:
        path = piece.path
        if not os.path.exists(path) or str(os.stat(path).st_ino) != piece.inode:
            # Renamed since the batch was planned.
            path = dict(matching(self.folder, self.pattern)).get(piece.inode)
            if path is None:
                raise FileNotFoundError(f"{piece.path} is no longer there to be read to byte {piece.end}")
        with open(path, "rb") as f:
            f.seek(piece.begin)
            if piece.begin > piece.first:
                f.seek(piece.begin - 1)
                f.readline()  # the line that the piece before has begun
            while (pos := f.tell()) < piece.end:
                line = f.readline().decode("utf-8", "replace")
                yield piece.inode, piece.begin, pos, line.rstrip("\r\n")


class LogTail(DataSource):
    """Options: ``folder``, ``pattern``, ``from_now`` (skip what is there at the first start) and
    ``piece_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, block bigint, pos bigint, value string"

    def streamReader(self, schema) -> TailReader:
        take = self.options.get
        return TailReader(
            take("folder"), take("pattern", LOG_FILES), take("from_now", "false").lower() == "true",
            int(take("piece_bytes", str(PIECE_BYTES))),
        )


def tail_stream(
    spark: SparkSession, folder: str, pattern: str = LOG_FILES, from_now: bool = False, piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """Lines of log files as they grow. ``file`` is the file's inode, which outlives a rename."""
    spark.dataSource.register(LogTail)
    reader = spark.readStream.format("log_tail").option("folder", folder).option("pattern", pattern)
    reader = reader.option("from_now", str(from_now).lower()).option("piece_bytes", str(piece_bytes))
    return reader.load().withColumn("at", F.current_timestamp())
