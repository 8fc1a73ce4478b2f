"""A streaming source of log lines that remembers a place in each file, for Spark's Python data sources: spark.readStream.format("log_tail").load(folder)."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Fixed value: how much of a file's end is read when it is seen for the first time.
TAIL_BYTES = 200_000
#: Bytes that one task reads, and bytes in which the last line's end is sought at a time.
SLICE, STEP = 16 << 20, 1 << 16


class Stretch(InputPartition):
    """Lines of a file that begin in [begin, end); whole: a line begins at begin, or what is there counts as one."""

    def __init__(self, path: str, begin: int, end: int, whole: bool):
        super().__init__((path, begin, end))
        self.path, self.begin, self.end, self.whole = path, begin, end, whole


def lines_end(file, size: int) -> int:
    """Where the last whole line ends; what follows is not yet written."""
    at = size
    while at:
        low = max(0, at - STEP)
        if (found := file.read_at(at - low, low).rfind(b"\n")) >= 0:
            return low + found + 1
        at = low
    return 0


class TailReader(DataSourceStreamReader):
    """Offsets are {path: place}. A file that is new is read from its last first_bytes on; one that has become shorter than its place has been started anew and is read from its
    beginning; one that is gone is forgotten. A batch that is run again reads the same stretches."""

    def __init__(self, root: str, pattern: str, first_bytes: int):
        self.root, self.pattern, self.first_bytes = root, pattern, first_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = fs.FileSystem.from_uri(self.root)
        out = {}
        for f in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern):
                with store.open_input_file(f.path) as file:
                    out[f.path] = lines_end(file, f.size)
        return out

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for path, stop in sorted(end.items()):
            begin = start.get(path)
            begin = max(0, stop - self.first_bytes) if begin is None else 0 if stop < begin else begin
            out += [Stretch(path, at, min(at + SLICE, stop), at == begin) for at in range(begin, stop, SLICE)]
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.root)
        with store.open_input_file(partition.path) as file:
            at = partition.begin - (not partition.whole)
            file.seek(at)
            held, skip = b"", not partition.whole
            while at < partition.end:
                more = file.read(STEP)
                *lines, held = (held + more).split(b"\n")
                for line in lines:
                    if not skip and at < partition.end:
                        yield partition.path, at, line.decode("utf-8", "replace").rstrip("\r")
                    skip, at = False, at + len(line) + 1
                if not more:
                    break

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "path string, at long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("pattern", "*"), int(self.options.get("first_bytes", TAIL_BYTES)))


def log_lines(spark: SparkSession, folder: str, pattern: str = "*", first_bytes: int = TAIL_BYTES) -> DataFrame:
    """A stream of the lines of growing logs: path, at (the byte where the line begins, its order in the file) and line without colour codes; places are kept in the query's checkpoint."""
    spark.dataSource.register(LogTail)
    lines = spark.readStream.format("log_tail").option("pattern", pattern).option("first_bytes", str(first_bytes)).load(folder)
    return lines.withColumn("line", F.regexp_replace("line", r"\x1b\[[^A-Za-z]*[A-Za-z]", ""))
