"""Lines appended to growing files, as a stream whose offsets are bytes of each file."""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tessella.plans.lineage import ensure_checkpoint_dir
from tessella.registry import query
from tessella.sources.views import Views

SCHEMA = "file string, offset long, line string"
#: Bytes of a partition, and of a piece that is read at a time.
PART, PIECE = 64 << 20, 1 << 16


class Part(InputPartition):
    """Bytes ``start`` to ``end`` of a file; lines that begin there are its own."""

    def __init__(self, file: str, start: int, end: int, first: int):
        self.file, self.start, self.end, self.first = file, start, end, first


def opened(uri: str):
    """The file system that a folder's URI names, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def end_of_lines(handle, low: int, size: int) -> int:
    """Just after the last line end between ``low`` and ``size``, looked for from the end; ``low`` if there is none."""
    at = size
    while at > low:
        start = max(low, at - PIECE)
        handle.seek(start)
        found = handle.read(at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return low


class TailReader(DataSourceStreamReader):
    """Offsets are ``{file: bytes}``: what lies before is read, up to the end of a line. A half line waits for its end.

    A file that is shorter than what was read of it is a new one, read from its beginning. A file that is gone keeps no offset.
    """

    def __init__(self, options: dict):
        self.uri, self.names = options["path"], options.get("names", "*")
        self.part = int(options.get("partBytes", PART))
        self.from_end = options.get("from", "beginning") == "end"
        self.known: dict[str, int] = {}

    def sizes(self) -> dict[str, int]:
        from pyarrow import fs

        system, root = opened(self.uri)
        if system.get_file_info(root).type == fs.FileType.NotFound:
            return {}
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return {f.path: f.size for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.names) and not f.base_name.startswith((".", "_"))}

    def _ends(self, known: dict[str, int]) -> dict[str, int]:
        system, _ = opened(self.uri)
        out = {}
        for path, size in sorted(self.sizes().items()):
            low = known.get(path, 0)
            low = 0 if low > size else low
            if low == size:
                out[path] = low
                continue
            with system.open_input_file(path) as handle:
                out[path] = end_of_lines(handle, low, size)
        return out

    def initialOffset(self) -> dict:
        return self._ends({}) if self.from_end else {}

    def latestOffset(self) -> dict:
        self.known = self._ends(self.known)
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Part]:
        parts = []
        for path, to in sorted(end.items()):
            first = start.get(path, 0)
            first = 0 if first > to else first
            parts += [Part(path, at, min(at + self.part, to), first) for at in range(first, to, self.part)]
        return parts

    def read(self, partition: Part) -> Iterator[tuple]:
        """The lines that begin in the partition; one that a partition's end cuts is read to its end."""
        system, _ = opened(self.uri)
        with system.open_input_file(partition.file) as handle:
            at = partition.start
            if at > partition.first:  # a line that began before is the partition's before
                handle.seek(at - 1)
                at = at - 1 + len(self._line(handle, at - 1))
            while at < partition.end:
                line = self._line(handle, at)
                yield partition.file, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    @staticmethod
    def _line(handle, at: int) -> bytes:
        handle.seek(at)
        out = b""
        while (piece := handle.read(PIECE)) and (end := piece.find(b"\n")) < 0:
            out += piece
        return out + piece[: end + 1] if piece else out

    def commit(self, end: dict) -> None:
        """Nothing is held that a batch's end would free."""


class Tail(DataSource):
    """``spark.readStream.format("tail").option("path", folder)``; options ``names`` (a pattern), ``partBytes``, ``from`` (beginning, end)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def appended(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """A stream of ``(file, offset, line)``: each line that was appended to the files of ``folder``, once."""
    spark.dataSource.register(Tail)
    return spark.readStream.format("tail").options(path=folder, **{k: str(v) for k, v in options.items()}).load()


def take_appended(spark: SparkSession, folder: str, target: str, progress: str, **options: object) -> None:
    """Adds what was appended since the last call to ``target`` (Parquet); a run that is broken off is repeated without doubling."""
    stream = appended(spark, folder, **options).writeStream.format("parquet").option("path", target).option("checkpointLocation", progress)
    stream.trigger(availableNow=True).start().awaitTermination()


@query("""SELECT 'lines' AS kind, conv_id, turn, role, md5(text) AS text_md5 FROM conversations""")
def appended_traces(v: Views) -> DataFrame:
    """Conversations as JSON lines that grow: half of them are there at first, the rest comes between two runs."""
    spark, home = v.spark, f"{ensure_checkpoint_dir(v.spark)}/appended-{uuid.uuid4().hex}"
    rows = v.table("conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"), (F.col("conv_id") % 2).alias("half"))
    for half in (0, 1):
        rows.where(F.col("half") == half).select("value").write.mode("append").text(f"{home}/traces")
        take_appended(spark, f"{home}/traces", f"{home}/rows", f"{home}/progress", names="*.txt")
    read = spark.read.parquet(f"{home}/rows").select(F.from_json("line", "conv_id long, turn long, role string, text string").alias("r"))
    return read.select(F.lit("lines").alias("kind"), "r.conv_id", "r.turn", "r.role", F.md5(F.encode("r.text", "utf-8")).alias("text_md5"))
