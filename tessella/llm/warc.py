"""WARC archives: payloads go as rows of chunks, into archives and out of them, and no task holds a record whole."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.arrow import arrow_rows
from tessella.plans.lineage import cut, ensure_checkpoint_dir

#: Bytes of a chunk, and chunks or lines of an Arrow batch.
CHUNK, BATCH = 1 << 18, 64
#: A payload is hot if it is that of more than one record in so many; so at most this many are hot.
HOT_SHARE = 1024
DATE = "2024-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digits of base 32 as numbers are written, and as digests are (fixed values).
DIGITS, LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

CHUNKS = "record long, page long, url string, chunk int, data binary, size long, digest string, content string, last boolean"
RECORDS = "record_id string, type string, uri string, refers_to string, declared string, declared_size long, chunk int, data binary, size long, digest string, last boolean, complete boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """The record table: a row for each chunk of a payload, numbered by record and chunk.

    ``size`` and ``digest`` (SHA-1, base 32) are those of the payload up to and with the chunk, so the last chunk has the whole
    payload's; ``content`` is the last chunk's SHA-256 of all. Digests are carried from chunk to chunk of a task's rows. An empty
    payload is one empty chunk. Record numbers are only fixed once the table is written.
    """
    payload = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    n = F.greatest(F.ceil(F.octet_length("payload") / chunk), F.lit(1)).cast("int")
    numbered = payload.select("page", "url", "payload", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    cut_up = numbered.select("page", "url", "chunk", F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("data"), (F.col("chunk") == F.col("n") - 1).alias("last"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = (TaskContext.get().partitionId() << 33) - 1
        for batch in batches:
            out: dict[str, list] = {"record": [], "size": [], "digest": [], "content": []}
            for number, data, last in zip(batch["chunk"].to_pylist(), batch["data"].to_pylist(), batch["last"].to_pylist(), strict=True):
                if number == 0:
                    record, size, sha1, sha256 = record + 1, 0, hashlib.sha1(), hashlib.sha256()
                size += len(data)
                sha1.update(data)
                sha256.update(data)
                for name, value in (("record", record), ("size", size), ("digest", base32(sha1.digest())), ("content", sha256.hexdigest() if last else None)):
                    out[name].append(value)
            columns = [pa.array(out["record"], pa.int64()), batch["page"], batch["url"], batch["chunk"], batch["data"], pa.array(out["size"], pa.int64()), pa.array(out["digest"], pa.string()), pa.array(out["content"], pa.string()), batch["last"]]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CHUNKS.split(", ")])

    return cut_up.mapInArrow(digested, CHUNKS)


def roles(records: DataFrame, least: int = 0, hot_share: int = HOT_SHARE) -> DataFrame:
    """``records`` (a row each) with ``first``: the record, by page and number, that a revisit refers to; null for responses.

    Of equal payloads of at least ``least`` bytes, the record of the largest page is the response. Largest pages are aggregated
    before their shuffle. Payloads of more than a ``1 / hot_share`` part of all records meet their records by a broadcast of
    fewer than ``hot_share`` rows, others in a join.
    """
    records = cut(records)
    order = F.struct(F.col("page").isNotNull().alias("known"), "page", "record")
    groups = cut(records.where(F.col("size") >= least).groupBy("content").agg(F.max(order).alias("best"), F.count("*").alias("n")).where("n > 1"))
    limit = max(1, records.count() // hot_share)
    hot, others = groups.where(F.col("n") > limit).select("content", F.col("best").alias("hot")), groups.where(F.col("n") <= limit).select("content", F.col("best").alias("cold"))
    met = records.join(F.broadcast(hot), "content", "left")
    rest = met.where("hot IS NULL").join(others, "content", "left").withColumn("best", F.col("cold"))
    every = met.where("hot IS NOT NULL").withColumn("best", F.col("hot")).select(*records.columns, "best").union(rest.select(*records.columns, "best"))
    return every.select(*records.columns, F.when(F.col("best.record") != F.col("record"), F.struct("best.page", "best.record")).alias("first"))


def urn(page: Column, record: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), record.cast("string"), F.lit(">"))


def head(*fields: tuple[str, Column | str]) -> Column:
    """A record's header; fields whose value is null are left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value.cast("string"), F.lit("\r\n")), F.lit("")) for name, value in fields]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"))


def http_head(size: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))


def write_warc(pages: DataFrame, path: str, least: int = 0, chunk: int = CHUNK, date: str = DATE, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Archives of ``pages`` in the folder ``path``: a response for each payload, revisits of it for its copies.

    The record table is written first; types are found from its last chunks alone, and the payloads of responses are shuffled once,
    by record, so that no key is hot. A payload of several chunks becomes a segmented record (continuations follow in the
    same file), so what is written is a row of ``chunk`` bytes and a header. Spark's writer commits the files, gzipped.

    Null payloads are empty, null ids come after all others. A repeated id is a record of its own. White space and control
    characters of a URL are percent-encoded; a null URL is left out. An empty table gives archives without records.
    """
    spark = pages.sparkSession
    table = f"{path}/chunks"
    with arrow_rows(spark, BATCH):
        chunk_rows(pages, id_col, url_col, payload_col, chunk).write.option("compression", "zstd").parquet(table)
    chunks = spark.read.parquet(table)
    typed = cut(roles(chunks.where("last").select("record", "page", "url", "size", "digest", "content"), least))
    uri = F.transform(F.split("url", ""), lambda c: F.when(c.rlike(r"[\x00-\x20\x7f]"), F.concat(F.lit("%"), F.hex(F.encode(c, "utf-8")))).otherwise(c))
    odd = F.when(F.col("url").rlike(r"[\x00-\x20\x7f]"), F.array_join(uri, "")).otherwise(F.col("url"))
    own, first = urn(F.col("page"), F.col("record")), urn(F.col("first.page"), F.col("first.record"))
    digest, front = F.concat(F.lit("sha1:"), F.col("digest")), http_head(F.col("size"))
    http = "application/http; msgtype=response"

    revisit = head(("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", odd), ("WARC-Profile", IDENTICAL), ("WARC-Refers-To", first), ("WARC-Payload-Digest", digest), ("Content-Type", http), ("Content-Length", F.octet_length(front)))
    typed.where("first IS NOT NULL").select(F.concat(revisit, front).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(f"{path}/revisits")

    answers = typed.where("first IS NULL").select("record", "page", "url", "size", "digest")
    placed = chunks.select("record", "chunk", "data", "last").repartition("record").join(answers, "record")
    segments = F.col("size") > F.lit(chunk)
    length = F.octet_length("data")
    begins = head(("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", odd), ("WARC-Payload-Digest", digest), ("WARC-Segment-Number", F.when(segments, F.lit(1))), ("Content-Type", http), ("Content-Length", F.octet_length(front) + length))
    goes_on = head(
        ("WARC-Type", "continuation"),
        ("WARC-Record-ID", F.regexp_replace(own, ">", F.concat(F.lit(":"), F.col("chunk").cast("string"), F.lit(">")))),
        ("WARC-Date", date),
        ("WARC-Segment-Origin-ID", own),
        ("WARC-Segment-Number", F.col("chunk") + 1),
        ("WARC-Segment-Total-Length", F.when(F.col("last"), F.octet_length(front) + F.col("size"))),
        ("Content-Length", length),
    )
    text = F.when(F.col("chunk") == 0, F.concat(begins, front)).otherwise(goes_on)
    row = F.concat(F.encode(text, "utf-8"), F.col("data")).cast("string")  # bytes as they are, whether they are UTF-8 or not
    placed.sortWithinPartitions("record", "chunk").select(row.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(f"{path}/responses")


class Reader:
    """Rows of chunks from the bytes of an archive, fed piece by piece; it holds a header or a chunk, and what was fed last."""

    def __init__(self, chunk: int = CHUNK, data: bool = True):
        self.chunk, self.with_data = chunk, data
        self.buffer = bytearray()
        self.step, self.left, self.open = self._header, 0, None

    def feed(self, piece: bytes) -> Iterator[dict]:
        self.buffer += piece
        while (rows := self.step()) is not None:
            yield from rows

    def close(self) -> Iterator[dict]:
        """The end of a file: a record that is still open was cut off."""
        if self.open is not None:
            yield self._row(b"" if self.step == self._http else bytes(self.buffer[: self.left]), last=True, complete=False)
        self.buffer.clear()
        self.step, self.left, self.open = self._header, 0, None

    @staticmethod
    def _fields(lines: bytes) -> dict[str, str]:
        pairs = (line.partition(b":") for line in re.sub(rb"\r?\n[ \t]+", b" ", lines).splitlines())
        return {name.decode("latin-1").strip().lower(): value.decode("utf-8", "replace").strip() for name, sep, value in pairs if sep}

    def _header(self) -> list[dict] | None:
        """Reads a record's header; what stands before it is skipped."""
        at = self.buffer.find(b"WARC/")
        if at < 0:
            del self.buffer[:-4]
            return None
        end = self.buffer.find(b"\r\n\r\n", at)
        if end < 0:
            return None
        fields = self._fields(bytes(self.buffer[at:end]))
        del self.buffer[: end + 4]
        self.left = int(fields.get("content-length", "0"))
        out = []
        goes_on = fields.get("warc-type") == "continuation" and self.open is not None and self.open["record_id"] == fields.get("warc-segment-origin-id")
        if self.open is not None and not goes_on:  # its last segment never came
            out.append(self._row(b"", last=True, complete=False))
        if goes_on:
            self.ends = "warc-segment-total-length" in fields
            self.step = self._body
        else:
            declared = fields.get("warc-payload-digest", "")
            self.open = {"record_id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "declared": declared.removeprefix("sha1:") or None, "declared_size": None}
            self.number, self.size, self.sha1 = 0, 0, hashlib.sha1()
            self.ends = fields.get("warc-segment-number", "") in ("", "0")
            self.step = self._http if fields.get("content-type", "").startswith("application/http") else self._body
        return out

    def _http(self) -> list[dict] | None:
        """Skips the HTTP header that stands before a payload."""
        end = self.buffer.find(b"\r\n\r\n", 0, self.left)
        if end < 0 and len(self.buffer) < self.left:
            return None
        end = self.left if end < 0 else end + 4
        size = self._fields(bytes(self.buffer[:end])).get("content-length", "")
        self.open["declared_size"] = int(size) if size.isdigit() else None
        del self.buffer[:end]
        self.left -= end
        self.step = self._body
        return []

    def _body(self) -> list[dict] | None:
        """A chunk, once it is full or the block ends; of segmented records, chunks end with the segments."""
        if len(self.buffer) < min(self.left, self.chunk):
            return None
        take = min(self.left, self.chunk)
        data = bytes(self.buffer[:take])
        del self.buffer[:take]
        self.left -= take
        done = not self.left
        rows = [self._row(data, last=done and self.ends)]
        if done:
            self.step = self._header
            if self.ends:
                self.open = None
        return rows

    def _row(self, data: bytes, last: bool, complete: bool = True) -> dict:
        self.sha1.update(data)
        self.size += len(data)
        self.number += 1
        return {**self.open, "chunk": self.number - 1, "data": data if self.with_data else None, "size": self.size, "digest": base32(self.sha1.digest()), "last": last, "complete": complete if last else None}


def read_warc(spark: SparkSession, paths: str | list[str], chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """``RECORDS``: a row for each chunk of each record of the gzipped archives in ``paths``, in the files' order.

    Spark's reader gives the lines of a file to one task in order, as gzip is not split; the task puts them together again and
    follows the lengths in the headers, so payloads may hold anything. ``size`` and ``digest`` are carried from chunk to
    chunk and through the segments of a record; the last chunk has the whole payload's. ``complete`` is false where a file ends within a
    record. With ``data`` false, payloads stay in the task. Content types of ``application/http`` have their HTTP header taken off.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"))
    kinds = [c.split() for c in RECORDS.split(", ")]
    arrow = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(name, arrow[kind]) for name, kind in kinds])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, at = Reader(chunk, data), None
        for batch in batches:
            found: list[dict] = []
            files, held = batch["file"].to_numpy(), batch["line"].to_pylist()
            ends = [*(np.flatnonzero(np.diff(files)) + 1).tolist(), len(files)] if len(files) else []
            for a, b in zip([0, *ends], ends, strict=False):
                piece = b"\n".join(held[a:b])
                if files[a] == at:
                    piece = b"\n" + piece  # whether a file's last line ends in one is not known
                elif at is not None:
                    found += reader.close()
                at = files[a]
                found += reader.feed(piece)
            yield pa.RecordBatch.from_pylist(found, schema)
        yield pa.RecordBatch.from_pylist(list(reader.close()), schema)

    return lines.mapInArrow(rows, RECORDS)


def archive_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"


def archived(pages: DataFrame, path: str | None = None, least: int = 0, chunk: int = CHUNK, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes ``pages`` as archives and reads them back: ``(<id>, payload_bytes, payload_digest, record_type, refers_to)`` for each row.

    A response's bytes and digest are counted from the payload that is read; a revisit has no payload, and names its own in its
    header. Odd rows: see ``write_warc``. Only records read to their end count.
    """
    spark = pages.sparkSession
    path = path or archive_folder(spark)
    write_warc(pages, path, least, chunk, id_col=id_col, url_col=url_col, payload_col=payload_col)
    with arrow_rows(spark, BATCH * 16):
        found = cut(read_warc(spark, [f"{path}/responses", f"{path}/revisits"], chunk, data=False).where("last AND complete AND type IN ('response', 'revisit')"))
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:([^:]*):", 1), F.lit("null")).cast("long")
    answer = F.col("type") == "response"
    return found.select(page("record_id").alias(id_col), F.when(answer, F.col("size")).otherwise(F.col("declared_size")).alias("payload_bytes"), F.when(answer, F.col("digest")).otherwise(F.col("declared")).alias("payload_digest"), F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))
