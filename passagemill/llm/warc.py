"""WARC archives as a data source of Spark, for writing and for reading.

Reading plans one partition per run of archive files. Conditions on the record
type and on headers reach the reader: it reads a record's headers first, and
unpacks the payload only of records that pass. The archives written here tell
the packed length of each record in the gzip header's extra field, so the rest
of an unwanted record is stepped over; archives without it are read as well.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from passagemill.llm.common import broadcast_if_small, salted
from passagemill.llm.files import fresh_file, open_file, store_of
from passagemill.session import new_path

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_bytes bigint, payload binary"
)
COLUMNS = [part.split(" ")[0] for part in SCHEMA.split(", ")]
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
FIRST_BYTES = 4096  # unpacked at first, to see the headers


def packed(record: bytes) -> bytes:
    """One gzip member that tells its own length in an extra field of id "PL"."""
    deflate = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHQ", 12, b"PL", 8, size) + body + tail


def record_of(row: dict) -> bytes:
    """A record with an HTTP response; a revisit has its headers only."""
    payload = row["payload"] if row["record_type"] == "response" else b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    heads = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<{row['record_id']}>",
        "WARC-Date": row["date"],
        "WARC-Target-URI": row["target_uri"],
        "WARC-Payload-Digest": row["payload_digest"],
        "Content-Type": "application/http; msgtype=response",
    }
    if row["refers_to"] is not None:
        heads |= {"WARC-Refers-To": f"<{row['refers_to']}>", "WARC-Profile": PROFILE}
    # A line break in a value would end its header.
    lines = [f"{k}: {v}".replace("\r", "%0D").replace("\n", "%0A") for k, v in heads.items() if v is not None]
    lines.append(f"Content-Length: {len(http) + len(payload)}")
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + END + http + payload + END


def headers_of(lines: bytes) -> dict[str, str]:
    found = {}
    for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def values_of(head: dict[str, str]) -> dict[str, str | None]:
    values = {column: head.get(name) for column, name in HEADERS.items()}
    for column in ("record_id", "refers_to"):
        if values[column]:
            values[column] = values[column].removeprefix("<").removesuffix(">")
    return values


class Member:
    """A gzip member that is unpacked as far as it is asked for."""

    def __init__(self, stream, at: int):
        self.stream, self.at = stream, at
        stream.seek(at)
        first = stream.read(24)
        self.size = None
        if first[3:4] == b"\x04" and first[12:14] == b"PL":
            self.size = struct.unpack("<Q", first[16:24])[0]
        stream.seek(at)
        self.unzip, self.out, self.waiting, self.eaten = zlib.decompressobj(31), bytearray(), b"", 0

    def have(self, size: int | None) -> bytearray:
        """Unpack ``size`` bytes, or all."""
        while not self.unzip.eof and (size is None or len(self.out) < size):
            if not self.waiting:
                left = FIRST_BYTES if size is not None else 1 << 20
                self.waiting = self.stream.read(left if self.size is None else min(left, self.size - self.eaten))
                self.eaten += len(self.waiting)
                if not self.waiting:
                    raise ValueError("an archive ends inside a record")
            self.out += self.unzip.decompress(self.waiting, 0 if size is None else max(1, size - len(self.out)))
            self.waiting = self.unzip.unconsumed_tail
        return self.out

    def end(self) -> int:
        if self.size is not None:
            return self.at + self.size
        while not self.unzip.eof:
            self.have(len(self.out) + (1 << 16))
            self.out.clear()
        return self.at + self.eaten - len(self.unzip.unused_data)


def body_of(block: bytes, kind: str | None) -> tuple[int | None, bytes | None]:
    """Length that the HTTP headers tell, and the payload; the whole block if it has no HTTP headers."""
    if not block.startswith(b"HTTP/"):
        return len(block), block
    head, _, payload = block.partition(END)
    told = headers_of(head).get("content-length")
    size = int(told) if told and told.isdigit() else None
    if kind == "revisit":
        return size, None
    return (len(payload) if size is None else size), payload


def records(path: str, wanted, with_payload: bool) -> Iterator[dict]:
    """Records of an archive that ``wanted`` accepts by their header values."""
    with open_file(path) as stream:
        size, at = stream.size(), 0
        while at < size:
            member = Member(stream, at)
            need = FIRST_BYTES
            while (cut := member.have(need).find(END)) < 0:
                if member.unzip.eof:
                    raise ValueError(f"a record without headers in {path}")
                need *= 2
            head = headers_of(bytes(member.out[:cut]))
            values = values_of(head)
            if wanted(values):
                start, length = cut + len(END), int(head.get("content-length") or 0)
                if with_payload or values["record_type"] == "revisit":
                    block = bytes(member.have(start + length)[start : start + length])
                    values["payload_bytes"], values["payload"] = body_of(block, values["record_type"])
                else:
                    block = bytes(member.have(min(start + length, start + 1024))[start : start + length])
                    values["payload_bytes"], values["payload"] = body_of(block, values["record_type"])[0], None
                    if not block.startswith(b"HTTP/"):
                        values["payload_bytes"] = length
                yield values
            at = member.end()


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partitionBytes", 128 << 20))
        self.conditions: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        """Take equality, lists and prefixes on header values; Spark applies the rest."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, EqualNullSafe)):
                self.conditions.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.conditions.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.conditions.append((column, "prefix", (f.value,)))
            else:
                yield f

    def partitions(self):
        """Files in order, as many in a partition as fit its size."""
        store, inside = store_of(self.path)
        found = store.get_file_info(fs.FileSelector(inside, recursive=False))
        out, run, size = [], [], 0
        for info in sorted(found, key=lambda i: i.path):
            if info.type != fs.FileType.File or not info.base_name.endswith(".warc.gz"):
                continue
            if run and size + info.size > self.partition_bytes:
                out.append(Files(tuple(run)))
                run, size = [], 0
            run.append(f"{self.path.rstrip('/')}/{info.base_name}")
            size += info.size
        return [*out, Files(tuple(run))] if run or not out else out

    def wanted(self, values: dict) -> bool:
        for column, how, given in self.conditions:
            value = values[column]
            if how == "in" and value not in given:
                return False
            if how == "prefix" and not (value or "").startswith(given[0]):
                return False
        return True

    def read(self, partition):
        rows, size = [], 0
        for path in partition.paths:
            for values in records(path, self.wanted, self.with_payload):
                rows.append(values)
                size += len(values["payload"] or b"") + 200
                if size > 8 << 20:
                    yield self.batch(rows)
                    rows, size = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}
        return pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in COLUMNS], COLUMNS
        )


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class Writer(DataSourceArrowWriter):
    """Each task writes one file under a temporary name; only those of tasks that count get their own."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        path, stream = fresh_file(self.path, ".open")
        with stream:
            for batch in iterator:
                for row in batch.to_pylist():
                    stream.write(packed(record_of(row)))
        return Written(path)

    def commit(self, messages):
        for message in messages:
            if message is not None:
                store, inside = store_of(message.path)
                store.move(inside, inside.removesuffix(".open") + ".warc.gz")

    def abort(self, messages):
        for message in messages:
            if message is not None:
                store, inside = store_of(message.path)
                store.delete_file(inside)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records below ``path``; without ``payload`` no payload is unpacked and the column is null."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_warc(records: DataFrame, path: str) -> None:
    """Write rows of the schema of :func:`read_warc` as gzipped WARC 1.1 archives."""
    records.sparkSession.dataSource.register(WarcSource)
    kept = records.select(*[F.col(c).cast("binary") if c == "payload" else c for c in COLUMNS])
    kept.write.format("warc").mode("append").save(path)


def page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("urn:page:"), page_id.cast("string"))


def page_of(urn: Column, kind: str) -> Column:
    return F.nullif(F.regexp_extract(urn, r"^urn:page:(.*)$", 1), F.lit("")).cast(kind)


@dataclass(frozen=True)
class WarcOptions:
    revisit_bytes: int = 100
    date: str = "2026-01-01T00:00:00Z"
    broadcast_payloads: int = 200_000


def page_records(pages: DataFrame, options: WarcOptions, id_col="page_id", url="url", html="html") -> DataFrame:
    """Pages as records: of equal payloads that are long enough the smallest id is the response, others revisit it.

    A null html is an empty payload; a null id cannot be referred to and a
    page with one is a response; rows that repeat the smallest id are all
    responses. Only digests are shuffled, counted map-side first, unless the
    repeated ones pass ``broadcast_payloads``.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url).alias("target_uri"), payload.alias("payload")
    ).withColumns({"digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("bigint")})
    long = rows.filter(F.col("payload_bytes") >= options.revisit_bytes)
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated, small = broadcast_if_small(
        firsts.filter("n > 1 AND first IS NOT NULL").select("digest", "first"), options.broadcast_payloads, "payloads"
    )
    joined = rows.join(repeated, "digest", "left") if small else salted(rows, repeated, ["digest"], "left")
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.lit(False))
    return joined.select(
        F.coalesce(page_urn(F.col("page_id")), F.lit("urn:page:")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(options.date).alias("date"),
        F.when(revisit, page_urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"),
        "payload_bytes",
        "payload",
    )


def archive_pages(pages: DataFrame, options: WarcOptions | None = None, **names) -> str:
    """Write pages to archives in the shared folder; returns the folder."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(page_records(pages, options or WarcOptions(), **names), path)
    return path


def archived_pages(spark: SparkSession, path: str, id_kind: str = "bigint") -> DataFrame:
    """Pages as the archives tell them; size and digest of a response come from its payload itself."""
    responses = read_warc(spark, path).filter("record_type = 'response'").withColumns(
        {"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha2("payload", 256)}
    )
    revisits = read_warc(spark, path, payload=False).filter("record_type = 'revisit'").withColumn(
        "payload_digest", F.regexp_extract("payload_digest", "^sha256:(.*)$", 1)
    )
    columns = ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    every = responses.select(*columns).union(revisits.select(*columns))
    return every.select(
        page_of(F.col("record_id"), id_kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of(F.col("refers_to"), id_kind).alias("refers_to"),
    )
