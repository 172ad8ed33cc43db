"""WARC archives as a Spark data source, written and read in Python.

A record is a gzip member of its own, whose header tells how long the member is (the ``sl`` extra field). The reader inflates a record's
first bytes, parses its headers and tests the pushed filters on them; the rest of an unwanted record is sought over.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull,
    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)

SCHEMA = ("record_id string, record_type string, target_uri string, date string, payload_digest string, payload_length long, "
          "refers_to string, payload binary")
#: Named fields of a record by column.
FIELDS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length", "refers_to": "WARC-Refers-To"}
TEXTS = [c for c in FIELDS if c != "payload_length"]
BREAK = b"\r\n\r\n"
#: What is read of a record to find its headers, and how much a batch of rows may hold.
FIRST, BATCH_BYTES = 2048, 8 << 20


def filesystem(path: str):
    """The file system and the path in it; any that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def clean(value) -> str:
    """A header value without line breaks and other control characters, which are written as percent codes."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(value))


def member(record: bytes) -> bytes:
    """The record as a gzip member with its own length in the ``sl`` field (0 where four bytes can't hold it: unknown)."""
    packer = zlib.compressobj(3, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(record) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    known = (size, len(record)) if max(size, len(record)) < 1 << 32 else (0, 0)
    return (b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, *known) + body
            + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF))


def record_of(row: dict) -> bytes:
    payload = b"" if row["record_type"] == "revisit" else row["payload"] or b""
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % length + BREAK + payload
    named = {FIELDS[c]: row[c] for c in TEXTS if row[c] is not None} | {FIELDS["payload_length"]: length}
    named |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in named.items()) + "\r\n"
    return head.encode() + block + BREAK


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Files go to a temporary folder beside the archive; only those of tasks that the job takes are moved into it."""

    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes, self.job = path.rstrip("/"), file_bytes, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        system, root = filesystem(self.path)
        folder, out, names, size = f"{root}/_temporary/{self.job}", None, [], 0
        system.create_dir(folder, recursive=True)
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.file_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                data = member(record_of(row))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        system, root = filesystem(self.path)
        for message in messages:
            for name in message.names if message else []:
                system.move(f"{root}/_temporary/{self.job}/{name}", f"{root}/{name}")
        self._drop(system, root)

    def abort(self, messages) -> None:
        self._drop(*filesystem(self.path))

    def _drop(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/_temporary/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/_temporary/{self.job}")


@dataclass
class Files(InputPartition):
    names: list[str]


def accepts(filters: list[Filter], values: dict) -> bool:
    """Do all filters hold for a record's header values?"""
    for f in filters:
        value = values[f.attribute[0]]
        if isinstance(f, IsNull):
            ok = value is None
        elif isinstance(f, EqualNullSafe):
            ok = value == f.value
        elif value is None:
            ok = False
        elif isinstance(f, EqualTo):
            ok = value == f.value
        elif isinstance(f, In):
            ok = value in f.value
        elif isinstance(f, StringStartsWith):
            ok = value.startswith(f.value)
        elif isinstance(f, StringEndsWith):
            ok = value.endswith(f.value)
        elif isinstance(f, StringContains):
            ok = f.value in value
        else:
            ok = True  # IsNotNull
        if not ok:
            return False
    return True


def header_values(head: bytes) -> dict:
    named = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, colon, v = line.partition(":")
        if colon:
            named[k.strip().lower()] = v.strip()
    values = {c: named.get(FIELDS[c].lower()) for c in FIELDS}
    length = values["payload_length"]
    return values | {"payload_length": int(length) if length and length.isdigit() else None, "content_type": named.get("content-type", "")}


def payload_of(block: bytes, values: dict) -> bytes:
    """The block without its HTTP headers; all of it where the record holds no HTTP message."""
    return block.partition(BREAK)[2] if values["content_type"].startswith("application/http") else block


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, part_bytes: int):
        self.path, self.payload, self.part_bytes, self.filters = path.rstrip("/"), payload, part_bytes, []

    def pushFilters(self, filters):
        for f in filters:
            strings = isinstance(f, (EqualTo, EqualNullSafe, In, StringStartsWith, StringEndsWith, StringContains, IsNull, IsNotNull))
            if strings and len(f.attribute) == 1 and f.attribute[0] in TEXTS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Files, small ones together. Writers bound files, so a file is what a task can take."""
        from pyarrow import fs

        system, root = filesystem(self.path)
        found = [x for x in system.get_file_info(fs.FileSelector(root)) if x.is_file and x.base_name.endswith((".warc.gz", ".warc"))]
        parts, size = [], 0
        for x in sorted(found, key=lambda x: x.base_name):
            if not parts or size + x.size > self.part_bytes:
                parts.append(Files([]))
                size = 0
            parts[-1].names.append(x.path)
            size += x.size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([(c, pa.int64() if c == "payload_length" else pa.string()) for c in FIELDS] + [("payload", pa.binary())])
        system, _ = filesystem(self.path)
        rows, size = [], 0
        for name in partition.names:
            with system.open_input_file(name) as file:
                for row in (self._members if name.endswith(".gz") else self._plain)(file):
                    rows.append(row)
                    size += 300 + len(row["payload"] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _members(self, file) -> Iterator[dict]:
        """Records of a file of gzip members."""
        at, end = 0, file.size()
        while at < end:
            file.seek(at)
            first = file.read(FIRST)
            flags, body, length = first[3], 10, 0
            if flags & 4:
                (extra,) = struct.unpack_from("<H", first, 10)
                field, body = 12, 12 + extra
                while field + 4 <= body and body <= len(first):
                    tag, n = struct.unpack_from("<2sH", first, field)
                    if tag == b"sl" and n == 8:
                        (length,) = struct.unpack_from("<I", first, field + 4)
                    field += 4 + n
            if length:
                inflate = zlib.decompressobj(-zlib.MAX_WBITS)
                data, more = inflate.decompress(first[body:length]), len(first)
            else:  # another writer's member
                inflate = zlib.decompressobj(zlib.MAX_WBITS | 16)
                data, more = inflate.decompress(first), len(first)
            while BREAK not in data and not inflate.eof and (some := file.read(FIRST)):
                data, more = data + inflate.decompress(some), more + len(some)
            head, _, block = data.partition(BREAK)
            values = header_values(head)
            wanted = accepts(self.filters, values)
            if length and not (wanted and self.payload):
                at += length
            else:
                kept = [block]
                while not inflate.eof and (some := file.read(max(FIRST, length - more) if length else 1 << 16)):
                    more += len(some)
                    data = inflate.decompress(some)
                    if wanted and self.payload:
                        kept.append(data)
                at += length or more - len(inflate.unused_data)
                block = b"".join(kept)
            if wanted and head.startswith(b"WARC/"):
                yield self._row(values, block[:-len(BREAK)])

    def _plain(self, file) -> Iterator[dict]:
        """Records of a file that isn't compressed."""
        at, end = 0, file.size()
        while at < end:
            file.seek(at)
            data = file.read(FIRST)
            while BREAK not in data and (some := file.read(FIRST)):
                data += some
            head, _, _ = data.partition(BREAK)
            values = header_values(head)
            length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
            start = at + len(head) + len(BREAK)
            if head.startswith(b"WARC/") and accepts(self.filters, values):
                block = b""
                if self.payload:
                    file.seek(start)
                    block = file.read(length)
                yield self._row(values, block)
            at = start + length + len(BREAK)

    def _row(self, values: dict, block: bytes) -> dict:
        row = {c: values[c] for c in FIELDS} | {"payload": payload_of(block, values) if self.payload else None}
        if self.payload and row["payload_length"] is None:
            row["payload_length"] = len(row["payload"])
        return row


class WarcSource(DataSource):
    """Options: path; payload (true): whether payloads are read; part_bytes: bytes a task reads; file_bytes: at which a new file begins."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true", int(self.options.get("part_bytes", 128 << 20)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", 256 << 20)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_warc(records: DataFrame, path: str) -> None:
    """Append records (columns of SCHEMA) to the archive at ``path``. Control characters in header values become percent codes."""
    register(records.sparkSession)
    records.select(*[c.split(" ")[0] for c in SCHEMA.split(", ")]).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The archive's records. Filters on header columns are tested before payloads are inflated; ``payload`` False reads headers only."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_records(pages: DataFrame, least: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A record for each page (page_id, url, html): of equal payloads of at least ``least`` bytes the one with the largest page_id is the
    response, the others revisit it; smaller ones are all responses.

    Payloads are the html in UTF-8 (NULL: empty), equal by SHA-1 and length. A NULL page_id counts as the least; rows of one page_id
    and payload are all responses where it is the largest. Pages carry no time, so ``date`` is the caller's.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({
        "_digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    # copies only: a row for each payload that occurs more than once, out of narrow partial aggregates
    first = rows.filter(F.col("payload_length") >= least).groupBy(F.col("_digest").alias("_d")) \
        .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    revisit = F.col("_first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("_first")))
    named = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    # short payloads, which are often equal, match none: each goes by its own key
    key = F.when(F.col("payload_length") >= least, F.col("_digest")).otherwise(F.concat(F.lit("page "), F.xxhash64("page_id", "url").cast("string")))
    return rows.withColumn("_key", key).join(first, F.col("_key") == F.col("_d"), "left").select(
        named(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.concat(F.lit("sha1:"), "_digest").alias("payload_digest"), "payload_length",
        F.when(revisit, named(F.col("_first"))).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"))


def page_id_of(record_id: Column) -> Column:
    return F.substring_index(record_id, ":", -1).try_cast("long")
