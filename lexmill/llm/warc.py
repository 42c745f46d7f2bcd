"""WARC as a Python data source.

Writing rolls gzip archives, one member per record, whose extra field ``sl`` holds the member's lengths.
Reading plans one partition for each bundle of archives, pushes record-type and header predicates into the
scan, inflates a record's headers first and steps over the rest of a member that no one asked for. Archives of
other writers, gzip members without lengths or plain, are read too: a record that no one asked for is then
inflated in passing but not kept.
"""

from __future__ import annotations

import gzip
import io
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

#: Header fields that become columns, by column.
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_length": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} {'bigint' if c == 'payload_length' else 'string'}" for c in FIELDS) + ", payload binary"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "_manifest"
#: Names the fields of a record whose values are percent-encoded, because a header line cannot hold them as they are.
ENCODED = "X-Percent-Encoded"
#: Longest header block of a record.
MAX_HEAD = 1 << 20
#: Bytes after which a writer starts another archive, and that one reading task is given.
ROLL, BUNDLE = 32 << 20, 32 << 20
#: Bytes of rows gathered before a batch goes to Spark.
BATCH = 8 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _plain(value: str) -> bool:
    """Whether a header line can hold the value as it is."""
    return value == value.strip() and value.isprintable()


def member(headers: dict[str, str | None], block: bytes) -> bytes:
    """One record as a gzip member with its lengths in the extra field."""
    there = {k: v for k, v in headers.items() if v is not None}
    if odd := [k for k, v in there.items() if not _plain(v)]:
        there |= {k: urllib.parse.quote(there[k], safe="", errors="surrogatepass") for k in odd} | {ENCODED: " ".join(odd)}
    head = "".join(f"{k}: {v}\r\n" for k, v in there.items())
    raw = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    start = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"
    extra = b"sl" + struct.pack("<HII", 8, len(body) + 32, len(raw) & 0xFFFFFFFF)
    return start + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _headers(head: bytes) -> dict[str, str]:
    """Fields of a record by their usual spelling; a line that starts with a blank goes on with the one before."""
    lines: list[str] = []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    known = {x.lower(): x for x in (*FIELDS.values(), "Content-Length", "Content-Type", ENCODED)}
    out = {}
    for k, colon, v in (line.partition(":") for line in lines):
        if colon:
            out[known.get(k.strip().lower(), k.strip())] = v.strip()
    return out | {k: urllib.parse.unquote(out[k], errors="surrogatepass") for k in out.get(ENCODED, "").split() if k in out}


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP headers of an HTTP block; other blocks are payloads themselves."""
    if not headers.get("Content-Type", "application/http").startswith("application/http"):
        return block
    return block.partition(b"\r\n\r\n")[2]


def records(f, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and payload of the records that ``wanted(headers)`` accepts.

    Of other members with lengths only the first inflated kilobytes, up to the end of the headers, are read.
    A damaged record that is read whole raises; so does an archive that ends inside a record.
    """
    at = f.tell()
    while start := f.read(24):
        if start[:4] != b"\x1f\x8b\x08\x04" or start[12:14] != b"sl":
            f.seek(at)
            yield from _stream_records(gzip.GzipFile(fileobj=f) if start[:2] == b"\x1f\x8b" else f, wanted, with_payload)
            return
        # the prefix of a member is 24 bytes and its trailer 8: the lengths count both
        left = struct.unpack("<I", start[16:20])[0] - 32
        body = f.read(min(left, 2048))
        unpacker = zlib.decompressobj(-15)
        raw = unpacker.decompress(body, 4096)
        while b"\r\n\r\n" not in raw:
            more = unpacker.unconsumed_tail or f.read(min(left - (f.tell() - at - 24), 4096))
            if not more:
                raise ValueError("a record without an end of headers")
            raw += unpacker.decompress(more, 4096)
        head, _, block = raw.partition(b"\r\n\r\n")
        headers = _headers(head)
        if wanted(headers):
            payload = None
            if with_payload:
                rest = unpacker.decompress(unpacker.unconsumed_tail) + unpacker.decompress(f.read(left - (f.tell() - at - 24))) + unpacker.flush()
                if struct.unpack("<I", f.read(8)[:4])[0] != zlib.crc32(rest, zlib.crc32(raw)):
                    raise ValueError("a record whose bytes do not match its checksum")
                payload = _payload(headers, (block + rest)[: int(headers["Content-Length"])])
            yield headers, payload
        at += left + 32
        f.seek(at)


def _stream_records(f, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """As ``records``, of a stream of plain records; gzip checks the sums of its members."""
    while True:
        line = f.readline()
        while line in (b"\r\n", b"\n"):
            line = f.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = line
        while (line := f.readline()) not in (b"\r\n", b"\n"):
            head += line
            if not line or len(head) > MAX_HEAD:
                raise ValueError("a record without an end of headers")
        headers = _headers(head.replace(b"\r\n", b"\n").replace(b"\n", b"\r\n").rstrip())
        size, keep = int(headers["Content-Length"]), wanted(headers)
        block, left = [], size
        while left:
            part = f.read(min(left, 1 << 20))
            if not part:
                raise ValueError("an archive that ends inside a record")
            left -= len(part)
            if keep and with_payload:
                block.append(part)
        if keep:
            yield headers, _payload(headers, b"".join(block)) if with_payload else None


@dataclass
class Bundle(InputPartition):
    files: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, int], ...]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool):
        self.path, self.with_payload, self.tests = path, with_payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            kind = {EqualTo: "is", In: "in", StringStartsWith: "starts", IsNotNull: "there"}.get(type(f))
            if kind and column in FIELDS and column != "payload_length":
                self.tests.append((FIELDS[column], kind, getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        for field, kind, value in self.tests:
            own = headers.get(field)
            if own is None or not (kind == "there" or kind == "is" and own == value or kind == "in" and own in value or kind == "starts" and own.startswith(value)):
                return False
        return True

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = _open(self.path)
        if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                listed = [line.split("\t") for line in f.read().decode().splitlines()]
        else:  # archives of other writers
            found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            listed = [(x.path[len(root.rstrip("/")) + 1 :], x.size) for x in found if x.type == pafs.FileType.File and x.path.endswith((".warc", ".warc.gz"))]
        out, own, size = [], [], 0
        for name, n in sorted(listed, key=lambda x: (-int(x[1]), x[0])):
            if own and size + int(n) > BUNDLE:
                out.append(Bundle(tuple(own)))
                own, size = [], 0
            own.append(name)
            size += int(n)
        return [*out, Bundle(tuple(own))] if own else out or [Bundle(())]

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        fs, root = _open(self.path)
        kinds = [pa.int64() if c == "payload_length" else pa.string() for c in FIELDS] + [pa.binary()]
        names = [*FIELDS, "payload"]
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for name in partition.files:
            with fs.open_input_file(f"{root}/{name}") as plain:
                for headers, payload in records(io.BufferedReader(plain, 1 << 16), self.wanted, self.with_payload):
                    values = [headers.get(h) for h in FIELDS.values()]
                    length = values[list(FIELDS).index("payload_length")]
                    values[list(FIELDS).index("payload_length")] = int(length) if length is not None else None if payload is None else len(payload)
                    rows.append((*values, payload))
                    size += 500 + len(payload or b"")
                    if size > BATCH:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        done, out, name, size = [], None, "", 0
        for batch in iterator:
            columns = [batch.column(c) for c in [*FIELDS, "payload"]]
            for i in range(batch.num_rows):
                values = [c[i].as_py() for c in columns]
                headers = {h: None if v is None else str(v) for h, v in zip(FIELDS.values(), values, strict=False)}
                block = HTTP_HEAD + (values[-1] or b"")
                if out is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                made = member(headers | {"Content-Type": "application/http; msgtype=response"}, block)
                out.write(made)
                size += len(made)
                if size >= ROLL:
                    out.close()
                    done.append((name, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size))
        return Written(tuple(done))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Only archives of tasks that succeeded are listed, so those of lost attempts are never read."""
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}", compression=None) as f:
            f.write("".join(f"{name}\t{n}\n" for m in messages if m for name, n in m.files).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                fs.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    """Options: path (a folder that all executors see), payload ("false": leave payloads undecoded and null)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 100) -> DataFrame:
    """A record for each page, in the data source's columns.

    Pages whose payloads (html in UTF-8; null: empty) are equal and have at least ``revisit_from`` bytes: the
    smallest id's is ``response`` and the others ``revisit`` it, without a payload of their own. Every row
    with that smallest id is a response. A null id counts as larger than any; if all ids are null, all are
    responses. Equal payloads meet as digests: their smallest id is aggregated on the map side and joined
    back, so a page that a third of the rows repeat moves no payload twice.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= revisit_from
    first = pages.where(large).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    d = pages.join(first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return d.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        F.octet_length("payload").cast("bigint").alias("payload_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_warc(records_: DataFrame, path: str) -> None:
    """Write records (the columns of SCHEMA) as archives under ``path``. An empty table writes an empty manifest."""
    register(records_.sparkSession)
    records_.select(*FIELDS, "payload").write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
