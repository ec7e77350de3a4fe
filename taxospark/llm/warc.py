"""WARC archives as a Spark data source, and their writing with revisit records for repeated payloads.

Format: one gzip member for each record, its compressed length in an extra header field ("sl", skip lengths), so a
reader can leave a record after its headers. Readers plan partitions from whole files, take over predicates on the
record type and the other header columns, parse headers first, and inflate a payload only if the record passes and
the payload is wanted. Plain archives, and gzipped ones without the extra field, with any number of records in a member
or a record over several, are read too; of the gzipped ones all records are inflated to find their ends.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from .common import fresh_path

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_bytes long, payload binary, file string, position long"
WRITTEN = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload string"
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file is closed beyond this size; a partition reads files of about this size together.
FILE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
#: Compressed bytes that are read at a time.
STEP = 1 << 16


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):  # with one slash or three
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member with its skip lengths."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\x04\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(row: dict, date: str) -> bytes:
    payload = (row["payload"] or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if row["record_type"] == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {date}"]
    if row["target_uri"]:
        lines.append("WARC-Target-URI: " + quote(row["target_uri"], safe="".join(chr(c) for c in range(0x21, 0x7F))))
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['payload_digest'])).decode()}")
    if row["refers_to"]:
        lines += [f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Tasks write files of unique names into a staging folder; the commit moves those of the tasks that succeeded."""

    def __init__(self, options: dict) -> None:
        self.path, self.date = options["path"].rstrip("/"), options.get("date", "1970-01-01T00:00:00Z")
        self.limit = int(options.get("fileBytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        fs.create_dir(f"{root}/_staging", recursive=True)
        done, out, size = [], None, 0
        for batch in iterator:
            columns = [batch.schema.names, *(c for c in batch.columns)]
            for i in range(batch.num_rows):
                data = member(record({n: c[i].as_py() for n, c in zip(columns[0], columns[1:])}, self.date))
                if out is None:
                    done.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/_staging/{done[-1]}", compression=None), 0
                out.write(data)
                size += len(data)
                if size >= self.limit:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(done)

    def commit(self, messages: list) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            for name in m.files if m else []:
                fs.move(f"{root}/_staging/{name}", f"{root}/{name}")
        self.abort([])

    def abort(self, messages: list) -> None:
        fs, root = _open(self.path)
        if fs.get_file_info(f"{root}/_staging").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_staging")


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def _bare(column: str, value: str | None) -> str | None:
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.strip("<>")
    return value.removeprefix("sha1:") if column == "payload_digest" else value


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.wanted = options["path"].rstrip("/"), options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            kind = {EqualTo: "eq", In: "in", StringStartsWith: "starts", IsNotNull: "some", IsNull: "none"}.get(type(f))
            if column in HEADERS and kind:
                self.tests.append((column, kind, getattr(f, "value", None)))
            else:
                yield f

    def passes(self, header: dict) -> bool:
        for column, kind, value in self.tests:
            own = header[column]
            if kind == "none" and own is not None or kind != "none" and own is None:
                return False
            if kind == "eq" and own != value or kind == "in" and own not in value or kind == "starts" and not own.startswith(value):
                return False
        return True

    def partitions(self) -> list[Files]:
        fs, root = _open(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        named = [f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
        files = sorted((f.path, f.size) for f in named if f.base_name.endswith((".warc", ".warc.gz")))
        if named and (not files or info.type == pafs.FileType.File and len(files) < len(named)):
            raise ValueError(f"{self.path}: no .warc or .warc.gz, but {named[0].base_name}")
        groups, size = [[]], 0
        for path, n in files:
            if groups[-1] and size + n > FILE_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n in ("payload_bytes", "position") else pa.string()) for n in names])
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                for row in self.records(io.BufferedReader(raw, 1 << 20), path):
                    rows.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, f: io.BufferedReader, path: str) -> Iterator[dict]:
        source = Archive(f, path)
        while source.more():
            at = source.member
            head = source.until(b"\r\n\r\n")
            if not head.startswith(b"WARC/"):
                raise ValueError(f"{path}, {at}: not a WARC record")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
            left = int(fields["content-length"])
            row = {c: _bare(c, fields.get(h)) for c, h in HEADERS.items()} | {"payload_bytes": None, "payload": None, "file": path, "position": at}
            if not self.passes(row):
                source.leave(left)
                continue
            whole = self.wanted and fields.get("warc-type") == "response"
            http = source.until(b"\r\n\r\n", left)
            left -= len(http)
            sizes = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            row["payload_bytes"] = int(sizes[0]) if sizes else None
            if whole:
                row["payload"] = source.take(left)
                if self.verify and base64.b32encode(hashlib.sha1(row["payload"]).digest()).decode() != row["payload_digest"]:
                    raise ValueError(f"{path}, {at}: the payload does not match its digest")
                left = 0
            source.leave(left)
            yield row


class Archive:
    """The bytes of a plain or gzipped archive, one record after the other, however records are dealt to gzip members.

    A member with an `sl` field is one record of that length and is left by seeking; so is a record of a plain file.
    """

    def __init__(self, f: io.BufferedReader, path: str) -> None:
        self.f, self.path = f, path
        magic = f.read(2)
        f.seek(0)
        self.zipped = magic == b"\x1f\x8b"
        self.member, self.next, self.held, self.inflate = 0, None, b"", None

    def _fill(self) -> bool:
        """Hold more bytes; false at the end of the file."""
        while self.zipped:
            if self.inflate is None and not self._open():
                return False
            part = self.inflate.unconsumed_tail or self.f.read(STEP)
            got = self.inflate.decompress(part, 4 * STEP)  # zlib may hold some back without input left
            if self.inflate.eof:
                self.f.seek(-len(self.inflate.unused_data), io.SEEK_CUR)
                self.inflate = None
            elif not got and not part:
                raise ValueError(f"{self.path}, {self.member}: a record is cut short")
            if got:
                self.held += got
                return True
        got = self.f.read(4 * STEP)
        self.held += got
        return bool(got)

    def _open(self) -> bool:
        """Begin the next gzip member, if there is one."""
        self.member, self.next = self.f.tell(), None
        head = self.f.read(24)
        if not head:
            return False
        if head[:2] != b"\x1f\x8b":
            raise ValueError(f"{self.path}, {self.member}: not a gzip member")
        if len(head) >= 20 and head[3] & 4 and head[12:14] == b"sl":
            self.next = self.member + struct.unpack("<I", head[16:20])[0]
        self.f.seek(self.member)
        self.inflate = zlib.decompressobj(31)
        return True

    def more(self) -> bool:
        """Whether another record begins; line ends between records are passed over."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if self.held:
                if not self.zipped:
                    self.member = self.f.tell() - len(self.held)
                return True
            if not self._fill():
                return False

    def until(self, mark: bytes, limit: int | None = None) -> bytes:
        """Bytes up to and with the mark, or as many as the limit where the mark does not come before."""
        looked = 0
        while (at := self.held.find(mark, looked)) < 0 and (limit is None or len(self.held) < limit):
            looked = max(len(self.held) - len(mark), 0)
            if not self._fill():
                raise ValueError(f"{self.path}, {self.member}: a record is cut short")
        n = at + len(mark) if at >= 0 else limit
        return self.take(n if limit is None else min(n, limit))

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while len(self.held) < left:
            parts.append(self.held)
            left -= len(self.held)
            self.held = b""
            if not self._fill():
                raise ValueError(f"{self.path}, {self.member}: a record is cut short")
        parts.append(self.held[:left])
        self.held = self.held[left:]
        return b"".join(parts)

    def leave(self, n: int) -> None:
        """Pass over what is left of a record, without inflating it where that can be."""
        if self.zipped and self.next is not None:
            self.f.seek(self.next)
            self.inflate, self.held = None, b""
        elif not self.zipped and n > len(self.held):
            self.f.seek(n - len(self.held), io.SEEK_CUR)
            self.held = b""
        else:
            while n > len(self.held):
                n -= len(self.held)
                self.held = b""
                if not self._fill():
                    raise ValueError(f"{self.path}, {self.member}: a record is cut short")
            self.held = self.held[n:]


class WarcSource(DataSource):
    """format("warc"): option payload=false never inflates payloads; verify=true checks those that are read."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(path)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """One record for each row. Of rows with equal payloads of at least min_bytes bytes the one with the largest id is
    the response, the others revisit it; shorter payloads are responses each.

    A null payload is an empty one. A null id never is the largest: such a row revisits the largest id if there is one,
    else it is a response. Rows that repeat the largest id with the same payload are responses too. A null URL leaves
    its header out; an empty table writes no file; further columns are ignored. Only one row for each distinct payload
    goes through the aggregation, and Spark may split a payload that many rows share when it joins them.
    """
    register(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    longest = rows.where(F.octet_length("payload") >= min_bytes).groupBy("payload_digest").agg(F.max("id").alias("target"))
    joined = rows.join(longest, "payload_digest", "left")
    revisit = (F.octet_length("payload") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("target"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    joined.select(
        urn(F.col("id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        "payload_digest",
        F.when(revisit, urn(F.col("target"))).alias("refers_to"),
        "payload",
    ).write.format("warc").option("path", path).mode("append").save()


def page_of(urn) -> F.Column:
    return F.when(~urn.endswith(":null"), F.substring_index(urn, ":", -1).cast("long"))


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages as archives into the shared folder and read those back: one row for each record.

    Responses are read with their payloads, which are checked against their digests; revisits by their headers alone.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path, min_bytes)
    responses = read_warc(spark, path, verify=True).where(F.col("record_type") == "response").withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    revisits = read_warc(spark, path, payload=False).where(F.col("record_type") == "revisit")
    columns = [page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to")]
    return responses.select(columns).unionByName(revisits.select(columns))
