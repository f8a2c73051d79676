"""WARC archives as a PySpark Python data source (``format("warc")``), and revisit deduplication.

Reading: one partition for each archive file. Predicates on record type and headers are pushed into
the reader: a record's headers are parsed first, and the block of a record that fails is skipped: by a
seek in plain files, and in compressed files by the member length that the writer puts into the gzip extra field
(members without it are inflated to their end, but not decoded). ``option("payload", "false")`` skips all blocks.

Writing: every task writes files of bounded size under a temporary name; commit moves those of the successful
attempts into place, so a lost executor leaves no half-written archive. Paths are URIs that
``pyarrow.fs`` opens (file, hdfs, s3, gs): on a cluster, a shared store.
"""
from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)

from codemap.llm.common import Scratch

VERSION = b"WARC/1.1\r\n"
#: Fixed values of the format: the profile of an identical-payload revisit.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns that come from named header fields.
FIELDS = {
    "record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
    "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
}
SCHEMA = ("record_id string, warc_type string, target_uri string, warc_date string, content_type string, payload_digest string, "
          "refers_to string, content_length long, http_length long, file string, offset long, payload binary")
_ARROW = pa.schema([*((c, pa.string()) for c in FIELDS), ("content_length", pa.int64()), ("http_length", pa.int64()), ("file", pa.string()),
                    ("offset", pa.int64()), ("payload", pa.binary())])
FILE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
_STEP = 1 << 16


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split("\r")).replace("\n", " ")


def record_bytes(record_id: str, warc_type: str, target_uri: str | None, warc_date: str, payload: bytes | None, payload_digest: str | None,
                 refers_to: str | None, http_length: int | None) -> bytes:
    """One record. A revisit keeps the HTTP header of the full payload, with its length, and no body."""
    body = b"" if warc_type == "revisit" else payload or b""
    length = len(payload or b"") if http_length is None else http_length
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + body
    head = [("WARC-Type", warc_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", warc_date), ("WARC-Target-URI", target_uri),
            ("WARC-Payload-Digest", payload_digest and f"sha1:{payload_digest}")]
    if warc_type == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to and f"<{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {_clean(v)}\r\n" for k, v in head if v is not None)
    return VERSION + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field SL holds its compressed and plain length, if they fit into 32 bits."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    total = 10 + 2 + 12 + len(body) + 8
    if max(total, len(data)) > 0xFFFFFFFF:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"SL", 8, total, len(data)) + body + tail


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceWriter):
    def __init__(self, schema, options: dict, overwrite: bool):
        self.names, self.overwrite = schema.names, overwrite
        self.path = options["path"].rstrip("/")
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))
        self.temporary = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        fs, folder = _filesystem(self.temporary)
        fs.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        try:
            for row in iterator:
                r = row.asDict()
                payload = r.get("payload")
                data = record_bytes(r["record_id"], r["warc_type"], r.get("target_uri"), r.get("warc_date") or "1970-01-01T00:00:00Z",
                                    None if payload is None else bytes(payload), r.get("payload_digest"), r.get("refers_to"), r.get("http_length"))
                data = gzip_member(data) if self.gzip else data
                if out is None or size + len(data) > self.file_bytes:
                    if out is not None:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                    out, size = fs.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
                out.write(data)
                size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, folder = _filesystem(self.path)
        _, temporary = _filesystem(self.temporary)
        fs.create_dir(folder, recursive=True)
        if self.overwrite:
            for info in _archives(self.path):
                fs.delete_file(info.path)
        for name in (f for m in messages if m is not None for f in m.files):
            fs.move(f"{temporary}/{name}", f"{folder}/{name}")
        self._clear(fs, temporary)

    def abort(self, messages) -> None:
        self._clear(*_filesystem(self.temporary))

    @staticmethod
    def _clear(fs, temporary: str) -> None:
        if fs.get_file_info(temporary).type == pafs.FileType.Directory:
            fs.delete_dir(temporary)


def _archives(path: str) -> list:
    """File infos of the archives at a file or folder; hidden and temporary names are left out."""
    fs, root = _filesystem(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [info]
    if info.type == pafs.FileType.NotFound:
        return []
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    hidden = lambda p: any(x[:1] in "_." for x in posixpath.relpath(p, root).split("/"))
    return sorted((f for f in found if f.type == pafs.FileType.File and not hidden(f.path)), key=lambda f: f.path)


class _Plain:
    """Records of an uncompressed file; the block is read or passed over by a seek."""

    def __init__(self, source):
        self.source, self.at, self.held = source, 0, b""

    def _need(self, n: int) -> bool:
        while len(self.held) < n:
            more = self.source.read(max(_STEP, n - len(self.held)))
            if not more:
                return False
            self.held += more
        return True

    def head(self) -> bytes | None:
        end, n = -1, 4
        while end < 0:
            if not self._need(n):
                if self.held.strip():
                    raise ValueError(f"truncated WARC header at byte {self.at}")
                return None
            end = self.held.find(b"\r\n\r\n")
            n = len(self.held) + 1
        head, self.held, self.start = self.held[:end], self.held[end + 4:], self.at
        self.at += end + 4
        return head

    def block(self, length: int) -> bytes:
        if not self._need(length):
            raise ValueError(f"truncated WARC record at byte {self.start}")
        data = self.held[:length]
        self._pass(length + 4)
        return data

    def skip(self, length: int) -> None:
        self._pass(length + 4)

    def _pass(self, n: int) -> None:
        self.at += n
        if n <= len(self.held):
            self.held = self.held[n:]
        else:
            self.held = b""
            self.source.seek(self.at)


class _Gzip:
    """Records of a file with one gzip member for each record."""

    def __init__(self, source):
        self.source, self.at, self.size = source, 0, source.size()

    def head(self) -> bytes | None:
        if self.at >= self.size:
            return None
        self.start, self.inflate, self.plain = self.at, zlib.decompressobj(31), b""
        self.source.seek(self.at)
        self.raw, self.member = self.source.read(_STEP), None
        if self.raw[3:4] == b"\x04" and self.raw[12:14] == b"SL":
            self.member = struct.unpack("<I", self.raw[16:20])[0]
        self.fed = 0
        while (end := self.plain.find(b"\r\n\r\n")) < 0:
            if not self._more(4096):
                raise ValueError(f"truncated WARC header at byte {self.start}")
        self.body = end + 4
        return self.plain[:end]

    def _more(self, step: int, keep: bool = True) -> bool:
        if self.inflate.eof:
            return False
        if self.fed >= len(self.raw):
            self.raw, self.fed = self.source.read(_STEP), 0
            if not self.raw:
                raise ValueError(f"truncated WARC member at byte {self.start}")
        part = self.raw[self.fed:self.fed + step]
        self.fed += len(part)
        self.at += len(part)
        data = self.inflate.decompress(part)
        self.at -= len(self.inflate.unused_data)
        self.plain = self.plain + data if keep else b""
        return True

    def block(self, length: int) -> bytes:
        parts, have = [self.plain], len(self.plain)
        while not self.inflate.eof:
            self.plain = b""
            self._more(_STEP)
            parts.append(self.plain)
        data = b"".join(parts)[self.body:]
        if len(data) < length:
            raise ValueError(f"truncated WARC record at byte {self.start} ({have} bytes)")
        return data[:length]

    def skip(self, length: int) -> None:
        if self.member:
            self.at = self.start + self.member
            return
        while self._more(_STEP, keep=False):
            pass


def _headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines are joined."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out, last = {}, None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _values(head: bytes) -> dict:
    found = _headers(head)
    out = {column: found.get(field.lower()) for column, field in FIELDS.items()}
    for c in ("record_id", "refers_to"):
        out[c] = out[c] and out[c].strip("<>")
    if out["payload_digest"]:
        out["payload_digest"] = out["payload_digest"].removeprefix("sha1:")
    out["content_length"] = int(found["content-length"])
    return out


_TESTS = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b, StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b),
    StringContains: lambda a, b: b in a, In: lambda a, b: a in b,
}


def _test(f):
    """(column, what to test) of a filter over header columns, or None if it can't be pushed."""
    column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
    if isinstance(f, Not):
        inner = _test(f.child)
        return inner and (inner[0], "not", inner)
    if column not in FIELDS and column != "content_length":
        return None
    if isinstance(f, (IsNull, IsNotNull, EqualNullSafe)) or type(f) in _TESTS:
        return column, type(f).__name__, tuple(f.value) if isinstance(f, In) else getattr(f, "value", None)
    return None


def _holds(test, row: dict) -> bool | None:
    """SQL's three values: None where a comparison meets null."""
    column, kind, want = test
    if kind == "not":
        held = _holds(want, row)
        return None if held is None else not held
    have = row[column]
    if kind in ("IsNull", "IsNotNull"):
        return (have is None) == (kind == "IsNull")
    if kind == "EqualNullSafe":
        return have == want
    return None if have is None or want is None else next(t for k, t in _TESTS.items() if k.__name__ == kind)(have, want)


@dataclass
class Archive(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.tests: list = []

    def pushFilters(self, filters):
        for f in filters:
            test = _test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self):
        return [Archive(f.path) for f in _archives(self.path)]

    def read(self, partition):
        if partition is None:  # no archive at the path
            return
        fs, _ = _filesystem(self.path)
        held, size = [], 0
        with fs.open_input_file(partition.path) as source:
            records = _Gzip(source) if partition.path.endswith(".gz") else _Plain(source)
            while (head := records.head()) is not None:
                row = _values(head)
                row |= {"http_length": None, "payload": None, "file": partition.path, "offset": records.start}
                length = row["content_length"]
                if not all(_holds(t, row) for t in self.tests):
                    records.skip(length)
                    continue
                if self.payload:
                    self._block(row, records.block(length))
                else:
                    records.skip(length)
                held.append(row)
                size += len(row["payload"] or b"") + 500
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, _ARROW)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)

    @staticmethod
    def _block(row: dict, block: bytes) -> None:
        """An HTTP block's body is the payload, any other block is one itself; a revisit has none."""
        if (row["content_type"] or "").startswith("application/http"):
            head, _, body = block.partition(b"\r\n\r\n")
            for line in head.split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    row["http_length"] = int(value)
        else:
            body = block
        row["payload"] = None if row["warc_type"] == "revisit" else body


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").save(path)``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let it push filters into Python data sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: five hex digits are four base32 digits."""
    digits = F.sha1(payload)
    part = lambda i: F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*(part(i) for i in range(8))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows for the WARC writer: a response, or a revisit of the smallest id with the same payload.

    Payloads under least_bytes are all responses. A null payload is empty. Of repeated rows with the same id one is the
    response; a null id comes after every other. Only digests that occur more than once are joined.
    """
    scratch, key = Scratch(pages.sparkSession, "warc-digests"), ["payload_digest", "http_length"]
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"),
                        F.coalesce(F.encode(F.col(html_col), "utf-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload"))).withColumn("http_length", F.length("payload").cast("long"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "n")).alias("first")
    shared = (rows.filter(F.col("http_length") >= least_bytes).groupBy(*key, "id").agg(F.count("*").alias("n")).groupBy(*key)
              .agg(F.sum("n").alias("n"), first).filter("n > 1").select(*key, F.col("first.id").alias("first_id"), F.col("first.n").alias("n_first")))
    shared = scratch.keep(shared, "shared")
    joined = rows.join(shared, key, "left").withColumn("again", F.col("n_first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")))
    if not shared.filter("n_first > 1").isEmpty():  # repeated rows: one of those with the first id is the response
        tied = F.coalesce(F.col("n_first") > 1, F.lit(False)) & ~F.col("again")
        same = scratch.keep(joined.filter(tied).withColumn("rid", F.monotonically_increasing_id()), "tied")
        one = scratch.keep(same.groupBy(*key).agg(F.min("rid").alias("one")), "one")
        same = same.join(one, key).withColumn("again", F.col("rid") != F.col("one"))
        joined = joined.filter(~tied).unionByName(same.select(joined.columns))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    return joined.select(urn(F.col("id")).alias("record_id"), F.when(F.col("again"), "revisit").otherwise("response").alias("warc_type"), "target_uri",
                         F.when(~F.col("again"), F.col("payload")).alias("payload"), "payload_digest",
                         F.when(F.col("again"), urn(F.col("first_id"))).alias("refers_to"), "http_length")


def archive(pages: DataFrame, path: str, compression: str = "gzip", **columns) -> None:
    """Write a record for each row of pages to archives at path."""
    register(pages.sparkSession)
    revisits(pages, **columns).write.format("warc").option("compression", compression).mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def catalogue(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id_col, payload_bytes, payload_digest, record_type, refers_to) of records written by ``archive``.

    Length and digest of a response are computed from the payload that was read, and must equal its headers;
    a revisit has those of the full payload in its headers.
    """
    page = lambda c: F.expr(f"try_cast(substring({c}, {len('urn:page:') + 1}) as long)")
    response = F.col("warc_type") == "response"
    computed = F.struct(F.length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("d"))
    stated = F.struct(F.col("http_length").alias("n"), F.col("payload_digest").alias("d"))
    seen = records.withColumn("c", F.when(response, computed).otherwise(stated))
    wrong = F.raise_error(F.concat(F.lit("payload differs from its headers: "), F.coalesce("record_id", F.lit(""))))
    return seen.select(page("record_id").alias(id_col), F.when(F.col("c") == stated, F.col("c.n")).otherwise(wrong.cast("long")).alias("payload_bytes"),
                       F.col("c.d").alias("payload_digest"), F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"))
