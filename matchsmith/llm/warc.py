"""WARC archives: a PySpark Python data source (reader and writer) and payload deduplication.

Reader, ``spark.read.format("warc")``: plans partitions by files (small ones together), pushes
filters on record type and headers down, parses a record's headers first, and reads or decodes
its block only if the record passes and the payload is asked for; otherwise it skips ahead.
Writer, ``df.write.format("warc")``: one file a task, named by attempt; the commit writes the
list of files, so archives of lost or repeated attempts are never read. A record is a gzip
member of its own (option ``compression``: ``gzip`` or ``none``) whose ``sl`` extra field gives the
lengths of its data, so that a record can be left after its headers.

Records: an HTTP response's head and payload as block (``response``), or an empty block that
refers to an equal payload (``revisit``). Block and payload digests are bare base32 SHA-1 in
``sha1:`` form. ``WARC-Payload-Length`` is an extension header with the full payload's size.

Rows to write: ``record_id`` (name of the record within the archive), ``url``, ``payload``
(binary; null: empty), ``payload_digest``, ``payload_bytes``, ``record_type``, ``refers_to``. A
null url or id leaves its header out, and is read as null. Control characters in header values are
percent-encoded, and so are percent signs. Empty tables give an archive of no files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
import zlib
from urllib.parse import unquote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition,
                                    IsNotNull, StringStartsWith, WriterCommitMessage)

from matchsmith.llm.files import store, write_file

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = ("record_id string, url string, record_type string, refers_to string, payload_digest string, "
          "payload_bytes long, headers map<string,string>, payload binary")
WRITE_COLUMNS = ["record_id", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to"]
# Bytes of files that one reading task takes, and bytes read at a time.
SPLIT_BYTES = 64 << 20
READ_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
HEAD_BYTES = 4096
FILE_LIST = "_files"

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_UNSAFE = re.compile(r"[\x00-\x1f\x7f%]")
_HEADER_OF = {"record_id": "warc-record-id", "url": "warc-target-uri", "record_type": "warc-type",
              "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def _safe(value: str) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m.group()):02X}", value)


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


class WarcDataSource(DataSource):
    """``path``: folder of the archive. Options: ``payload`` (true; false: leave payloads null),
    ``verify`` (false; true: read every payload that passes and hold it against its digest and size)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        flag = lambda name, default: self.options.get(name, default).lower() == "true"
        return WarcReader(self.options["path"], flag("payload", "true"), flag("verify", "false"),
                          int(self.options.get("splitbytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], [f.name for f in schema.fields], self.options.get("compression", "gzip") == "gzip")


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, verify: bool, split: int):
        self.path, self.payload, self.verify, self.split = path, payload, verify, split
        self.tests: list[tuple[str, str, tuple]] = []
        fs, folder = store(path)
        self.own = fs.get_file_info(f"{folder}/{FILE_LIST}").is_file

    def pushFilters(self, filters):
        """Takes equality, membership and prefix tests of header columns; gives the rest back."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and column in _HEADER_OF and isinstance(f.value, str):
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In) and column in _HEADER_OF and all(isinstance(v, str) for v in f.value):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith) and column in _HEADER_OF:
                self.tests.append((column, "starts", (f.value,)))
            elif isinstance(f, IsNotNull) and column in _HEADER_OF:
                self.tests.append((column, "held", ()))
            else:
                yield f

    def partitions(self):
        fs, folder = store(self.path)
        if self.own:
            with fs.open_input_file(f"{folder}/{FILE_LIST}") as f:
                listed = [line.split("\t") for line in f.read().decode().splitlines()]
        else:  # an archive of others: the files themselves
            from pyarrow.fs import FileSelector
            one = fs.get_file_info(folder)
            found = [one] if one.is_file else fs.get_file_info(FileSelector(folder, recursive=True))
            listed = [(i.path, i.size) for i in found if i.is_file and (one.is_file or re.search(r"\.w?arc(\.gz)?$", i.path))]
        planned, held, size = [], [], 0
        for name, n in sorted(listed, key=lambda x: -int(x[1])):
            if held and size + int(n) > self.split:
                planned.append(Files(held))
                held, size = [], 0
            held.append(name)
            size += int(n)
        return planned + ([Files(held)] if held else []) or [Files([])]

    def read(self, partition):
        fs, folder = store(self.path)
        for name in partition.names:
            with fs.open_input_file(f"{folder}/{name}" if self.own else name) as f:
                rows, held = [], 0
                for row in self._records(f):
                    rows.append(row)
                    held += len(row[-1] or b"") + 500
                    if held > BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _records(self, f):
        stream = Buffered(f)
        while stream.peek(1):
            yield from (self._member(stream) if stream.peek(2) == b"\x1f\x8b" else self._plain(stream))

    def _plain(self, stream):
        """A record that isn't compressed."""
        raw = stream.until(b"\r\n\r\n")
        if raw is None:
            if stream.peek(1 << 16).strip():
                raise ValueError("a record's headers break off")
            stream.skip(1 << 16)
            return
        headers = parse_headers(raw)
        size, row = int(headers["content-length"]), self._row(headers)
        if row is not None and (self.payload or self.verify):
            yield self._finished(row, stream.take(size))
            stream.skip(4)
        else:  # leave the block unread
            stream.skip(size + 4)
            if row is not None:
                yield (*row, None)

    def _member(self, stream):
        """A record in a gzip member: inflated as far as its headers, and whole if it is wanted."""
        packed, _ = gzip_head(stream)
        inflate, raw, used = zlib.decompressobj(-15), b"", 0

        def more(limit: int) -> bool:
            nonlocal raw, used
            if inflate.eof:
                return False
            piece = inflate.unconsumed_tail
            if not piece:
                piece = stream.take(min(HEAD_BYTES, packed - used) if packed else HEAD_BYTES)
                used += len(piece)
                if not piece:
                    raise ValueError("a member breaks off")
            raw += inflate.decompress(piece, limit)
            return True

        while (end := raw.find(b"\r\n\r\n")) < 0:
            if not more(HEAD_BYTES):
                raise ValueError("a record's headers break off")
        headers = parse_headers(raw[:end])
        size, row = int(headers["content-length"]), self._row(headers)
        if row is not None and (self.payload or self.verify):
            parts, raw = [raw], b""
            if packed:  # the rest at once
                rest = inflate.unconsumed_tail + stream.take(packed - used)
                used = packed
                parts.append(inflate.decompress(rest))
            while not packed and more(0):
                parts.append(raw)
                raw = b""
            block = b"".join(parts)[end + 4:end + 4 + size]
            if len(block) < size:
                raise ValueError("a member breaks off")
            yield self._finished(row, block)
        elif row is not None:
            yield (*row, None)
        if packed:
            stream.skip(packed - used + 8)
            return
        while not inflate.eof:
            more(0)
            raw = b""
        stream.back(len(inflate.unused_data))
        stream.skip(8)

    def _finished(self, row: tuple, block: bytes) -> tuple:
        payload = block if block else None
        if payload and row[6].get("content-type", "").lower().startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]  # of a message without an end of its head: nothing
        if self.verify and payload is not None:
            digest = row[4] if row[6].get("warc-payload-digest", "").lower().startswith("sha1:") else None
            if (row[5] is not None and len(payload) != row[5]) or (digest and base32_sha1(hashlib.sha1(payload).hexdigest()) != digest.upper()):
                raise ValueError(f"record {row[0]}: payload and digest differ")
        return (*row, payload if self.payload else None)

    def _row(self, headers: dict):
        plain = unquote if self.own else str  # the writer's escapes; others' values stand as they are
        value = {c: plain(headers[h]) if h in headers else None for c, h in _HEADER_OF.items()}
        value["payload_digest"] = value["payload_digest"] and re.sub("(?i)^sha1:", "", value["payload_digest"])
        for column, kind, wanted in self.tests:
            v = value[column]
            if v is None or (kind == "in" and v not in wanted) or (kind == "starts" and not v.startswith(wanted)):
                return None
        length = headers.get("warc-payload-length")
        return (value["record_id"], value["url"], value["record_type"], value["refers_to"], value["payload_digest"],
                int(length) if length else None, headers)


class Buffered:
    """Bytes of a file in order, read ``READ_BYTES`` at a time; long skips aren't read."""

    def __init__(self, f):
        self.f, self.data, self.at = f, b"", 0

    def peek(self, n: int) -> bytes:
        while len(self.data) - self.at < n:
            more = self.f.read(max(READ_BYTES, n))
            if not more:
                break
            self.data, self.at = self.data[self.at:] + more, 0
        return self.data[self.at:self.at + n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        held = len(self.data) - self.at
        if n <= held:
            self.at += n
        else:
            self.f.seek(self.f.tell() + n - held)
            self.data, self.at = b"", 0

    def back(self, n: int) -> None:
        """Give the last ``n`` bytes taken back."""
        self.at -= n

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the next mark, which is passed; nothing is taken if there is none."""
        while (end := self.data.find(mark, self.at)) < 0:
            held = len(self.data) - self.at
            if len(self.peek(held + READ_BYTES)) == held:
                return None
        out, self.at = self.data[self.at:end], end + len(mark)
        return out


def gzip_head(stream: Buffered) -> tuple[int, int]:
    """Passes a member's head; (packed, full) length of its data, 0 if the head doesn't say."""
    flags = stream.take(10)[3]
    lengths = (0, 0)
    if flags & 4:
        extra = stream.take(struct.unpack("<H", stream.take(2))[0])
        while len(extra) >= 4:
            n = struct.unpack_from("<H", extra, 2)[0]
            if extra[:2] == b"sl" and n == 8:
                lengths = struct.unpack_from("<II", extra, 4)
            extra = extra[4 + n:]
    for flag in (8, 16):  # name, comment
        if flags & flag:
            stream.until(b"\0")
    if flags & 2:
        stream.skip(2)
    return lengths


def gzip_member(raw: bytes, level: int = 1) -> bytes:
    """One gzip member with its lengths in an ``sl`` field (left out beyond 4 GB)."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    data = pack.compress(raw) + pack.flush()
    said = b"sl" + struct.pack("<HII", 8, len(data), len(raw)) if max(len(data), len(raw)) < 1 << 32 else b""
    head = b"\x1f\x8b\x08" + (b"\x04" if said else b"\x00") + b"\0\0\0\0\x04\xff" + (struct.pack("<H", len(said)) + said if said else b"")
    return head + data + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


_ARROW = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
                    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                    ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    cols[6] = [list(h.items()) for h in cols[6]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def _decoded(line: bytes) -> str:
    """UTF-8, or Latin-1 where a line isn't."""
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        return line.decode("latin-1")


def parse_headers(raw: bytes) -> dict[str, str]:
    """Headers by lower-case name; a line that begins with space goes on with the one before."""
    lines = [_decoded(line) for line in raw.split(b"\r\n")]
    while lines and not lines[0].strip():
        del lines[0]
    if not lines or not lines[0].lstrip().startswith("WARC/"):
        raise ValueError(f"not a record: {(lines or [''])[0][:80]!r}")
    whole: list[str] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and whole:
            whole[-1] += " " + line.strip()
        elif line:
            whole.append(line)
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in whole)}


def record_bytes(record_id, url, payload, digest, n_bytes, kind, refers_to) -> bytes:
    payload = bytes(payload or b"")
    block = b"" if kind == "revisit" else _HTTP % len(payload) + payload
    heads = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {n_bytes}",
             "Content-Type: application/http; msgtype=response"]
    for name, value in (("WARC-Record-ID", record_id), ("WARC-Target-URI", url), ("WARC-Refers-To", refers_to)):
        if value is not None:
            heads.append(f"{name}: {_safe(str(value))}")
    if kind == "revisit":
        heads.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    heads.append(f"Content-Length: {len(block)}")
    return "\r\n".join(heads).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Written(WriterCommitMessage):
    def __init__(self, name: str | None, size: int):
        self.name, self.size = name, size


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str], packed: bool):
        self.path, self.packed, self.at = path, packed, [columns.index(c) for c in WRITE_COLUMNS]

    def write(self, batches):
        size = 0

        def chunks():
            nonlocal size
            for batch in batches:
                for row in zip(*[batch.column(i).to_pylist() for i in self.at]):
                    raw = record_bytes(*row)
                    raw = gzip_member(raw) if self.packed else raw
                    size += len(raw)
                    yield raw

        stream = chunks()
        first = next(stream, None)
        if first is None:
            return Written(None, 0)
        name = write_file(self.path, "part.warc.gz" if self.packed else "part.warc", (c for part in ((first,), stream) for c in part))
        return Written(name, size)

    def commit(self, messages):
        fs, folder = store(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{FILE_LIST}") as out:
            out.write("".join(f"{m.name}\t{m.size}\n" for m in messages if m is not None and m.name).encode())

    def abort(self, messages):
        """Files of a failed write are in no list, so nothing reads them."""


def register(spark: SparkSession) -> None:
    """Make the source known to the session, which must let Python sources take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a SHA-1 in hex, five hex digits to four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(letters, F.shiftright(bits, 5 * (3 - j)).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*parts)


def deduplicated(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0,
                 salts: int = 32) -> DataFrame:
    """Rows to write: of equal payloads of ``least_bytes`` or more, that with the largest key is a
    response and the others revisit it. Only digests and keys are grouped; the digests that
    several rows share are salted, so a payload that a third of all rows hold is no hot key.

    Rows that repeat the largest key of a payload are responses too; rows with a null key revisit
    any other row of their payload that has one."""
    rows = pages.select(F.col(key).alias("__key"), F.col(url).alias("url"),
                        F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumns({"__hex": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    shared = (rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("__hex")
              .agg(F.max("__key").alias("__top"), F.count(F.lit(1)).alias("__n")).filter("__n > 1 and __top is not null")
              .select("__hex", "__top", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt")))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__key", "url"), F.lit(salts)).cast("int"))
    rows = rows.join(shared, ["__hex", "__salt"], "left")
    again = F.col("__top").isNotNull() & ~F.col("__key").eqNullSafe(F.col("__top"))
    return rows.select(
        F.col("__key").cast("string").alias("record_id"), "url", F.when(~again, F.col("payload")).alias("payload"),
        base32_of_hex(F.col("__hex")).alias("payload_digest"), "payload_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("__top").cast("string")).alias("refers_to"))
