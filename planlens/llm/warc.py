"""WARC archives: a writer and a reader as Python data sources.

``spark.read.format("warc")`` plans one partition per file, or several small files together. It
takes filters on the record type and on any header column before a payload is touched: a record's
headers are parsed first, and a record that fails is skipped by its length. Records are gzip
members of their own (as the format asks); each member's compressed size stands in an extra field
``SL`` of its gzip header, so skipping one is a seek. Members without that field, and archives
without compression, are read as well.

``df.write.format("warc")`` writes one archive per task under a name of its own. Only the archives
of tasks that Spark committed are listed in a manifest of the job, ``_archives-*``, in the folder, and only
those are read when there is one, so a task that ran twice leaves no double records.

Paths go through pyarrow's file systems: every executor and the driver must reach them.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from planlens.llm.common import Scratch

SCHEMA = ("record_id string, record_type string, target_uri string, warc_date string, refers_to string, payload_digest string, "
          "page_id long, payload_bytes long, payload string")
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
           "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "page_id": "X-Page-ID", "payload_bytes": "X-Payload-Length"}
NUMBERS = {"page_id", "payload_bytes"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_archives-"
PACK_BYTES = 64 << 20  # small archives read by one partition


def _fs(path: str):
    from pyarrow import fs
    if "://" not in path:
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _member(raw: bytes, level: int = 1) -> bytes:
    """One gzip member, its own size in the extra field SL."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"SL" + struct.pack("<HII", 8, size, len(raw))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """A WARC record. Line ends in header values would end the header, so they are written percent-encoded."""
    kind, payload = row["record_type"] or "resource", (row.get("payload") or "").encode("utf-8")
    lines = ["WARC/1.1"]
    for column, header in HEADERS.items():
        if (value := row.get(column)) is not None:
            lines.append(f"{header}: " + str(value).replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + payload + b"\r\n\r\n"


@dataclass
class Done(WriterCommitMessage):
    name: str
    records: int


def _manifests(fs, root: str) -> dict[str, dict]:
    """The manifests of the jobs that wrote into the folder, by name."""
    from pyarrow.fs import FileSelector
    out = {}
    for i in fs.get_file_info(FileSelector(root, allow_not_found=True)):
        if i.base_name.startswith(MANIFEST):
            with fs.open_input_stream(i.path, compression=None) as f:
                out[i.base_name] = json.loads(f.read())
    return out


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.level, self.overwrite = options["path"].rstrip("/"), int(options.get("level", 1)), overwrite

    def write(self, rows: Iterator) -> Done:
        fs, root = _fs(self.path)
        fs.create_dir(root)
        name, n = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for row in rows:
                out.write(_member(record(row.asDict()), self.level))
                n += 1
        return Done(name, n)

    def commit(self, messages: list) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root)
        old = _manifests(fs, root) if self.overwrite else {}
        mine = {"archives": [[m.name, m.records] for m in messages if m is not None], "replaces": sorted(old)}
        with fs.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}", compression=None) as out:
            out.write(json.dumps(mine).encode())
        for name, manifest in old.items():  # no reader sees these any more
            for file in [a for a, _ in manifest["archives"]] + [name]:
                fs.delete_file(f"{root}/{file}")

    def abort(self, messages: list) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.name}")


@dataclass
class Archives(InputPartition):
    files: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload, self.wanted = options["path"].rstrip("/"), options.get("payload", "true") != "false", {}

    def pushFilters(self, filters: list) -> Iterator:
        """Equality, IN and IS NOT NULL on header columns are decided from the headers; the rest is Spark's."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self._want(column, {str(f.value)})
            elif isinstance(f, In):
                self._want(column, {str(v) for v in f.value if v is not None})
            elif isinstance(f, IsNotNull):
                self._want(column, None)
            else:
                yield f

    def _want(self, column: str, values: set | None) -> None:
        had = self.wanted.get(column)
        self.wanted[column] = values if had is None else had if values is None else had & values

    def partitions(self) -> list:
        from pyarrow.fs import FileSelector, FileType
        fs, root = _fs(self.path)
        found = {i.path: i.size for i in fs.get_file_info(FileSelector(root, recursive=True)) if i.type == FileType.File and i.path.endswith((".warc", ".warc.gz"))}
        manifests = _manifests(fs, root)
        if manifests:
            gone = {name for m in manifests.values() for name in m["replaces"]}
            listed = {a for name, m in manifests.items() if name not in gone for a, _ in m["archives"]}
            found = {p: n for p, n in found.items() if p.rsplit("/", 1)[-1] in listed}
        packs, room = [], 0
        for path in sorted(found):
            if not packs or found[path] > room:
                packs.append([])
                room = PACK_BYTES
            packs[-1].append(path)
            room -= found[path]
        return [Archives(p) for p in packs] or [Archives([])]

    def read(self, partition: Archives) -> Iterator[tuple]:
        fs, _ = _fs(self.path)
        for path in partition.files:
            with fs.open_input_file(path) as f:
                for head, payload in _records(f, path.endswith(".gz"), self._passes):
                    values = {c: head.get(h.lower()) for c, h in HEADERS.items()}
                    body = payload().decode("utf-8", "replace") if self.payload else None
                    yield tuple(int(v) if c in NUMBERS and v is not None else v for c, v in values.items()) + (body,)

    def _passes(self, head: dict) -> bool:
        for column, values in self.wanted.items():
            got = head.get(HEADERS[column].lower())
            if got is None or (values is not None and got not in values):
                return False
        return True


def _parse(block: bytes) -> dict:
    head = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        head[name.strip().lower()] = value.strip()
    return head


def _records(f, packed: bool, passes) -> Iterator[tuple[dict, object]]:
    """(headers, a function that decodes the payload) of the records that pass."""
    end, at = f.size(), 0
    while at < end:
        f.seek(at)
        if packed:
            start = f.read(min(end - at, 1 << 16))
            size, skip = _member_size(start)
            if size is None:  # no size in the header: the member's end is found by decoding it
                f.seek(at)
                raw, size = _inflate_all(f)
                block, _, rest = raw.partition(b"\r\n\r\n")
                head = _parse(block)
                payload = lambda rest=rest, head=head: rest[:int(head.get("content-length", 0))]
            else:
                opener = zlib.decompressobj(-15)
                raw = opener.decompress(start[skip:min(size, len(start))], 1 << 12)
                while b"\r\n\r\n" not in raw and opener.unconsumed_tail:
                    raw += opener.decompress(opener.unconsumed_tail, 1 << 12)
                block, _, rest = raw.partition(b"\r\n\r\n")
                head = _parse(block)

                def payload(opener=opener, rest=rest, head=head, left=(at + len(start), at + size)):
                    rest += opener.decompress(opener.unconsumed_tail)
                    if left[0] < left[1]:
                        f.seek(left[0])
                        rest += opener.decompress(f.read(left[1] - left[0]))
                    return rest[:int(head.get("content-length", 0))]
            if passes(head):
                yield head, payload
            at += size
        else:
            block = b""
            while b"\r\n\r\n" not in block and (more := f.read(1 << 12)):
                block += more
            if stray := len(block) - len(block.lstrip(b"\r\n")):  # line ends between records
                at += stray
                continue
            if not block.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at byte {at}")
            block, _, _ = block.partition(b"\r\n\r\n")
            head, body = _parse(block), at + len(block) + 4
            n = int(head.get("content-length", 0))

            def payload(body=body, n=n):
                f.seek(body)
                return f.read(n)
            if passes(head):
                yield head, payload
            at = body + n + 4


def _member_size(start: bytes) -> tuple[int | None, int]:
    if len(start) < 12 or not start[3] & 4:
        return None, 0
    length = struct.unpack("<H", start[10:12])[0]
    extra, i = start[12:12 + length], 0
    while i + 4 <= len(extra):
        n = struct.unpack("<H", extra[i + 2:i + 4])[0]
        if extra[i:i + 2] == b"SL" and n == 8 and start[3] == 4:
            return struct.unpack("<I", extra[i + 4:i + 8])[0], 12 + length
        i += 4 + n
    return None, 0


def _inflate_all(f) -> tuple[bytes, int]:
    opener, out, read = zlib.decompressobj(31), io.BytesIO(), 0
    while not opener.eof and (piece := f.read(1 << 16)):
        out.write(opener.decompress(piece))
        read += len(piece)
    return out.getvalue(), read - len(opener.unused_data)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def payload_digest(payload: str) -> str:
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a text's UTF-8 bytes: 20 bits, four digits, at a time."""
    digest = F.sha1(F.encode(payload, "utf-8"))
    digits = F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def to_records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A record per page. Of equal payloads of at least ``min_bytes`` the smallest page_id is the response and
    the others revisit it; smaller payloads are all responses. NULL html is empty. Rows that share the smallest
    id are all responses; NULL ids come after all others. The payloads' digests are grouped, not the payloads."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), html.alias("payload"))
    base = base.select("*", F.sha2(F.encode("payload", "utf-8"), 256).alias("_same"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    first = first_ids(base.select("_same", "page_id"))
    both = base.join(first, "_same", "left")
    again = F.col("_n").isNotNull() & (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return both.select(F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")).alias("record_id"),
                       F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit("1970-01-01T00:00:00Z").alias("warc_date"),
                       F.when(again, F.concat(F.lit("<urn:page:"), F.col("_first").cast("string"), F.lit(">"))).alias("refers_to"),
                       F.concat(F.lit("sha1:"), base32_sha1(F.col("payload"))).alias("payload_digest"), "page_id", "payload_bytes",
                       F.when(again, F.lit("")).otherwise(F.col("payload")).alias("payload"))


def first_ids(keys: DataFrame) -> DataFrame:
    """(_same, _first, _n): the smallest id of each payload that occurs more than once, as a written table of known size."""
    found = keys.groupBy("_same").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return Scratch(keys.sparkSession).store(found)


def write_archives(pages: DataFrame, path: str, **options) -> DataFrame:
    """Write the pages' records into the folder ``path`` and give the frame that reads them back."""
    spark = pages.sparkSession
    register(spark)
    to_records(pages, **options).write.format("warc").mode("append").save(path)
    return spark.read.format("warc").load(path)


def round_trip(pages: DataFrame, path: str, **options) -> DataFrame:
    """What the archives say of every page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are taken from its payload, as read; those of a revisit from its headers.
    """
    back = write_archives(pages, path, **options)
    spark = pages.sparkSession
    full = back.where("record_type = 'response'")
    full = full.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"),
                       "record_type", F.lit(None).cast("long").alias("refers_to"))
    short = spark.read.format("warc").option("payload", "false").load(path).where("record_type = 'revisit'")
    short = short.select("page_id", "payload_bytes", F.substring("payload_digest", 6, 32).alias("payload_digest"), "record_type",
                         F.regexp_extract("refers_to", "<urn:page:(-?[0-9]+)>", 1).cast("long").alias("refers_to"))
    return full.unionByName(short)
