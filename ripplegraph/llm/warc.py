"""WARC archives as a Python data source, and payload dedup with revisit records.

Reading plans groups of files as partitions, reads the headers of a record first, tests the pushed
predicates on them and seeks past the block of a record that is not wanted.  A payload is read only
where the requested schema has the column ``payload``.  Archives are ``.warc`` or ``.warc.gz`` with a
member per record; members written here carry their length, so they are skipped without inflating.

Null payloads are empty; header values lose line breaks; a null URI is a missing header.  Repeated
rows are written each.  An empty table gives an empty archive; other columns are not written.
"""

from __future__ import annotations

import gzip
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from ripplegraph.session import materialize, scratch_path

#: column -> header
HEADERS = {
    "record_id": "warc-record-id", "warc_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "content_type": "content-type",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "payload_length": "warc-payload-length",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
MARK = b"WL"  # extra field of a gzip member: its whole length


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, partition_bytes: int) -> None:
        self.path, self.columns, self.partition_bytes = path, schema.names, partition_bytes
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Predicates on headers are tested while reading; Spark tests the others."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "prefix", f.value))
            elif isinstance(f, (IsNotNull, IsNull)):
                self.tests.append((column, "null", isinstance(f, IsNull)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _open_fs(self.path)
        found = sorted((f.size, f.path) for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and re.search(r"\.warc(\.gz)?$", f.path) and f.size)
        parts, held = [Files([])], 0
        for size, name in found:
            if parts[-1].names and held + size > self.partition_bytes:
                parts, held = [*parts, Files([])], 0
            parts[-1].names.append(name)
            held += size
        return parts

    def wanted(self, head: dict[str, str]) -> bool:
        for column, kind, value in self.tests:
            v = head.get(HEADERS[column])
            if kind == "null":
                if (v is None) != value:
                    return False
            elif v is None or (v not in value if kind == "in" else not v.startswith(value)):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _open_fs(self.path)
        need = "payload" in self.columns
        schema = pa.schema([(c, pa.binary() if c == "payload" else pa.string()) for c in self.columns])
        rows, held = [], 0
        for name in partition.names:
            with fs.open_input_file(name) as f:
                for head, payload in (members if name.endswith(".gz") else records)(f, self.wanted, need):
                    rows.append([payload if c == "payload" else head.get(HEADERS[c]) for c in self.columns])
                    held += len(payload) + 200
                    if held > 4 << 20 or len(rows) >= 5000:
                        yield _rows(rows, schema)
                        rows, held = [], 0
        if rows:
            yield _rows(rows, schema)


def _rows(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def parse_head(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k.strip()}


def body_of(head: dict[str, str], block: bytes) -> bytes:
    """The payload of a block: what follows the HTTP head, where there is one."""
    if head.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def records(f, wanted, need: bool) -> Iterator[tuple[dict[str, str], bytes]]:  # noqa: ANN001
    """Records of an open plain archive."""
    f = f if isinstance(f, gzip.GzipFile) else io.BufferedReader(f, 1 << 20)
    while True:
        line = f.readline()
        if not line:
            return
        if line == b"\r\n":
            continue
        lines = [line]
        while (line := f.readline()) not in (b"\r\n", b""):
            lines.append(line)
        head = parse_head(b"".join(lines))
        size = int(head.get("content-length", 0))
        if not wanted(head):
            f.seek(size, 1)
        elif need:
            yield head, body_of(head, f.read(size))
        else:
            f.seek(size, 1)
            yield head, b""


def members(f, wanted, need: bool) -> Iterator[tuple[dict[str, str], bytes]]:  # noqa: ANN001
    """Records of a compressed archive whose members carry their length; any other one is read as a stream."""
    first = f.read(22)
    if not (len(first) >= 22 and first[3] & 4 and first[12:14] == MARK):
        f.seek(0)
        yield from records(gzip.GzipFile(fileobj=io.BufferedReader(f, 1 << 20)), wanted, need)
        return
    at, end = 0, f.size()
    while at < end:
        f.seek(at)
        lead = f.read(22)
        whole = struct.unpack("<I", lead[16:20])[0]
        inflate = zlib.decompressobj(-15)
        data, block = b"", b""
        part = lead[20:] + f.read(min(whole - 22, 2048))
        read = 20 + len(part)
        while b"\r\n\r\n" not in block:
            block += inflate.decompress(part, 4096)
            part = inflate.unconsumed_tail or f.read(min(4096, max(whole - read, 0)))
            if not inflate.unconsumed_tail:
                read += len(part)
            if not part and b"\r\n\r\n" not in block:
                raise ValueError("a member ends within its headers")
        top, _, data = block.partition(b"\r\n\r\n")
        head = parse_head(top)
        if wanted(head):
            if need:
                rest = part + f.read(max(whole - read, 0))
                data += inflate.decompress(rest) + inflate.flush()
                yield head, body_of(head, data[: int(head.get("content-length", 0))])
            else:
                yield head, b""
        at += whole


def record_bytes(row: dict, compress: bool) -> bytes:
    payload = row.get("payload") or b""
    revisit = row["warc_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    fields = [("WARC-Type", row["warc_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row.get("warc_date") or EPOCH), ("WARC-Target-URI", row.get("target_uri")), ("WARC-Payload-Digest", row.get("payload_digest")), ("WARC-Payload-Length", row.get("payload_length"))]
    if revisit:
        fields += [("WARC-Refers-To", row.get("refers_to")), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}\r\n" for k, v in fields if v is not None)
    data = b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"
    if not compress:
        return data
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    packed = z.compress(data) + z.flush()
    lead = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 8) + MARK + struct.pack("<HI", 4, 20 + len(packed) + 8)
    return lead + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own below ``_parts``; the commit moves those of successful tasks into place."""

    def __init__(self, path: str, compress: bool, file_bytes: int) -> None:
        self.path, self.compress, self.file_bytes = path, compress, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open_fs(self.path)
        fs.create_dir(f"{root}/_parts", recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.compress
                    names.append((f"{root}/_parts/{name}", f"{root}/{name}"))
                    out, size = fs.open_output_stream(names[-1][0], compression=None), 0
                data = record_bytes(row, self.compress)
                out.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written]) -> None:
        fs, _ = _open_fs(self.path)
        for m in messages:
            for a, b in m.names:
                fs.move(a, b)

    def abort(self, messages: list[Written]) -> None:
        fs, _ = _open_fs(self.path)
        for m in messages:
            for a, _ in m.names if m else ():
                fs.delete_file(a)


class WarcSource(DataSource):
    """``spark.read.format("warc").schema(…).load(folder)`` and ``df.write.format("warc").mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("partition_bytes", 32 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are added to, not overwritten")
        return WarcWriter(self.options["path"], str(self.options.get("compress", "true")).lower() == "true", int(self.options.get("file_bytes", 32 << 20)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)


def plan_records(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """A record per page: of equal payloads of at least ``least`` bytes, those of the smallest page id are responses, the others revisits.

    A null page id counts as larger than any; where all are null, all are responses.  Counts per
    digest are combined before they move; only digests of repeated payloads are joined.
    """
    p = pages.select(F.col(page).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("target_uri"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload"))
    first = p.filter(F.col("payload_length") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = materialize(first.filter("n > 1 and first_id is not null").drop("n"), "repeated-payloads")
    p = p.join(first, "payload_digest", "left")
    revisit = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return p.select(
        urn(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("warc_type"), "target_uri",
        F.concat(F.lit("sha256:"), "payload_digest").alias("payload_digest"), F.when(revisit, urn(F.col("first_id"))).alias("refers_to"),
        F.col("payload_length").cast("string").alias("payload_length"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str | None = None, **names: str) -> str:
    """Write an archive of ``pages``; returns its folder."""
    spark = pages.sparkSession
    register(spark)
    path = path or scratch_path(spark, "warc")
    plan_records(pages, **names).write.format("warc").mode("append").save(path)
    return path


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per record.

    Responses are read with their payload, whose length and digest are computed; revisits have none,
    so theirs come from the headers and no block is read.
    """
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
    full = read_warc(spark, path, "record_id string, warc_type string, payload binary").filter("warc_type = 'response'")
    full = full.select(page("record_id").alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    heads = read_warc(spark, path, "record_id string, warc_type string, payload_digest string, refers_to string, payload_length string").filter("warc_type = 'revisit'")
    heads = heads.select(page("record_id").alias("page_id"), F.col("payload_length").cast("bigint").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"))
    return full.unionByName(heads)
