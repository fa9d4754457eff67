"""WARC archives (operator 2) as a Python data source: ``format("warc")``.

Writing: every task writes one file of gzip members, one member per record, under a name
of its own; the driver's commit puts the files of the successful attempts in ``_index.json``
with places to cut them at. Members carry the ``sl`` field of the WARC annex (compressed
and uncompressed length), so a reader can step over a record without inflating it.

Reading: files are planned into partitions at those places. Predicates on the header
columns (``warc_type``, ``record_id``, ``target_uri``, ``refers_to``, ``payload_digest``,
``payload_length``) are pushed into the reader. It inflates a record's first bytes, parses
its headers, and inflates the payload only of records that pass; ``payload="false"`` skips
all payloads. Archives of other tools (no index, no ``sl``) are read a file per task.

``roles`` marks equal payloads: of at least ``min_bytes`` bytes, the record of the smallest
id is the response and the others revisit it.

Defined cases: a null payload is the empty one; rows with a null id come after all others
and are responses if no row of their group has an id; a repeated row of the smallest id is
a response again; line ends in header values are written as %0D and %0A; an empty table
makes an empty archive.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual,
    In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)

from tablekit.llm.store import written

SCHEMA = "warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length bigint, payload binary"
#: Column of the schema to header of the record.
HEADERS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CUT_BYTES = 8 << 20
ROWS_AT_ONCE = 256
HEAD = 4096
#: Bytes inflated at a time until a record's headers are whole.
STEP = 512


def filesystem(uri: str):
    """File system and path of a folder that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("/") else fs.FileSystem.from_uri(uri.replace("file:", "file://", 1))


# -- records ---------------------------------------------------------------------------

def member(data: bytes, level: int) -> bytes:
    """One gzip member with the ``sl`` field."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 12 + 12 + len(body) + 8
    if max(size, len(data)) >= 1 << 32:
        raise ValueError("a record has 4 GB or more")
    extra = b"sl" + struct.pack("<HII", 8, size, len(data))
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(row: dict, date: str) -> bytes:
    payload = row["payload"] or b""
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if row["warc_type"] == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if row["warc_type"] == "revisit":
        lines.append(f"WARC-Profile: {REVISIT}")
    for column, name in HEADERS.items():
        value = length if column == "payload_length" else row[column]
        if value is not None:
            lines.append(f"{name}: " + str(value).replace("\r", "%0D").replace("\n", "%0A"))
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(data: bytes) -> dict:
    names = {v.lower(): k for k, v in HEADERS.items()}
    out = dict.fromkeys(HEADERS)
    for line in data.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        column = names.get(name.decode("utf-8", "replace").strip().lower())
        if column:
            out[column] = value.decode("utf-8", "replace").strip()
    if out["payload_length"] is not None:
        out["payload_length"] = int(out["payload_length"])
    return out


def records(f, start: int, end: int, wanted, payloads: bool):
    """The records of f[start:end] whose headers ``wanted`` accepts: headers and payload."""
    at = start
    while at < end:
        f.seek(at)
        first = f.read(HEAD)
        if first[:4] == b"\x1f\x8b\x08\x04" and first[12:14] == b"sl":
            (size,) = struct.unpack_from("<I", first, 16)
        else:
            size = None
        z = zlib.decompressobj(31)
        data, more = z.decompress(first, STEP), z.unconsumed_tail
        while b"\r\n\r\n" not in data and not z.eof:
            more = more or f.read(HEAD)
            if not more:
                raise EOFError("the archive ends within a record")
            data += z.decompress(more, STEP)
            more = z.unconsumed_tail
        head, _, rest = data.partition(b"\r\n\r\n")
        row = parse_head(head)
        keep = wanted(row)
        if keep and payloads and row["warc_type"] == "response" or size is None:
            parts = [rest, z.decompress(more)]
            while not z.eof:
                more = f.read(1 << 16)
                if not more:
                    raise EOFError("the archive ends within a record")
                parts.append(z.decompress(more))
            if size is None:
                size = f.tell() - len(z.unused_data) - at
            row["payload"] = b"".join(parts).partition(b"\r\n\r\n")[2][:-4]
        if not payloads or row["warc_type"] != "response":
            row["payload"] = None
        if keep:
            yield row
        at += size


# -- the data source -------------------------------------------------------------------

@dataclass
class Written(WriterCommitMessage):
    file: str
    size: int
    rows: int
    cuts: list = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.folder, self.level, self.date = options["path"], int(options.get("level", 5)), options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator):
        fs, folder = filesystem(self.folder)
        fs.create_dir(folder, recursive=True)
        name, at, cuts, rows = f"part-{uuid.uuid4().hex}.warc.gz", 0, [], 0
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for whole in iterator:
                for i in range(0, whole.num_rows, ROWS_AT_ONCE):
                    for row in whole.slice(i, ROWS_AT_ONCE).to_pylist():
                        data = member(record(row, self.date), self.level)
                        if at - (cuts[-1] if cuts else 0) >= CUT_BYTES:
                            cuts.append(at)
                        out.write(data)
                        at += len(data)
                        rows += 1
        return Written(name, at, rows, cuts)

    def commit(self, messages):
        fs, folder = filesystem(self.folder)
        fs.create_dir(folder, recursive=True)
        index = [{"file": m.file, "size": m.size, "rows": m.rows, "cuts": m.cuts} for m in messages if m is not None and m.rows]
        with fs.open_output_stream(f"{folder}/_index.json") as out:
            out.write(json.dumps(index).encode())

    def abort(self, messages):
        fs, folder = filesystem(self.folder)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{folder}/{m.file}")


@dataclass
class Piece(InputPartition):
    file: str
    start: int
    end: int

    def __post_init__(self):
        self.value = None


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.folder, self.payloads = schema, options["path"], options.get("payload", "true") == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        kinds = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", StringStartsWith: "starts"}
        for f in filters:
            kind = kinds.get(type(f))
            if kind and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((f.attribute[0], kind, f.value))
            else:
                yield f

    def partitions(self):
        from pyarrow.fs import FileSelector, FileType

        fs, folder = filesystem(self.folder)
        if fs.get_file_info(f"{folder}/_index.json").type == FileType.File:
            with fs.open_input_stream(f"{folder}/_index.json") as f:
                index = json.loads(f.read())
        else:
            index = [{"file": x.base_name, "size": x.size, "cuts": []} for x in fs.get_file_info(FileSelector(folder)) if x.base_name.endswith(".warc.gz")]
        out = []
        for x in index:
            ends = [0, *x["cuts"], x["size"]]
            out += [Piece(x["file"], a, b) for a, b in zip(ends, ends[1:]) if b > a]
        return out or [Piece("", 0, 0)]

    def wanted(self, row) -> bool:
        for column, kind, value in self.tests:
            x = row[column]
            if x is None or not (
                x == value if kind == "=" else x in value if kind == "in" else x > value if kind == ">" else x >= value if kind == ">="
                else x < value if kind == "<" else x <= value if kind == "<=" else x.startswith(value)
            ):
                return False
        return True

    def read(self, piece):
        import pyarrow as pa

        types = [(n, pa.binary() if n == "payload" else pa.int64() if n == "payload_length" else pa.string()) for n in self.schema.fieldNames()]
        if piece.end > piece.start:
            fs, folder = filesystem(self.folder)
            with io.BufferedReader(fs.open_input_file(f"{folder}/{piece.file}"), 1 << 18) as f:
                rows = []
                for row in records(f, piece.start, piece.end, self.wanted, self.payloads):
                    rows.append(row)
                    if len(rows) >= ROWS_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(types))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(types))


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


# -- DataFrames ------------------------------------------------------------------------

def roles(df: DataFrame, id_col: str, uri_col: str, payload_col: str, min_bytes: int = 100) -> DataFrame:
    """id, uri, payload, payload_length, payload_digest, warc_type and refers_id of every row.

    The groups' smallest ids are written first, so that the join reads two plain exchanges
    and adaptive execution can split the one of a digest that a third of the rows share."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("bigint").alias("payload_length"), F.sha2("payload", 256).alias("payload_digest"))
    first = rows.where(F.col("payload_length") >= min_bytes).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = written(first.where("n > 1 and first is not null").drop("n"), "warc-first")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return rows.join(first, "payload_digest", "left").select("id", "uri", "payload", "payload_length", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("warc_type"), F.when(revisit, F.col("first")).alias("refers_id"))


def urn(column) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(column.cast("string"), F.lit("null")), F.lit(">"))


def urn_id(column, kind: str) -> F.Column:
    text = F.regexp_extract(column, "^<urn:page:(.*)>$", 1)
    return F.when(~text.isin("", "null"), text).cast(kind)


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 100) -> None:
    """Write one record per row of ``df`` to a new archive folder. Revisits carry no payload."""
    df.sparkSession.dataSource.register(WarcSource)
    marked = roles(df, id_col, uri_col, payload_col, min_bytes)
    revisit = F.col("warc_type") == "revisit"
    marked.select(
        "warc_type", urn(F.col("id")).alias("record_id"), F.col("uri").alias("target_uri"), F.when(revisit, urn(F.col("refers_id"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "payload_digest").alias("payload_digest"), "payload_length", F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").option("path", path).save()


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
