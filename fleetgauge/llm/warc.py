"""WARC archives with an index: writing, and reading selected records by byte ranges.

Writing: each task writes archives of its own (a gzip member per record) to the shared folder and gives back
an index row per record: file, offset, length, URL, digest. The index is a table that Spark commits;
files of attempts that were lost are in no index row and so are never read. A record whose payload
another record has already is a revisit without payload.

Reading: the index rows that are wanted are dealt out by stretches of their files and sorted; ranges that touch, or
nearly do, are fetched in one read, then each record is cut out, unpacked, parsed and its digest checked.

Of rows with equal payloads of at least `least` bytes, that with the smallest page_id (null last, then
smallest URL, null last) is the response; of rows that repeat it whole, one. A null payload is an empty one.
The payload of a page is not moved for revisits, and counts per payload are aggregated ahead of any join.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.tables import arrow_kinds
from fleetgauge.session import work_path, written

ARCHIVE_BYTES = 128 << 20  # an archive is closed beyond this size
STRETCH_BYTES = 4 << 20  # of an archive read by one run of a task
GAP_BYTES = 64 << 10  # bytes between two wanted records that are read along
DATE = "2000-01-01T00:00:00Z"  # equal runs make equal archives

INDEX = {
    "file": "string", "offset": "long", "length": "long", "url": "string", "digest": "string",
    "record_type": "string", "page_id": "long",
}
RECORD = {
    "page_id": "long", "payload_bytes": "long", "payload_digest": "string", "record_type": "string",
    "refers_to": "long", "url": "string", "payload": "binary",
}


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Spark names it."""
    for other in ("s3a://", "s3n://"):
        uri = uri.replace(other, "s3://", 1)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page_id}:{digest}:{copy}')}>"


def _clean(url: str) -> str:
    """The URL as a header value: white space and control characters escaped."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def pack(row: dict) -> bytes:
    """One WARC record as a gzip member."""
    body = row["payload"] or b""
    digest = base64.b32encode(bytes.fromhex(row["sha"])).decode()
    kind = row["record_type"]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = head + body if kind == "response" else head
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}",
        f"WARC-Record-ID: {record_id(kind, row['page_id'], digest, row['copy'])}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if row["page_id"] is not None:
        lines.append(f"X-Page-Id: {row['page_id']}")
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['url'])}")
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id('response', row['refers_to'], digest, 0)}",
        ]
        if row["refers_to"] is not None:
            lines.append(f"X-Refers-To-Page-Id: {row['refers_to']}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(data) + packer.flush()


def unpack(member: bytes) -> dict:
    """A record from its gzip member; raises when the payload does not fit its digest."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(fields["X-Payload-Length"])
    payload = None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != size or base32_sha1(payload) != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-Id"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload": payload,
    }


def _records(pages: DataFrame, least: int) -> DataFrame:
    """What to write: a row per record, payload only for responses."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("sha"),
    )
    rows = base.groupBy("sha", "page_id", "url").agg(F.count("*").alias("n"), F.first("payload_bytes").alias("payload_bytes"))
    rows = written(rows, "payloads")
    large = rows.where(F.col("payload_bytes") >= least)
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url")
    first = large.groupBy("sha").agg(F.min(F.struct(order.alias("o"), "page_id", "url", "n")).alias("f")).select(
        F.col("sha").alias("_sha"), F.col("f.page_id").alias("_page"), F.col("f.url").alias("_url"), F.col("f.n").alias("_n")
    )
    first = written(first, "responses")
    # Revisits: each row but the response itself.
    own = F.col("page_id").eqNullSafe(F.col("_page")) & F.col("url").eqNullSafe(F.col("_url"))
    revisits = (
        large.join(first, F.col("sha") == F.col("_sha"))
        .withColumn("again", F.col("n") - F.when(own, 1).otherwise(0)).where("again > 0")
        .select(
            "page_id", "url", F.lit(None).cast("binary").alias("payload"), "payload_bytes", "sha", F.lit("revisit").alias("record_type"),
            F.col("_page").alias("refers_to"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("again"))).alias("copy"),
        )
    )
    match = (F.col("sha") == F.col("_sha")) & F.col("page_id").eqNullSafe(F.col("_page")) & F.col("url").eqNullSafe(F.col("_url"))
    shape = [
        "page_id", "url", "payload", "payload_bytes", "sha", F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"), F.lit(0).cast("long").alias("copy"),
    ]
    out = base.join(first.where("_n = 1"), match).select(*shape).unionByName(revisits)
    if not first.where("_n > 1").isEmpty():  # rows that repeat a response whole: one payload of them
        one = base.join(first.where("_n > 1"), match).groupBy("sha", "page_id", "url").agg(
            F.first("payload").alias("payload"), F.first("payload_bytes").alias("payload_bytes")
        )
        out = out.unionByName(one.select(*shape))
    if least > 0:
        out = out.unionByName(base.where(F.col("payload_bytes") < least).select(*shape))
    return out


def write_archives(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Archives of all pages; gives the index back, which lies beside them as a table."""
    spark = pages.sparkSession
    folder = folder or work_path(spark, "warc")
    types = arrow_kinds(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index: dict[str, list] = {k: [] for k in INDEX}
                for row in _rows(batch):
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(f"{path}/archives", recursive=True)
                        out = store.open_output_stream(f"{path}/archives/{name}", compression=None)
                    member = pack(row)
                    out.write(member)
                    digest = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                    new = (f"{folder}/archives/{name}", at, len(member), row["url"], digest, row["record_type"], row["page_id"])
                    for k, v in zip(INDEX, new, strict=True):
                        index[k].append(v)
                    at += len(member)
                    if at >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays([pa.array(index[k], t) for k, t in types.items()], names=list(types))
        finally:
            if out is not None:
                out.close()

    schema = ", ".join(f"{k} {v}" for k, v in INDEX.items())
    _records(pages, least).mapInArrow(run, schema).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):  # one row at a time: payloads are not copied all at once
        yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the index rows, as RECORD has them."""
    wanted = {k: v for k, v in RECORD.items() if payload or k != "payload"}
    types = arrow_kinds(wanted)
    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    laid = index.select("file", "offset", "length").repartition("file", stretch).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {"name": None, "file": None}

        def fetch(name: str, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
            if opened["name"] != name:
                if opened["file"] is not None:
                    opened["file"].close()
                store, path = open_store(name)
                opened.update(name=name, file=store.open_input_file(path))
            start, end = ranges[0][0], ranges[-1][0] + ranges[-1][1]
            data = opened["file"].read_at(end - start, start)
            found = [unpack(data[a - start : a - start + n]) for a, n in ranges]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in types.items()], names=list(types))

        held: list[tuple[int, int]] = []
        at = None
        for batch in batches:
            for name, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                end = held[-1][0] + held[-1][1] if held else 0
                if held and (name != at or start - end > GAP_BYTES or start + n - held[0][0] > STRETCH_BYTES):
                    yield fetch(at, held)
                    held = []
                at = name
                held.append((start, n))
        if held:
            yield fetch(at, held)
        if opened["file"] is not None:
            opened["file"].close()

    return laid.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in wanted.items()))


def digest(pages: DataFrame) -> DataFrame:
    """`page_id, payload_bytes, payload_digest, record_type, refers_to` of every page, read back."""
    return read_records(write_archives(pages), payload=False).drop("url")
