"""WARC archives: writing captures, reading records, and assembling transactions.

Each page becomes three records: a request, a response (or a revisit, where a payload is stored elsewhere already) and
a metadata record. Request and metadata name the response in WARC-Concurrent-To, a revisit names the response that holds
its payload in WARC-Refers-To. Ids of records are hashed from what they capture. Tasks write one compressed archive
each into the shared folder, one gzip member a record, and read archives as streams, a record at a time.

Which of the pages with equal payloads keeps it is found by an aggregate over digests. Payloads are never shuffled by
digest: the decisions about repeated digests, rows of some bytes, are joined to the pages by page, and a digest or a
response that many pages share is joined by broadcast.

Edge cases: a null page is the empty payload; rows that agree in id, address and payload are all responses of their
own, with a number of repetition in their ids; null ids count as smallest, an empty address is a null one; a record without its
partners keeps nulls for them; an archive that is damaged or breaks off gives the records before the damage and one
record of type `damaged`; archives that aren't compressed are read too; very long payloads are held one at a time; an
empty table gives an empty archive set; columns besides id, address and payload are not read, so names can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, named, new_path, open_store, publish, table, whole_text, written

DATE = "2024-01-01T00:00:00Z"
BLOCK = 1 << 20


def b32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


# ---- records ----

def record(kind: str, record_id: str, body: bytes, **fields: str | None) -> bytes:
    """One gzip member that holds a record. Names of fields: WARC_Target_URI for WARC-Target-URI."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE)]
    head += [(k.replace("_", "-"), re.sub(r"[\r\n]+", " ", v)) for k, v in fields.items() if v is not None]
    head += [("WARC-Block-Digest", "sha1:" + b32(hashlib.sha1(body).digest())), ("Content-Length", str(len(body)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(text.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n") + z.flush()


def inflated(stream) -> Iterator[bytes]:
    """Blocks of the content of joined gzip members, or of a stream that isn't compressed."""
    data = stream.read(BLOCK)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = stream.read(BLOCK)
        return
    z = zlib.decompressobj(31)
    while data or (data := stream.read(BLOCK)):
        out = z.decompress(data, BLOCK)
        if out:
            yield out
        if z.eof:
            data, z = z.unused_data, zlib.decompressobj(31)
        else:
            data = z.unconsumed_tail


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, body) of each record; memory holds one record and a block. ValueError where it is damaged."""
    blocks, buffer = inflated(stream), bytearray()

    def need(n: int) -> bool:
        while len(buffer) < n:
            try:
                block = next(blocks, None)
            except zlib.error as e:
                raise ValueError("a member is damaged") from e
            if block is None:
                return False
            buffer.extend(block)
        return True

    while True:
        at = 0
        while (end := buffer.find(b"\r\n\r\n", max(0, at - 3))) < 0:
            at = len(buffer)
            if not need(at + 1):
                if buffer.strip():
                    raise ValueError("the archive ends inside a header")
                return
        first, *lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
        fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        size = fields.get("content-length", "")
        if not first.startswith("WARC/") or not size.isdecimal() or "warc-type" not in fields:
            raise ValueError("a record's header is damaged")
        if not need(end + 4 + int(size) + 4):
            raise ValueError("the archive ends inside a record")
        body = bytes(buffer[end + 4 : end + 4 + int(size)])
        del buffer[: end + 4 + int(size) + 4]
        yield fields, body


# ---- writing ----

def classify(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, sha1, copy, kept): kept is null for a response, else its response's page_id and url.

    copy numbers rows that agree in all of page_id, url and payload.
    """
    payload = F.encode(whole_text(payload_col), "UTF-8")
    rows = pages.select(named(id_col).alias("page_id"), F.coalesce(named(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    page = ["page_id", "url", "sha1"]
    seen = written(rows.select(*page, (F.octet_length("payload") < min_bytes).alias("small")), "digests")
    shared = seen.groupBy("sha1").agg(F.max(F.struct("page_id", "url")).alias("kept"), F.count("*").alias("n")).filter("n > 1")
    told = join_hot(seen, written(shared, "shared-digests"), ["sha1"], "n", seen.count())
    told = told.groupBy(*page).agg(F.count("*").alias("n"), F.first("kept").alias("kept"), F.first("small").alias("small"))
    own = F.struct("page_id", "url").eqNullSafe(F.col("kept")) | F.col("small")
    marks = written(told.select(*(F.col(c).alias(f"m_{c}") for c in page), F.when(~own, F.col("kept")).alias("kept"), "n").filter("kept is not null or n > 1"), "marks")
    same = [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in page]
    marked = rows.join(marks, same[0] & same[1] & same[2], "left")
    once = marked.filter("n is null or n = 1").select("page_id", "url", "payload", "sha1", F.lit(0).alias("copy"), "kept")
    if marks.filter("n > 1").isEmpty():
        return once
    several = marked.filter("n > 1").dropDuplicates(page)
    return once.union(several.select("page_id", "url", "payload", "sha1", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("copy"), "kept"))


def record_id(kind: str, sha1: str, page_id, url: str, copy: int = 0) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {sha1} {page_id} {copy} {url}')}"


def write_warc(captures: DataFrame, folder: str) -> DataFrame:
    """Writes classified captures; returns the manifest (file, n_records), a written table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, count = f"{part:08d}.warc.gz", 0

        def records(out) -> None:
            nonlocal count
            for batch in batches:
                for row in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
                    url, kept = row["url"], row["kept"]
                    request, response, metadata = (record_id(kind, row["sha1"], row["page_id"], url, row["copy"]) for kind in ("request", "response", "metadata"))
                    host, _, path = re.sub(r"^\w+://", "", url).partition("/")
                    digest = "sha1:" + b32(bytes.fromhex(row["sha1"]))
                    out.write(record("request", request, f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode("utf-8", "surrogatepass"), WARC_Target_URI=url or None, WARC_Concurrent_To=f"<{response}>", Content_Type="application/http;msgtype=request"))
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(row["payload"])
                    more = {"WARC_Refers_To": f"<{record_id('response', row['sha1'], kept['page_id'], kept['url'])}>", "WARC_Refers_To_Target_URI": kept["url"], "WARC_Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"} if kept else {}
                    out.write(record("revisit" if kept else "response", response, http + (b"" if kept else row["payload"]), WARC_Target_URI=url or None, WARC_Payload_Digest=digest, Content_Type="application/http;msgtype=response", **more))
                    fields = "" if row["page_id"] is None else f"page-id: {row['page_id']}\r\n"
                    out.write(record("metadata", metadata, fields.encode(), WARC_Target_URI=url or None, WARC_Concurrent_To=f"<{response}>", Content_Type="application/warc-fields"))
                    count += 3

        publish(f"{folder}/{name}", records)
        yield pa.RecordBatch.from_pydict({"file": pa.array([name]), "n_records": pa.array([count], pa.int64())})

    rows = captures.select("page_id", "url", "payload", "sha1", "copy", "kept")
    return written(rows.mapInArrow(write, "file string, n_records long"), "warc-manifest")


# ---- reading ----

RECORD_SCHEMA = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, stored_digest string, payload_bytes long, fields string, payload binary"


def scan_warc(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives. Payloads are hashed as they are read; they are returned only on demand."""
    n = max(1, manifest.count())
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    types = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary()]
    inner = lambda f, name: f.get(name, "").strip("<>") or None

    def row(f: dict[str, str], body: bytes) -> tuple:
        kind = f["warc-type"]
        http = kind in ("response", "revisit")
        payload = body.partition(b"\r\n\r\n")[2] if kind == "response" else None
        return (
            inner(f, "warc-record-id"), kind, inner(f, "warc-concurrent-to"), inner(f, "warc-refers-to"), f.get("warc-target-uri"),
            f.get("warc-payload-digest", "").removeprefix("sha1:") or None if http else None,
            None if payload is None else b32(hashlib.sha1(payload).digest()), None if payload is None else len(payload),
            body.decode("utf-8", "replace") if kind == "metadata" else None, payload if with_payload else None,
        )

    def rows_of(stream) -> Iterator[tuple]:
        try:
            for f, body in read_records(stream):
                yield row(f, body)
        except ValueError:
            yield (None, "damaged", *[None] * 8)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = open_store(f"{folder}/{name}")
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for r in rows_of(stream):
                        rows.append(r)
                        held += len(r[-1] or b"") + 500
                        if held > BLOCK * 4:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return manifest.select("file").repartition(n, "file").mapInArrow(scan, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: its response or revisit, with the request and metadata that are concurrent to it.

    Give it records that are a table by themselves (written): each kind is a pass over them.
    """
    responses = records.filter(F.col("record_type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), F.struct("record_id", "record_type", "refers_to", "target_uri", "payload_digest", "stored_digest", "payload_bytes", "payload").alias("response"))
    requests = records.filter(F.col("record_type") == "request").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "target_uri").alias("request"))
    metadata = records.filter(F.col("record_type") == "metadata").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "fields").alias("metadata"))
    return responses.join(requests, "capture_id", "left").join(metadata, "capture_id", "left")


def lost_pages(pages: DataFrame, captures: DataFrame) -> DataFrame:
    """(page_id) of the pages whose captures are not among those that were read, as often as they are missing."""
    counts = pages.select("page_id", F.lit(1).alias("n")).union(captures.select("page_id", F.lit(-1)))
    missing = counts.groupBy("page_id").agg(F.sum("n").alias("n")).filter("n > 0")
    return missing.select("page_id", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("page_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, read back, assembled into captures; what each record says of its payload."""
    folder = new_path(spark, "warc")
    manifest = write_warc(classify(table(spark, sf_dir, "pages")), folder)
    # written once: the archives are parsed once, and the joins know the records' true size (a manifest's is tiny)
    records = written(scan_warc(manifest, folder, with_payload=False), "warc-records")
    captures = written(assemble(records).select(
        "capture_id", F.regexp_extract("metadata.fields", r"page-id: (-?\d+)", 1).try_cast("long").alias("page_id"), F.col("request.target_uri").alias("url"),
        *(F.col(f"response.{c}").alias(c) for c in ("record_type", "refers_to", "payload_digest", "stored_digest", "payload_bytes")),
    ), "captures")
    responses, revisits = captures.filter("record_type = 'response'"), captures.filter("record_type = 'revisit'")
    # what a revisit says of its payload is held against the response that its archive names; where that was lost, its size and page are null
    named_ids = revisits.groupBy(F.col("refers_to").alias("capture_id")).agg(F.count("*").alias("n"))
    kept = named_ids.join(responses, "capture_id", "left").select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("kept_id"), F.col("payload_bytes").alias("kept_bytes"), "n")
    found = join_hot(revisits.drop("payload_bytes"), written(kept, "referred"), ["refers_to"], "n", captures.count())
    read = responses.select("page_id", "payload_bytes", F.col("stored_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "url").union(
        found.select("page_id", F.col("kept_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("kept_id").alias("refers_to"), "url"))
    return read.union(lost_pages(table(spark, sf_dir, "pages"), captures).select("page_id", *(F.lit(None).cast(read.schema[c].dataType).alias(c) for c in read.columns[1:])))
