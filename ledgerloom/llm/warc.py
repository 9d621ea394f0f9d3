"""A deterministic sharded WARC writer and its reader.

Writing. Of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest page_id is a response,
others revisit it; that is settled by a map-side combined aggregation over digests, joined back with rows of frequent digests dealt by page_id. Each record is made
and compressed (a gzip member of its own) where its page is read, so only compressed records are moved. They are
range-sorted by page_id. A range is a run of cells of equal width, CELLS at most whatever the ids, with about SHARD_BYTES of payload (more in a very large input, so that there are SHARDS
ranges at most), from exact sums over all rows; a cell heavier than that is split by a hash of page_id and digest. So shards, files and their bytes depend on the
rows alone, not on settings or partitions. A shard's task rolls to a new file once FILE_BYTES of compressed records
are reached, begins each file with a warcinfo record, writes it under a temporary name of its own attempt and renames it to its final name, which holds
the shard's and the file's number. A repeated attempt or a lost executor thus leaves the same final files and at
worst stray temporary ones, which no reader looks at. The tasks' manifest rows (file, records, bytes, sha256) are stored
as a table; a file counts only if the manifest names it.

Reading goes by the manifest: files are dealt to tasks, every file's digest is compared, records are parsed from their
headers, block digests are recomputed, and a record that does not agree with its headers fails the job.

The folder may be in any store that pyarrow opens by its URI; it must be shared. Null html is an empty payload. A null
url gives a record without target URI. Null page_ids sort first, have no identity, and neither revisit nor are
revisited. Repeated rows of a page_id each get a record with an id of its own (a record's id comes from page_id and digest, and from its place among equal
ones); they refer to another record only if its page_id differs. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._spark import HUB, _meet, partitions, scratch, small, store, store_counted

MIN_REVISIT = 100
FILE_BYTES = 64 << 20
SHARD_BYTES = 16 << 20
SHARDS = 100_000
#: Cells of equal width into which the ids' range is cut: one for so many rows, and so many at most; running sums go by blocks of BLOCK cells.
CELL_ROWS, CELLS, BLOCK = 256, 100_000, 1_024
#: Bytes of a record besides its payload, about.
OVERHEAD = 700
DATE = "2024-01-01T00:00:00Z"
_NS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str, place: int = 0) -> str:
    """The id of a record; place counts the records before it with equal page_id and digest."""
    return f"<urn:uuid:{uuid.uuid5(_NS, f'page {page_id} {digest}' + (f' {place}' if place else ''))}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers: int | None, place: int = 0) -> bytes:
    """One WARC/1.1 record, uncompressed; digest is the payload's SHA-256."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, place)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_id(refers, digest)}", f"X-Refers-To-Page: {refers}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(file: str) -> bytes:
    """The warcinfo record that begins a file."""
    block = b"software: ledgerloom\r\nformat: WARC File Format 1.1\r\n"
    head = [
        "WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NS, 'file ' + file)}>", f"WARC-Date: {DATE}", f"WARC-Filename: {file}",
        "Content-Type: application/warc-fields", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(data: bytes) -> bytes:
    """A gzip member without a time or a name."""
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(data) + packed.flush()


def renamed(packed: bytes, place: int) -> bytes:
    """A packed record under the id of a later place among equal ones."""
    data = zlib.decompress(packed, 31)
    fields = dict(x.split(": ", 1) for x in data.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
    page, digest = fields.get("X-Page-ID"), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    return pack(data.replace(fields["WARC-Record-ID"].encode(), record_id(None if page is None else int(page), digest, place).encode(), 1))


def parse(data: bytes) -> dict | None:
    """The fields of a page's record, None for a warcinfo record; raises ValueError where digests or lengths disagree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
        raise ValueError(f"block of {fields['WARC-Record-ID']} disagrees with its header")
    if fields["WARC-Type"] == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} disagrees with its header")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
    return {
        "page_id": None if page is None else int(page), "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": None if refers is None else int(refers),
    }


def _records(batches):
    """Of pages (page_id, url, html, digest, first, shard): the compressed records."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            ids, urls, digests, refers = (part.column(i).to_pylist() for i in (0, 1, 3, 4))
            out = []
            for page, url, html, digest, first in zip(ids, urls, part.column(2).cast(pa.binary()), digests, refers):
                out.append(pack(record(page, url, html.as_py() or b"", digest, "response" if first is None else "revisit", first)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(5), part.column(3), part.column(1), pa.array(out, pa.binary())], ["page_id", "shard", "digest", "url", "packed"])


def _files(folder: str, limit: int):
    def run(batches):
        from pyspark import TaskContext

        store_, base = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        attempt, shard = context.taskAttemptId(), -1
        rows, sink = [], None

        def close():
            sink.close()
            store_.move(temporary, final)
            rows.append((final.rpartition("/")[2], shard, number, records, size, seen.hexdigest()))

        number, last, place = -1, None, 0
        for batch in batches:
            for packed, page, own, digest in zip(batch.column(4), batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = packed.as_py()
                if own != shard:
                    if sink is not None:
                        close()
                    sink, shard, number = None, own, -1
                place = place + 1 if (page, digest) == last else 0
                last = page, digest
                if place:
                    data = renamed(data, place)
                if sink is None:
                    number, records = number + 1, 0
                    final = f"{base}/part-{shard:06d}-{number:05d}.warc.gz"
                    temporary = f"{base}/.{shard:06d}-{number:05d}-{attempt}-{uuid.uuid4().hex}.tmp"
                    sink = store_.open_output_stream(temporary, compression=None)
                    first = pack(info(final.rpartition("/")[2]))
                    sink.write(first)
                    size, seen = len(first), hashlib.sha256(first)
                sink.write(data)
                seen.update(data)
                records, size = records + 1, size + len(data)
                if size >= limit:
                    close()
                    sink = None
        if sink is not None:
            close()
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0]), *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array(cols[5])],
                ["file", "shard", "number", "records", "bytes", "sha256"],
            )

    return run


def _parsed(folder: str):
    def run(batches):
        store_, base = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for file, want, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows, seen = 0, hashlib.sha256()
                with store_.open_input_stream(f"{base}/{file}", compression=None) as source:
                    out = []
                    for member in _members(source, seen):
                        fields = parse(member)
                        if fields is None:
                            continue
                        out.append(fields)
                        rows += 1
                        if len(out) == 5000:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                    yield pa.RecordBatch.from_pylist(out, schema)
                if seen.hexdigest() != want or rows != records:
                    raise ValueError(f"{file} disagrees with its manifest")

    return run


def _members(source, seen):
    """The decompressed gzip members of a stream, one at a time."""
    unpack, data = zlib.decompressobj(31), []
    while chunk := source.read(1 << 20):
        seen.update(chunk)
        while chunk:
            data.append(unpack.decompress(chunk))
            chunk = unpack.unused_data
            if unpack.eof:
                yield b"".join(data)
                unpack, data = zlib.decompressobj(31), []
            else:
                break
    if data and any(data):
        raise ValueError("a record is cut off")


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives of pages (page_id, url, html) into folder (a URI); returns the stored manifest."""
    spark = pages.sparkSession
    target, base = fs.FileSystem.from_uri(folder)
    target.create_dir(base, recursive=True)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    size = F.octet_length("html")
    pages = pages.withColumn("digest", F.sha2("html", 256))
    keyed = pages.where(size >= MIN_REVISIT).where("page_id is not null").select(F.unhex("digest").alias("u"), F.col("page_id").alias("v"))
    first = keyed.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("last"), F.count(F.lit(1)).alias("n")).where("m < last")
    first, seen = store_counted(first.select("u", "m", "n"), "payloads", hubs=F.count_if(F.col("n") > HUB))
    met = _meet(keyed, first.select("u", "m"), first.where(F.col("n") > HUB).select("u", "n"), seen["hubs"])
    refers = met.where("v > m").select(F.col("v").alias("__page"), F.hex("u").alias("__digest"), F.col("m").alias("first")).distinct()
    refers = store(refers, "revisits")
    marked = pages.join(refers, (F.col("page_id") == F.col("__page")) & (F.upper("digest") == F.col("__digest")), "left")
    cells, n, cell = _ranges(pages, size)
    marked = marked.join(cells, cell.eqNullSafe(F.col("cell"))).withColumn("shard", (F.col("base") + F.pmod(F.xxhash64("page_id", "digest"), F.col("parts"))).cast("int"))
    records = marked.select("page_id", "url", "html", "digest", "first", "shard").mapInArrow(_records, "page_id long, shard int, digest string, url string, packed binary")
    sorted_ = records.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "url")
    return store(sorted_.mapInArrow(_files(folder, file_bytes), "file string, shard long, number long, records long, bytes long, sha256 string"), "manifest")


def _ranges(pages: DataFrame, size: Column) -> tuple[DataFrame, int, Column]:
    """cell, base, parts: the first shard of each cell of ids and the shards it takes; the number of shards; and the cell of a row. There are CELLS cells at most, dense ids or
    hashed ones, so the sums ahead of their blocks are some hundred rows."""
    bytes_ = (size + F.lit(OVERHEAD)).cast("long")
    known = pages.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.count("page_id").alias("n")).first()
    span = (known["high"] or 0) - (known["low"] or 0) + 1
    width = min(1 << 62, max(1, -(-span // max(1, min(CELLS, known["n"] // CELL_ROWS)))))
    cell = F.expr(f"page_id div {width}L")
    sums, seen = store_counted(pages.groupBy(cell.alias("cell")).agg(F.sum(bytes_).alias("bytes")), "cells", n=F.count(F.lit(1)), total=F.sum("bytes"))
    share = max(SHARD_BYTES, -(-(seen["total"] or 0) // SHARDS))
    sums = sums.withColumn("block", F.expr(f"cell div {BLOCK}L"))
    before = lambda w: F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sums.groupBy("block").agg(F.sum("bytes").alias("bytes")).select(F.col("block").alias("b"), before(Window.orderBy(F.col("block").asc_nulls_first())).alias("ahead"))
    at = sums.withColumn("inside", before(Window.partitionBy("block").orderBy(F.col("cell").asc_nulls_first()))).join(F.broadcast(blocks), F.col("block").eqNullSafe(F.col("b")))
    parts = F.greatest(F.lit(1), F.floor(F.col("bytes") / F.lit(share))).cast("long")
    out = at.select("cell", F.floor((F.col("ahead") + F.col("inside")) / F.lit(share)).cast("long").alias("base"), parts.alias("parts"))
    return small(out, seen["n"]), int(-(-(seen["total"] or 0) // share)) + 1, cell


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the files that the manifest names."""
    files = manifest.select("file", "sha256", "records").repartition(partitions(manifest.sparkSession), "file")
    return files.mapInArrow(
        _parsed(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def query(spark, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    return read(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder)


SQL = """
with p as (select page_id, encode(coalesce(html, '')) payload from pages),
q as (select page_id, octet_length(payload)::bigint payload_bytes, sha256(payload) payload_digest from p),
r as (select *, min(page_id) over (partition by payload_digest) as first from q)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id > first then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 100 and page_id > first then first end refers_to
from r
"""
