"""WARC archives: written with segmented records and chunked transfer framing, read back and reassembled.

Archives are text files of Spark's writer whose line separator is the two line ends that close a WARC record, so
executors write them to any store that Spark knows. A record's block is HTTP headers and a chunked body. A block
over ``segment_bytes`` goes out as a response record and continuation records that name it as their origin. Spark's
reader takes gzip archives apart at the same separator; a task puts the pieces together again record by record, so
an archive may be larger than a task's memory. Spark's writer compresses a file as one gzip stream, not as a member
for each record; archives of many members are read as well.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import checkpointed, dropped, scratch, written

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

END = "\r\n\r\n"

RECORDS = (
    T.StructType().add("warc_type", "string").add("record_id", "string").add("origin", "string").add("refers_to", "string").add("target_uri", "string")
    .add("digest", "string").add("segment", "integer").add("total", "long").add("block", "binary").add("payload", "binary").add("status", "string")
)
PAYLOADS = T.StructType().add("record_id", "string").add("target_uri", "string").add("declared", "string").add("payload", "binary").add("status", "string")


def chunked(payload: Column, size: int) -> Column:
    """The binary column in chunked transfer framing."""
    piece = lambda i: F.concat(
        F.hex(F.least(F.lit(size), F.octet_length(payload) - i * size)).cast("binary"),
        F.lit("\r\n").cast("binary"), F.substring(payload, i * size + 1, F.lit(size)), F.lit("\r\n").cast("binary"),
    )
    n = F.ceil(F.octet_length(payload) / F.lit(size)).cast("int")
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: piece(i).cast("string")))
    return F.concat(F.coalesce(F.array_join(parts, ""), F.lit("")).cast("binary"), F.lit("0\r\n\r\n").cast("binary"))


def mark_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Adds ``payload``, ``payload_digest``, ``payload_bytes``, ``first_id`` (set for revisits only), ``alone`` and ``leads``.

    Of equal payloads of ``least_bytes`` or more, the row with the smallest id is the response. The smallest id of
    each digest comes from an aggregation that combines on the map side; Spark splits a hot digest in the join.
    ``alone``: only one row has that id and payload, so that it can be referred to; ``leads``: this is that row.
    """
    rows = pages.withColumn("payload", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")).withColumns(
        {"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")}
    )
    first = (
        rows.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("payload_digest").alias("d"), "page_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("d").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n"))).alias("first"), F.sum("n").alias("n")).where("n > 1")
        .select("d", F.col("first.page_id").alias("first_id"), (F.col("first.n") == 1).alias("alone"))
    )
    joined = rows.join(first, F.col("payload_digest") == F.col("d"), "left").drop("d")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.withColumns({"leads": F.coalesce(is_first & F.col("alone"), F.lit(False)), "first_id": F.when(~is_first, F.col("first_id"))})


def record_name(page_id: Column, tail: Column) -> Column:
    """A record id that ``page_id_of`` reads; ``tail`` makes it unique."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.concat(F.lit("="), F.url_encode(page_id.cast("string"))), F.lit("")), F.lit(":"), tail, F.lit(">"))


def write_warc(pages: DataFrame, path: str, segment_bytes: int = 16384, chunk_bytes: int = 4096, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 100) -> None:
    """Writes a record per row of ``pages`` (``page_id``, ``url``, ``html``) to gzip archives under ``path``.

    Null html is an empty payload; a null url leaves the target out; null ids and repeated rows get records of their
    own. A record id ends in a number that is unique in the job; that of a response with revisits ends in its digest
    instead, so that they can name it (``WARC-Refers-To``) without a second look at it. Where the response's row is
    repeated, its copies have numbers, and the revisits name none of them. A revisit record has the HTTP headers, but
    no payload.
    """
    rows = mark_revisits(pages.select("page_id", "url", "html"), least_bytes)
    number = F.monotonically_increasing_id().cast("string")
    rows = rows.withColumn("rid", record_name(F.col("page_id"), F.when(F.col("leads"), F.col("payload_digest")).otherwise(number)))
    rows = rows.withColumn("response", F.when(F.col("alone"), record_name(F.col("first_id"), F.col("payload_digest"))))
    revisit = F.col("first_id").isNotNull()
    block = F.when(revisit, F.lit(HTTP).cast("binary")).otherwise(F.concat(F.lit(HTTP).cast("binary"), chunked(F.col("payload"), chunk_bytes)))
    rows = rows.select("rid", "response", "payload_digest", revisit.alias("revisit"), F.regexp_replace("url", r"\s", "%20").alias("uri"), block.alias("block"))
    n = F.ceil(F.octet_length("block") / F.lit(segment_bytes)).cast("int")
    rows = rows.withColumn("n", n).withColumn(
        "part", F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("k"), F.substring(F.col("block"), (k - 1) * segment_bytes + 1, F.lit(segment_bytes)).alias("bytes"))))
    )
    k, many = F.col("part.k"), F.col("n") > 1
    line = lambda name, value, when=None: F.when(when if when is not None else F.lit(True), F.concat(F.lit(f"{name}: "), value.cast("string")))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").when(k > 1, "continuation").otherwise("response")),
        line("WARC-Record-ID", F.when(k > 1, F.concat(F.regexp_replace("rid", ">$", ""), F.lit(":"), k.cast("string"), F.lit(">"))).otherwise(F.col("rid"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest")), k == 1),
        line("WARC-Profile", F.lit(PROFILE), F.col("revisit")),
        line("WARC-Refers-To", F.col("response"), F.col("revisit")),
        line("WARC-Segment-Number", k, many),
        line("WARC-Segment-Origin-ID", F.col("rid"), k > 1),
        line("WARC-Segment-Total-Length", F.octet_length("block"), many & (k == F.col("n"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("part.bytes")),
        F.lit("\r\n"),
    )
    record = F.concat(head.cast("binary"), F.col("part.bytes")).cast("string")
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


class Pieces(io.RawIOBase):
    """A stream of pieces of bytes with ``END`` after each, as it was before Spark's reader took them apart."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces = (part for piece in pieces for part in (piece, END.encode()))
        self.rest = memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.rest:
            if (piece := next(self.pieces, None)) is None:
                return 0
            self.rest = memoryview(piece)
        n = min(len(into), len(self.rest))
        into[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (names in lower case) and block of each record of an archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("an archive record doesn't start with its version")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head.get("content-length", 0))
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("an archive ends within a record")
        yield head, block


def record_row(head: dict[str, str], block: bytes) -> tuple:
    """A row of ``RECORDS``: segments keep their block, other responses are decoded."""
    number, total, digest = (head.get(f"warc-{k}") for k in ("segment-number", "segment-total-length", "payload-digest"))
    kind, rid, payload, status = head.get("warc-type"), head.get("warc-record-id"), None, "ok"
    if number is None and kind == "response":
        payload, status = checked_body(block, digest)
    return (
        kind, rid, head.get("warc-segment-origin-id", rid), head.get("warc-refers-to"), head.get("warc-target-uri"), digest,
        int(number) if number else None, int(total) if total else None, block if number else None, payload, status,
    )


def arrow_rows(rows: Iterable[tuple], schema: pa.Schema, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows as Arrow batches of about ``most_bytes`` of binary values at most; a larger row is a batch alone."""
    held, size = [], 0
    for row in rows:
        new = sum(len(v) for v in row if isinstance(v, bytes))
        if held and (size + new > most_bytes or len(held) >= 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
        held.append(row)
        size += new
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``, in the columns of ``RECORDS``, each archive read once and in its order.

    Files named ``.gz`` are gzip archives, read piece by piece: a task holds one record, not the file. Spark would cut
    a plain archive at any place, so each of those is one row (2 GB at most). A record that is part of a segmented one
    has ``segment`` and its ``block``; another response has its ``payload``, or null and a ``status`` that says why.
    An empty folder gives no rows; an archive that breaks off raises.
    """
    schema = to_arrow_schema(RECORDS)

    def pieces(batches):
        for batch in batches:
            yield from zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist(), strict=True)

    def from_pieces(batches):
        files = itertools.groupby(pieces(batches), key=lambda x: x[0])
        streams = (io.BufferedReader(Pieces(piece for _, piece in group)) for _, group in files)
        return arrow_rows((record_row(*r) for stream in streams for r in parse_records(stream)), schema)

    def from_files(batches):
        streams = (io.BytesIO(content.as_buffer()) for batch in batches for content in batch.column("content"))
        return arrow_rows((record_row(*r) for stream in streams for r in parse_records(stream)), schema)

    files = spark.read.option("recursiveFileLookup", "true")
    packed = files.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path)
    packed = packed.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    plain = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(path).where(~F.col("_metadata.file_path").endswith(".gz"))
    return packed.mapInArrow(from_pieces, RECORDS).unionByName(plain.select("content").mapInArrow(from_files, RECORDS))


def join_segments(parts: list[tuple[int, bytes, int | None]]) -> tuple[bytes | None, str]:
    """The whole block of the segments (number, bytes, total length), and "ok" or what is wrong.

    A segment that comes twice with equal bytes counts once.
    """
    by: dict[int, bytes] = {}
    for number, block, _ in parts:
        if by.setdefault(number, block) != block:
            return None, f"segment {number} differs between copies"
    if sorted(by) != list(range(1, len(by) + 1)):
        return None, "a segment is missing"
    whole = b"".join(by[k] for k in sorted(by))
    totals = {t for _, _, t in parts if t is not None}
    if not totals and len(by) > 1:
        return None, "no segment has the total length"
    if totals - {len(whole)}:
        return None, f"the length is {len(whole)}, not {min(totals)}"
    return whole, "ok"


def http_body(block: bytes) -> tuple[bytes | None, str]:
    """The body after the HTTP headers, without chunked framing if the headers tell of it, and "ok" or what is wrong."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return None, "the HTTP headers don't end"
    if not re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head):
        return body, "ok"
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0 or not re.fullmatch(rb"\s*[0-9a-fA-F]+\s*", size := body[at:end].partition(b";")[0]):
            return None, "a chunk's size can't be read"
        if not (n := int(size, 16)):
            return b"".join(out), "ok"
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None, "a chunk doesn't end where its size says"
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def checked_body(block: bytes, digest: str | None) -> tuple[bytes | None, str]:
    """The body of a whole block, and "ok" or what is wrong; a declared SHA-256 (in hex) must be the body's own."""
    body, status = http_body(block)
    if body is not None and digest and digest.startswith("sha256:") and digest[7:].lower() != hashlib.sha256(body).hexdigest():
        return None, "the payload's digest isn't the declared one"
    return body, status


def join_records(records: DataFrame) -> DataFrame:
    """The payloads of segmented ``records``, as ``PAYLOADS``: segments meet in a grouping by origin id, which holds one record's only."""
    grouped = (
        records.where("segment is not null").groupBy("origin")
        .agg(F.max("target_uri").alias("target_uri"), F.max("digest").alias("digest"), F.collect_list(F.struct("segment", "block", "total")).alias("parts"))
    )
    schema = to_arrow_schema(PAYLOADS)

    def joined(rid, uri, digest, parts):
        block, status = join_segments([(p["segment"], p["block"], p["total"]) for p in parts])
        if block is not None:
            block, status = checked_body(block, digest)
        return rid, uri, digest, block, status

    def run(batches):
        rows = (row for batch in batches for at in range(0, batch.num_rows, 64) for row in zip(*(batch.slice(at, 64).column(i).to_pylist() for i in range(4)), strict=True))
        return arrow_rows((joined(*row) for row in rows), schema)

    return grouped.select("origin", "target_uri", "digest", "parts").mapInArrow(run, PAYLOADS)


def reassemble(spark: SparkSession, path: str) -> DataFrame:
    """The response records under ``path``, whole: ``record_id``, ``target_uri``, ``declared`` (digest), ``payload``, ``status``.

    Only segments are shuffled; for them the archives are read a second time, rather than written as they are. Where
    segments, chunks or digests don't fit together, the payload is null and ``status`` says why. An empty archive
    gives no rows.
    """
    records = read_records(spark, path)
    whole = records.where("segment is null and warc_type = 'response'").select("record_id", "target_uri", F.col("digest").alias("declared"), "payload", "status")
    return whole.unionByName(join_records(records))


def page_id_of(record_id: str) -> Column:
    """The page id in a record id of ``write_warc``, as text: an empty one stands after its sign, a null one has none."""
    return F.when(F.col(record_id).rlike("^<urn:page:="), F.url_decode(F.regexp_extract(record_id, "^<urn:page:=([^:>]*):", 1)))


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes ``pages`` as archives and returns what they hold: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``status``.

    The archives are read once: lengths and digests of whole payloads, revisits, and the segments, which then meet. A
    revisit finds its response by digest, as readers of archives do; where it names a record, that must be the
    response's. Length and digest of a response come from its payload, null where it can't be read; such a response
    and the revisits of it have a ``status``. Without a ``path`` the archives are deleted when they have been read.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    folder = path or scratch(spark, "warc")
    write_warc(pages, folder, **options)
    size, sha = F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    heads = ["warc_type", "record_id", "origin", "refers_to", "target_uri", "digest", "segment", "total", "block", "status"]
    records = written(read_records(spark, folder).select(*heads, size, sha), "warc_records", batch_rows=1000)
    found = ["record_id", "warc_type", "refers_to", "payload_bytes", "payload_digest", "status"]
    joined = join_records(records).select("record_id", F.lit("response").alias("warc_type"), F.lit(None).cast("string").alias("refers_to"), size, sha, "status")
    whole = records.where("segment is null").withColumn("payload_digest", F.coalesce("payload_digest", F.regexp_replace("digest", "^sha256:", "")))
    rows = checkpointed(whole.select(*found).unionByName(joined).withColumn("page_id", page_id_of("record_id").cast(kind)).withColumnRenamed("refers_to", "named"))
    dropped(records)
    if path is None:
        dropped(spark.read.text(folder))
    least = options.get("least_bytes", 100)
    responses, revisits = (rows.where(F.col("warc_type") == t) for t in ("response", "revisit"))
    by_digest = responses.where((F.col("payload_bytes") >= least) & (F.col("status") == "ok")).groupBy("payload_digest").agg(
        F.min("page_id").alias("refers_to"), F.min_by("record_id", "page_id").alias("response"), F.max("payload_bytes").alias("payload_bytes")
    )
    status = F.when(F.col("payload_bytes").isNull(), "no response has this digest").when(F.col("named") != F.col("response"), "the record named isn't the response")
    revisits = revisits.drop("payload_bytes").join(by_digest, "payload_digest", "left").withColumn("status", F.coalesce(status, F.lit("ok")))
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to", "status"]
    return responses.withColumn("refers_to", F.lit(None).cast(kind)).select(*columns).unionByName(revisits.select(*columns))
