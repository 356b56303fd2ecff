"""WARC archives with revisit records for repeated payloads.

Headers (id, URL, digest, size) are shuffled by payload digest; of equal payloads of at
least ``min_bytes`` the record with the largest id stays a response, the others become
revisit records that refer to it. The archives are written by Spark's text writer with
the record terminator as line separator, so any shared store will do, and hold fresh
headers. The reader goes by Content-Length alone, so payloads may hold anything.

Defined results: a null payload is an empty one; empty and small payloads are always
responses; among equal ids the record is one and the same, so all such rows are responses;
a null id is never referred to (if all ids of a payload are null, all are responses);
a null URL gives no target header, line ends in URLs are percent-encoded; an empty table
gives an empty archive; columns are selected by name, others may have any name.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwire.llm.common import arrow_map, parted, written

_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.sha1(F.concat_ws(":", F.lit("page"), page_id.cast("string"), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; nothing for a null value."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def resolve_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """``(id, url, payload, digest, size, type, refers_to, refers_url)`` for every row."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    large = rows.filter(F.col("size") >= min_bytes)
    heads = large.groupBy("digest", "size").agg(F.max(F.struct("id", "url")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first.id is not null")
    heads = written(heads.select("digest", "size", F.col("first.id").alias("to"), F.col("first.url").alias("to_url")), "responses")
    again = F.col("to").isNotNull() & ~F.col("id").eqNullSafe(F.col("to"))
    # Only payloads that occur more than once have to meet the others; the rest stays where it is.
    rows, single = parted(rows.withColumn("key", F.xxhash64("digest", "size")), "key", heads.select(F.xxhash64("digest", "size")))
    found = rows.join(heads, ["digest", "size"], "left")
    nothing = {c: F.lit(None).cast(heads.schema[c].dataType) for c in ("to", "to_url")}
    return found.unionByName(single.withColumns(nothing)).select(
        "id", "url", "payload", "digest", "size", F.when(again, "revisit").otherwise("response").alias("type"),
        F.when(again, F.col("to")).alias("refers_to"), F.when(again, F.col("to_url")).alias("refers_url"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000,
               date: str = "2024-01-01T00:00:00Z", records_per_file: int = 20_000, bytes_per_file: int = 256 << 20) -> None:
    """Write the archives (gzip) to ``path``; revisit records carry no payload. An archive holds ``records_per_file`` at most, and no
    more than make ``bytes_per_file`` of payload at the pages' mean size."""
    sizes = pages.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(payload_col).cast("string"))).alias("bytes")).first()
    records_per_file = max(1, min(records_per_file, bytes_per_file * sizes["n"] // max(sizes["bytes"] or 0, 1)))
    rows = resolve_revisits(pages, id_col, url_col, payload_col, min_bytes)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(_END))
    rows = rows.withColumn("block", F.concat(http, F.when(F.col("type") == "response", F.col("payload")).otherwise("")))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("type")), _line("WARC-Record-ID", _record_id(F.col("id"), F.col("digest"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("type") == "revisit", F.concat(
            _line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("digest"))), _line("WARC-Refers-To-Target-URI", F.col("refers_url")),
            _line("WARC-Profile", F.lit(_PROFILE)), _line("X-Refers-To-Page", F.col("refers_to")))).otherwise(""),
        _line("X-Page", F.col("id")), F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length("block")), F.lit("\r\n"))
    rows.select(F.concat(header, F.col("block")).alias("value")).write.option("lineSep", _END).option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_file).text(path)


def _headers(stream: io.BufferedIOBase) -> dict[str, str] | None:
    """Header lines up to the blank one; None at the end of the archive."""
    out, first = {}, stream.readline()
    if not first:
        return None
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
        out[name.lower()] = value
    return out


def _records(content: bytes) -> Iterator[dict]:
    with gzip.open(io.BytesIO(content)) as stream:
        while (warc := _headers(stream)) is not None:
            block = stream.read(int(warc["content-length"]))
            if stream.read(4) != _END.encode():
                raise ValueError("a record does not end where its header says")
            inner = io.BytesIO(block)
            http, payload = _headers(inner), inner.read()
            kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"payload of page {warc.get('x-page')} does not match its digest")
            yield {"page": warc.get("x-page"), "url": warc.get("warc-target-uri"), "record_type": kind, "payload_digest": digest,
                   "payload_bytes": len(payload) if kind == "response" else int(http["content-length"]), "refers_to": warc.get("x-refers-to-page"),
                   "record_id": warc["warc-record-id"], "payload": payload if kind == "response" else None}


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives below ``path``; ids as strings."""
    schema = "page string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, record_id string"
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]
    if with_payload:
        schema, types, names = schema + ", payload binary", [*types, pa.binary()], [*names, "payload"]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for r in _records(content.as_py()):
                    rows.append(r)
                    held += len(r["payload"] or b"") if with_payload else 0
                    if len(rows) == 4096 or held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    return arrow_map(spark.read.format("binaryFile").load(f"{path}/*.gz").select("content"), run, schema)
