import gzip
import hashlib
import io

from tripwire.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, `type` int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_round_trip_and_revisits(spark, tmp_dir):
    big, other, tricky = "é" * 600, "b" * 1000, "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 40
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other),
            (8, "u", other), (9, "u", tricky), (10, "u", tricky), (None, "u", other), (None, "n", "c" * 2000), (None, "n", "c" * 2000)]
    path = f"{tmp_dir}/warc"
    warc.write_warc(pages(spark, rows), path)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r["page"], []).append(r)
    top = {big: 3, other: 8, tricky: 10}
    for i, _, html in rows:
        data = (html or "").encode()
        for r in [r for r in of[None if i is None else str(i)] if r["payload_digest"] == hashlib.sha1(data).hexdigest()]:
            assert r["payload_bytes"] == len(data)
            again = html in top and top[html] != i
            assert (r["record_type"], r["refers_to"]) == (("revisit", str(top[html])) if again else ("response", None))
            assert r["payload"] == (None if again else data)
    assert [r["record_type"] for r in of["8"]] == ["response"] * 2
    assert of["2"][0]["url"] == "http://b/%0D%0AX: y" and of["3"][0]["url"] is None
    ids = {r["record_id"] for r in got}
    assert len(ids) == len({(i, h or "") for i, _, h in rows})


def test_archive_is_plain_warc(spark, tmp_dir):
    path = f"{tmp_dir}/one"
    warc.write_warc(pages(spark, [(1, "http://a/", "x" * 1000), (2, "http://a/2", "x" * 1000)]).coalesce(1), path)
    files = [r["path"] for r in spark.read.format("binaryFile").load(f"{path}/*.gz").select("path").collect()]
    raw = b"".join(gzip.open(f.removeprefix("file:")).read() for f in files)
    assert raw.count(b"WARC/1.1\r\n") == 2 and raw.endswith(b"\r\n\r\n")
    assert raw.count(b"WARC-Type: revisit\r\n") == 1 and b"WARC-Refers-To: <urn:uuid:" in raw
    stream = io.BytesIO(raw)
    while (head := warc._headers(stream)) is not None:
        stream.seek(int(head["content-length"]) + 4, 1)
    assert stream.tell() == len(raw)


def test_empty_table(spark, tmp_dir):
    warc.write_warc(pages(spark, []).limit(0), f"{tmp_dir}/none")
    assert warc.read_warc(spark, f"{tmp_dir}/none").count() == 0


def test_large_pages_and_a_payload_of_a_third(spark, tmp_dir):
    """Archives are bounded by bytes, and the most repeated payload is stored once."""
    hot = "h" * 50_000
    rows = [(k, "u", hot if k % 3 == 0 else f"{k} " * 100_000) for k in range(24)]
    path = f"{tmp_dir}/large"
    warc.write_warc(pages(spark, rows).coalesce(1), path, bytes_per_file=1 << 20)
    files = spark.read.format("binaryFile").load(f"{path}/*.gz").select("path").collect()
    assert max(len(gzip.open(f["path"].removeprefix("file:")).read()) for f in files) < 2 << 20
    got = {int(r["page"]): r for r in warc.read_warc(spark, path).collect()}
    assert {i: r["payload_digest"] for i, r in got.items()} == {i: hashlib.sha1(h.encode()).hexdigest() for i, _, h in rows}
    assert sum(r["payload"] is not None for r in got.values()) == 17 and all(got[k]["refers_to"] == "21" for k in range(0, 21, 3))
