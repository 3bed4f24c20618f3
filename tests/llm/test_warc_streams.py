import gzip
import io
import random

from pyspark.sql import functions as F

from gridfire.llm import warc


def record(rid, kind, block, **head):
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", *(f"{k.replace('_', '-')}: {v}" for k, v in head.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def bodies(n, seed):
    """Payloads rich in line ends, so that the separator of pieces is everywhere in them, whole and in part."""
    rng = random.Random(seed)
    return [b"".join(rng.choice([b"\r", b"\n", b"\r\n", b"\r\n\r\n", b"a", b"\xff\x00", b"WARC/1.1\r\n"]) for _ in range(rng.randrange(400))) for _ in range(n)]


def payloads(spark, folder):
    return {r.record_id: (None if r.payload is None else bytes(r.payload), r.status) for r in warc.reassemble(spark, f"file://{folder}").collect()}


def test_pieces_give_the_stream_back():
    for text in (b"a\r\n\r\nb\r\n\r\n", b"\r\n\r\n\r\n\r\n", b""):
        assert io.BufferedReader(warc.Pieces(text.split(b"\r\n\r\n")[:-1])).read() == text


def test_archives_of_all_kinds(spark, tmp_path):
    """One gzip stream, a member for each record, a plain archive, and one whose last line ends are missing."""
    want, http = {}, b"HTTP/1.1 200 OK\r\n\r\n"
    archives = []
    for k in range(4):
        texts = bodies(60, k)
        want |= {f"<{k}-{i}>": (t, "ok") for i, t in enumerate(texts)}
        archives.append([record(f"{k}-{i}", "response", http + t) for i, t in enumerate(texts)])
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/one.warc.gz").write_bytes(gzip.compress(b"".join(archives[0])))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in archives[1]))
    (tmp_path / "plain.warc").write_bytes(b"".join(archives[2]))
    (tmp_path / "ends.warc.gz").write_bytes(gzip.compress(b"".join(archives[3])[:-4]))
    assert payloads(spark, tmp_path) == want


def test_segments_lie_in_different_archives_and_in_any_order(spark, tmp_path):
    http, text = b"HTTP/1.1 200 OK\r\n\r\n", b"0123456789" * 50
    block = http + text
    parts = [block[:100], block[100:300], block[300:]]
    rows = [record("o", "response", parts[0], WARC_Segment_Number=1)]
    rows += [record(f"o{k}", "continuation", p, WARC_Segment_Number=k, WARC_Segment_Origin_ID="<o>", **({"WARC_Segment_Total_Length": len(block)} if k == 3 else {})) for k, p in enumerate(parts[1:], 2)]
    for k, r in enumerate(reversed(rows)):
        (tmp_path / f"{k}.gz").write_bytes(gzip.compress(r))
    (tmp_path / "lost.gz").write_bytes(gzip.compress(record("p2", "continuation", b"x", WARC_Segment_Number=2, WARC_Segment_Origin_ID="<p>")))
    assert payloads(spark, tmp_path) == {"<o>": (text, "ok"), "<p>": (None, "a segment is missing")}


def test_a_payload_that_is_not_the_declared_one(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    rows = [record("a", "response", http + b"abc", WARC_Payload_Digest="sha256:" + "0" * 64), record("b", "response", http + b"abc", WARC_Payload_Digest="sha1:XYZ"), record("c", "warcinfo", b"about")]
    (tmp_path / "x.gz").write_bytes(gzip.compress(b"".join(rows)))
    assert payloads(spark, tmp_path) == {"<a>": (None, "the payload's digest isn't the declared one"), "<b>": (b"abc", "ok")}


def test_revisits_name_their_response(spark, tmp_path):
    """A response that is one row is named; where its row is repeated, no copy is; ids stay unique."""
    rows = [(3, "u", "x" * 200), (2, "v", "x" * 200), (9, "w", "x" * 200), (5, "u", "y" * 200), (5, "u", "y" * 200), (6, "u", "y" * 200), (7, "u", "z" * 200), (8, "u", "short"), (10, "u", "short")]
    path = f"file://{tmp_path}/out"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc.read_records(spark, path).withColumn("page", warc.page_id_of("record_id")).collect()
    ids = {r.record_id for r in got}
    assert len(ids) == len(rows)
    by_page = {r.page: r for r in got}
    assert {p: r.refers_to for p, r in by_page.items() if r.warc_type == "revisit"} == {"3": by_page["2"].record_id, "9": by_page["2"].record_id, "6": None}
    assert sorted(r.page for r in got if r.warc_type == "response") == sorted(["2", "5", "5", "7", "8", "10"])


def test_archives_are_read_once_and_by_pieces(spark, tmp_path):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.concat(F.lit("<p>"), F.col("id")), 50).alias("html"))
    path = f"file://{tmp_path}/out"
    warc.write_warc(pages.coalesce(1), path)
    plan = warc.read_records(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert warc.read_records(spark, path).where("status = 'ok'").count() == 300
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
