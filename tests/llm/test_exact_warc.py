import hashlib

from pyspark.sql import functions as F

from gridfire.llm import exact, warc


def docs(spark, rows, schema="doc_id long, text string, lang string, keep_id string"):
    return spark.createDataFrame(rows, schema)


ROWS = [(3, "a b", "x", "k"), (1, "a b", None, None), (2, "a  b", "y", "k"), (4, None, "z", "k"), (5, "", "z", "k"), (6, "é" * 50_000, "z", None), (1, "a b", None, None), (None, "a b", "q", "k")]


def test_exact_dedup_cases(spark):
    out = exact.exact_dedup(docs(spark, ROWS), keep="largest")
    assert out.columns == ["doc_id", "text", "lang", "keep_id", "_keep_id", "group_size", "kept", "text_sha256"]
    got = sorted(((r.doc_id, r._keep_id, r.group_size, r.kept) for r in out.collect()), key=str)
    assert got == sorted([(3, 3, 4, True), (1, 3, 4, False), (1, 3, 4, False), (None, 3, 4, False), (2, 2, 1, True), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True)], key=str)
    assert {r.text_sha256 for r in out.where("doc_id = 4").collect()} == {hashlib.sha256(b"").hexdigest()}


def test_exact_dedup_compares_bytes_when_hashes_collide(spark):
    out = exact.exact_dedup(docs(spark, ROWS), digest=lambda t: F.lit(b"x"))
    assert {(r.doc_id, r._keep_id) for r in out.where("doc_id is not null").collect()} == {(3, 1), (1, 1), (2, 2), (4, 4), (5, 4), (6, 6)}


def test_drop_copies(spark):
    out = exact.drop_copies(docs(spark, ROWS))
    assert out.columns == ["doc_id", "text", "lang", "keep_id"]
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(1, "a b"), (2, "a  b"), (4, None), (6, "é" * 50_000)])
    assert sorted(r.doc_id for r in exact.drop_copies(docs(spark, ROWS), keep="largest").collect()) == [2, 3, 5, 6]
    assert exact.drop_copies(docs(spark, [])).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, status string")


def test_round_trip(spark):
    big, long = "<p>é</p>" * 9000, "x" * 200
    rows = [(1, "http://a/ b\r\n", long, "s"), (2, None, long, None), (3, "u", "short", "s"), (4, "u", "short", "s"), (5, "u", None, "s"), (6, "u", big, "s"), (7, "u", big, "s"), (8, "u", "WARC/1.1\r\n\r\n\r\n0\r\n\r\n", "s"), (9, "u", big + "!", "s"), (None, "u", "y" * 300, "s"), (6, "u", big, "s")]
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.status) for r in warc.round_trip(pages(spark, rows), segment_bytes=5000, chunk_bytes=777).collect()), key=str)
    refers = {2: 1, 7: 6}
    want = [(i, len(b := (t or "").encode()), hashlib.sha256(b).hexdigest(), "revisit" if i in refers else "response", refers.get(i), "ok") for i, _, t, _ in rows]
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_ids_that_are_empty_or_null(spark):
    """Text ids: an empty one is the smallest and stays empty; equal payloads without an id are all responses."""
    long, other = "x" * 200, "y" * 200
    rows = [("", "u", long), ("a:b>c=", "u", long), (None, "u", long), ("=", "u", "z" * 150), (None, "u", other), (None, "u", other)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string"))
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got.collect()), key=str) == sorted(
        [("", "response", None, 200), ("a:b>c=", "revisit", "", 200), (None, "revisit", "", 200), ("=", "response", None, 150), (None, "response", None, 200), (None, "response", None, 200)], key=str
    )


def test_names_of_the_join_may_be_taken(spark):
    taken = spark.createDataFrame([(1, "t", "a", "b", 3, 4), (2, "t", "c", "d", 5, 6)], "doc_id long, text string, class_h string, class_sha string, class_keep int, class_n int")
    got = exact.exact_dedup(taken)
    assert sorted((r.doc_id, r.class_h, r.class_n, r.keep_id, r.group_size) for r in got.collect()) == [(1, "a", 4, 1, 2), (2, "c", 6, 1, 2)]


def test_reassembly_reports_faults():
    assert warc.join_segments([(2, b"b", 2), (1, b"a", None), (2, b"b", 2)]) == (b"ab", "ok")
    for parts in ([(1, b"a", None), (3, b"c", 2)], [(1, b"a", None), (2, b"b", None)], [(1, b"a", None), (2, b"b", 3)], [(1, b"a", 1), (1, b"b", 1)]):
        assert warc.join_segments(parts)[0] is None
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert warc.http_body(head + b"3;x=1\r\nabc\r\n0\r\n\r\n") == (b"abc", "ok")
    assert warc.http_body(head + b"4\r\nabc\r\n0\r\n\r\n")[0] is None
    assert warc.http_body(head + b"zz\r\nabc")[0] is None
    assert warc.http_body(b"HTTP/1.1 200 OK\r\n\r\nabc") == (b"abc", "ok")
    assert warc.http_body(b"HTTP/1.1 200 OK")[0] is None
