import base64
import hashlib
import os

import pytest
import zstandard

from lectern.llm import warc as A
from lectern.llm.oracle import ORACLE
from lectern.llm.queries import QUERIES, fresh_folder
from oracle_check import compare, connect

PAGES = "page_id bigint, url string, html string, payload string, refers_to string"


def plain(pages, least=0):
    largest = {}
    for page, _, html in pages:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if page is None else page)
    out = []
    for page, _, html in pages:
        data = (html or "").encode()
        refers = largest[html or ""]
        revisit = len(data) >= least and refers != -1 and page != refers
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", refers if revisit else None))
    return sorted(out, key=str)


def frame(spark, pages):
    return spark.createDataFrame([(*p, "x", "y") for p in pages], PAGES)


ODD = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "", "same"), (4, "http://é/", None), (5, "u", ""), (6, "u", "\r\n\r\nWARC/1.1\r\n"),
       (7, "u", "é🙂" * 300_000), (8, "u", "WARC-Type: x"), (9, "u", "only"), (9, "u", "only"), (None, "u", "same"), (None, None, "lone")]


@pytest.mark.parametrize("least", [0, 1, 5])
def test_round_trip(spark, least):
    folder = fresh_folder(spark, "warc")
    index = A.write_bundles(frame(spark, ODD), folder, least, frame_bytes=64, bundle_bytes=200)
    rows = A.read_bundles(index, folder, payloads=True).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    assert got == plain(ODD, least)
    bodies = {p: (h or "").encode() for p, _, h in ODD if p is not None}
    assert all(bytes(r.payload) == bodies[r.page_id] for r in rows if r.record_type == "response" and r.page_id is not None)


def test_one_record_by_its_place(spark):
    folder = fresh_folder(spark, "warc")
    pages = [(i, f"http://a/{i}", f"<p>{i}</p>" * 50) for i in range(200)]
    index = A.write_bundles(frame(spark, pages).coalesce(1), folder, frame_bytes=2000).collect()
    assert len({r.bundle for r in index}) == 1 and len({r.frame for r in index}) > 20
    for r in index[::17]:
        fields, block = A.read_record(f"file://{folder}/{r.bundle}", r.frame, r.offset)
        assert fields["WARC-Record-ID"] == f"<{r.record_id}>" and block.endswith(f"<p>{r.page_id}</p>".encode())
    # any Zstandard reader sees all records and skips the seek table
    with open(f"{folder}/{index[0].bundle}", "rb") as f:
        text = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert text.count(b"WARC/1.1\r\n") == 200


def test_files_of_lost_attempts_are_not_read(spark):
    folder = fresh_folder(spark, "warc")
    pages = frame(spark, ODD)
    A.write_bundles(pages, folder)
    index = A.write_bundles(pages, folder)
    assert A.read_bundles(index, folder).count() == len(ODD)


def test_a_wrong_index_fails(spark):
    folder = fresh_folder(spark, "warc")
    index = A.write_bundles(frame(spark, ODD), folder)
    with pytest.raises(Exception, match="differ"):
        A.read_bundles(index.withColumn("offset", A.F.col("offset") + 1), folder).collect()


def test_empty(spark):
    folder = fresh_folder(spark, "warc")
    index = A.write_bundles(frame(spark, []), folder)
    assert index.count() == 0 and A.read_bundles(index, folder).count() == 0
    assert not os.path.exists(folder) or not [f for f in os.listdir(folder) if f.endswith(".zst")]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    found = QUERIES["op8_warc_seekable"](spark, sf)
    assert sorted(map(tuple, found.collect()), key=str) == plain(pages)
    assert compare(found, connect(sf), ORACLE["op8_warc_seekable"]) is None
