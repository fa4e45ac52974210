import gzip
import io

import pytest
from pyspark.sql import functions as F

from learnmart.llm import warc as W
from learnmart.llm.common import folder_for

PAGES = "page_id long, url string, html string"


def test_sql(against_sql):
    against_sql("op7_warc")


def test_odd_rows(spark):
    rows = [(1, "http://a/\r\nX: y é", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "v", "<p>é</p>"), (5, "w", "z" * 3_000_000),
            (6, "w", "z" * 3_000_000), (1, "again", "<p>é</p>"), (7, "x", "WARC/1.1\r\n\r\n\r\n"), (None, "only", "alone")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit(1)).withColumn("refers_to", F.lit(1))
    archives = W.write(pages, folder_for(spark, "warc"), archive_bytes=1)
    assert archives.agg(F.sum("records")).first()[0] == len(rows) == archives.count()
    got = sorted(map(tuple, W.read_archives(archives, ["page_id", "html", "payload_bytes", "record_type", "refers_to"]).collect()), key=repr)
    want = [(1, "<p>é</p>", 9, "response", None), (1, "<p>é</p>", 9, "response", None), (2, None, 9, "revisit", 1), (None, None, 9, "revisit", 1),
            (3, "", 0, "response", None), (4, None, 0, "revisit", 3), (5, "z" * 3_000_000, 3_000_000, "response", None), (6, None, 3_000_000, "revisit", 5),
            (7, "WARC/1.1\r\n\r\n\r\n", 14, "response", None), (None, "alone", 5, "response", None)]
    assert got == sorted(want, key=repr)
    assert W.write(pages.limit(0), folder_for(spark, "warc")).count() == 0


def test_smaller_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "xyz"), (4, "a", "xyz")], PAGES)
    got = W.read_archives(W.write(pages, folder_for(spark, "warc"), least_bytes=3)).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_members_are_gzip_and_records_are_whole():
    data = W.record(1, "http://a", b"one", None, False) + W.record(2, "http://b", b"one", 1, True)
    assert gzip.decompress(data).count(b"WARC/1.1") == 2  # any gzip reader takes the members together
    found = list(W.read_records(io.BytesIO(data)))
    assert [W.page_of(r)[0] for r in found] == [1, 2] and found[1].block.endswith(b"Content-Length: 3\r\n\r\n")


@pytest.mark.parametrize("harm", [
    lambda d: d[:-5], lambda d: d[:40] + bytes([d[40] ^ 1]) + d[41:], lambda d: d + b"junk",
    lambda d: gzip.compress(gzip.decompress(d).replace(b"page text", b"page tuxt")),
    lambda d: gzip.compress(gzip.decompress(d) + b"x"), lambda d: gzip.compress(gzip.decompress(d).replace(b"Content-Length: 9", b"Content-Length: 8")),
])
def test_damage_is_found(harm):
    data = W.record(1, "http://a", b"page text", None, False)
    with pytest.raises((W.DamagedArchive, KeyError)):
        [W.page_of(r) for r in W.read_records(io.BytesIO(harm(data)))]
