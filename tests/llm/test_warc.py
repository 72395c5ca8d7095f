"""Archives read back, revisits and the merged index."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sessionscope.llm import warc_index
from sessionscope.llm.common import shared_dir

LONG = "<p>" + "payload \r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n " * 20
ROWS = [
    (5, "http://a.example.org/x?y#z", LONG),
    (3, "http://A.Example.org/x?y#z", LONG),
    (9, "http://b.example.org", LONG),
    (3, "http://A.Example.org/x?y#z", LONG),  # a repeated row
    (None, "http://c.org/%0A", LONG),
    (1, None, "short"),
    (2, "no scheme", "short"),
    (4, "http://line\r\nbreak.org/\n", None),
    (6, "https://é.example/ü 中", "é" * 60),
    (7, "https://é.example/ü 中", "é" * 60),
    (8, "http://big.org/", "x" * 3_000_000),
]


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for clash in ("digest", "payload", "captured", "file", "part", "first"):
        df = df.withColumn(clash, F.lit("clash"))
    return df


def key(url):
    url = url or ""
    if "://" not in url:
        return ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] or [len(rest)])
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def brute(rows):
    out = []
    for page, url, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        first = min(same) if len(payload) >= 100 and same else page
        seen = sum((h or "").encode() == payload for _, _, h in rows) > 1
        refers = first if seen and first != page else None
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if refers is not None else "response", refers, key(url)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("per_file", [2, 5000])
def test_round_trip_and_order(spark, per_file):
    folder = shared_dir(spark, "test-warc")
    warc_index.write_archives(pages(spark, ROWS).repartition(3), folder, captures_per_file=per_file)
    got = warc_index.merged_index(warc_index.read_archives(spark, folder)).collect()
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key")
    assert sorted((tuple(r[f] for f in fields) for r in got), key=repr) == brute(ROWS)
    got.sort(key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(ROWS)))
    order = [(r.url_key.encode(), r.captured, r.page_id is not None, r.page_id or 0) for r in got]
    assert order == sorted(order)


def test_offsets_find_the_record(spark):
    folder = shared_dir(spark, "test-warc")
    warc_index.write_archives(pages(spark, ROWS), folder)
    row = next(r for r in warc_index.read_archives(spark, folder).collect() if r.page_id == 6)
    with gzip.open(row.file.removeprefix("file:")) as f:
        raw = f.read()[row.offset : row.offset + row.record_bytes]
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:6>\r\n")
    assert raw.endswith("é".encode() * 60 + b"\r\n\r\n")


def test_empty_table(spark):
    folder = shared_dir(spark, "test-warc")
    warc_index.write_archives(pages(spark, []), folder)
    assert warc_index.merged_index(warc_index.read_archives(spark, folder)).count() == 0


def test_loser_tree():
    r = random.Random(8)
    for k in range(12):
        runs = [sorted((r.randrange(9), i) for _ in range(r.randrange(7))) for i in range(k)]
        got = list(warc_index.LoserTree(runs, key=lambda x: x[0]))
        assert got == sorted((x for run in runs for x in run))


def test_a_broken_archive_is_an_error():
    with pytest.raises(ValueError):
        list(warc_index.parse_archive(gzip.compress(b"nothing\r\n")))
    with pytest.raises(EOFError):
        list(warc_index.parse_archive(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))
