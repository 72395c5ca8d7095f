"""WARC archives with revisit records, and one merged index of their captures.

Writing.  The captures of a task are sorted by URL key, time and id and written
as WARC/1.1 records to gzipped files of bounded length, so every file is a sorted
run.  Of equal payloads of at least ``revisit_bytes`` the capture with the smallest
id is a ``response``; the others are ``revisit`` records that name it and hold no
payload.

Reading.  The files are read back as bytes and parsed by Content-Length, one
record after the other; payload digests of responses are taken from the payload
that was read.

Merging.  The index entries are dealt by ranges of (URL key, time, id), so a hot
URL is split by time.  Each range holds a slice of every run; a loser tree merges
them.  The ranges in order are the global index, numbered by prefix sums.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionscope.llm.common import cut

CRLF = "\r\n"
_INDEX = (
    "page_id long, url_key string, captured string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, file string, offset long, record_bytes long"
)


def url_key(url: Column) -> Column:
    """Host labels reversed, then the rest: ``org,example)/path?query``; empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(text.contains("://"), F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)).otherwise("")


def _one_line(text: Column) -> Column:
    """Header values must not end their line."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "%", "%25"), "\r", "%0D"), "\n", "%0A")


def warc_records(captures: DataFrame) -> DataFrame:
    """One WARC record per capture as text: sort columns and ``record``.

    ``captures``: page_id, url, captured (timestamp), payload, digest, refers_to.
    """
    revisit = F.col("refers_to").isNotNull()
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF * 2))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    key = url_key(F.col("url"))
    date = F.date_format(F.coalesce("captured", F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", urn(F.col("page_id"))),
        field("WARC-Date", date),
        F.when(F.col("url").isNotNull(), field("WARC-Target-URI", _one_line(F.col("url")))).otherwise(F.lit("")),
        field("X-URL-Key", _one_line(key)),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(
            field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            field("WARC-Refers-To", urn(F.col("refers_to"))),
        )).otherwise(F.lit("")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit(CRLF),
        http,
        body,
        F.lit(CRLF),  # the writer's line end is the second one after the block
    )
    return captures.select(key.alias("url_key"), date.alias("captured"), "page_id", record.alias("record"))


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    captured: Column | None = None,
    revisit_bytes: int = 100,
    captures_per_file: int = 5000,
) -> None:
    """Write every row as a WARC record below ``folder``.

    ``captured`` is the time of capture; without it, that many seconds after
    2024-01-01 as the id says.

    Defined cases: a null payload is empty; a null url has no target and an empty
    key; a null id is never the one revisited, unless all ids of the payload are
    null, and then each is a response; rows that repeat the smallest id of a
    payload are all responses; a null time of capture is 1970-01-01; an empty table
    writes no record; other columns are not read.
    """
    page = F.col(id_col).cast("long")
    time = captured if captured is not None else F.timestamp_seconds(F.lit(1704067200) + F.coalesce(page, F.lit(0)))
    rows = pages.select(
        page.alias("page_id"), F.col(url_col).cast("string").alias("url"), time.alias("captured"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload")
    )
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long_enough = F.octet_length("payload") >= revisit_bytes
    # only payloads that repeat are looked up; written first, so their size is known to the planner
    repeated = cut(
        rows.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("again"), "first"),
        "repeated",
    )
    captures = rows.join(repeated, (F.col("digest") == F.col("again")) & long_enough, "left").withColumn(
        "refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    )
    (
        warc_records(captures)
        .sortWithinPartitions("url_key", "captured", "page_id")
        .select("record")
        .write.option("lineSep", CRLF)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", captures_per_file)
        .text(folder)
    )


class _Stream:
    """Bytes of a gzip file, inflated as far as asked for."""

    def __init__(self, content: bytes):
        self._rest, self._inflate = content, zlib.decompressobj(31)
        self._held, self._at, self.offset = b"", 0, 0

    def _more(self) -> bool:
        if self._inflate.eof:
            self._rest, self._inflate = self._inflate.unused_data + self._rest, zlib.decompressobj(31)
        if not self._rest:
            return False
        self._held = self._held[self._at :] + self._inflate.decompress(self._rest, 1 << 20)
        self._at, self._rest = 0, self._inflate.unconsumed_tail
        return True

    def line(self) -> bytes | None:
        while (end := self._held.find(b"\r\n", self._at)) < 0:
            if not self._more():
                return None
        found = self._held[self._at : end]
        self.offset += end + 2 - self._at
        self._at = end + 2
        return found

    def take(self, size: int) -> bytes:
        while len(self._held) - self._at < size:
            if not self._more():
                raise EOFError("the archive ends within a record")
        found = self._held[self._at : self._at + size]
        self._at += size
        self.offset += size
        return found


def parse_archive(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of every record of a gzipped WARC file."""
    stream = _Stream(content)
    while True:
        start = stream.offset
        version = stream.line()
        if version is None:
            return
        if not version.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at {start}")
        headers: dict[str, str] = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8").partition(": ")
            headers[name] = value
        block = stream.take(int(headers["Content-Length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"the record at {start} does not end")
        yield start, stream.offset - start, headers, block


def _page(urn: str | None) -> int | None:
    number = (urn or "")[len("<urn:page:") : -1]
    return int(number) if number else None


def _entry(file: str, start: int, size: int, headers: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    full = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    response = headers["WARC-Type"] == "response"
    digest = hashlib.sha256(payload).hexdigest() if response else headers["WARC-Payload-Digest"][len("sha256:") :]
    key = headers["X-URL-Key"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return (
        _page(headers["WARC-Record-ID"]), key, headers["WARC-Date"], len(payload) if response else full, digest,
        headers["WARC-Type"], _page(headers.get("WARC-Refers-To")), file, start, size,
    )


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "offset": pa.int64(), "record_bytes": pa.int64(), "part": pa.int64(), "nth": pa.int64()}
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names=names)


_NAMES = [x.split()[0] for x in _INDEX.split(", ")]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The index entries of all records below ``folder``, file by file."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for record in parse_archive(content.as_py()):
                    rows.append(_entry(path.as_py(), *record))
                    if len(rows) == 10_000:
                        yield _batch(rows, _NAMES)
                        rows = []
                yield _batch(rows, _NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(parse, _INDEX)


class LoserTree:
    """k-way merge of sorted runs: a tree of losers, so each item costs log2(k) comparisons."""

    def __init__(self, sorted_runs: list[list], key: Callable):
        self._runs = [iter(r) for r in sorted_runs]
        self._key = key
        k = max(1, len(self._runs))
        self._heads: list = [None] * k
        for i, run in enumerate(self._runs):
            self._heads[i] = self._next(run)
        self._losers = [-1] * k
        for leaf in range(k):
            self._play(leaf, building=True)

    def _next(self, run: Iterator):
        item = next(run, None)
        return None if item is None else (self._key(item), item)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; an empty run goes last."""
        if self._heads[a] is None or self._heads[b] is None:
            return self._heads[b] is None and (self._heads[a] is not None or a < b)
        x, y = self._heads[a][0], self._heads[b][0]
        return x < y or (x == y and a < b)

    def _play(self, winner: int, building: bool = False) -> None:
        """Send a leaf up the tree; losers stay, the overall winner ends at place 0."""
        node = (winner + len(self._heads)) // 2
        while node > 0:
            held = self._losers[node]
            if building and held < 0:
                self._losers[node] = winner
                return
            if self._beats(held, winner):
                self._losers[node], winner = winner, held
            node //= 2
        self._losers[0] = winner

    def __iter__(self) -> Iterator:
        while (head := self._heads[self._losers[0]]) is not None:
            yield head[1]
            first = self._losers[0]
            self._heads[first] = self._next(self._runs[first])
            self._play(first)


def merged_index(index: DataFrame) -> DataFrame:
    """The entries in global order of (URL key, time, id), with their ``position`` from 0."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        sorted_runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in _NAMES), strict=True):
                sorted_runs.setdefault(row[7], []).append(row)
        # null ids go first, as Spark orders them
        key = lambda r: (r[1].encode(), r[2], r[0] is not None, r[0] or 0, r[7], r[8])
        rows: list[tuple] = []
        nth = 0
        for row in LoserTree(list(sorted_runs.values()), key):
            rows.append((*row, part, nth))
            nth += 1
            if len(rows) == 10_000:
                yield _batch(rows, [*_NAMES, "part", "nth"])
                rows = []
        yield _batch(rows, [*_NAMES, "part", "nth"])

    index = cut(index, "runs")
    ranged = index.repartitionByRange("url_key", "captured", "page_id")
    # within its range a run keeps the order it was written in
    ranged = ranged.sortWithinPartitions("file", "offset")
    merged = cut(ranged.mapInArrow(merge, f"{_INDEX}, part long, nth long"), "merged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    bases = merged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return merged.join(bases, "part").withColumn("position", F.col("base") + F.col("nth")).drop("part", "nth", "base")
