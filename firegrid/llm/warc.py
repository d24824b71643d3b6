"""WARC archives of page captures, and one capture index merged from sorted runs.

Writing: records are text lines ended by the blank lines that WARC puts after a record, so Spark's
writer makes standard archives on any file system, compressed as a whole by its codec. Equal payloads of some length are
stored once; the others are revisit records that name it.

Reading: archives are opened whole, which is why they are written with a bounded size, and split by
their ``Content-Length``. Each archive gives a run of index entries sorted by (URL key, time). Entries
are dealt to ranges of the key, and each range is merged from its runs by a loser tree; ranges in
order are the capture history of all archives. A hot URL is cut by time and id into several ranges.

Nulls: a null html is an empty payload; a null url gives an empty URL key and no target field; a null
id never is the record that others refer to, unless all ids of the payload are null, when none refers.
Empty pages are responses. Of repeated rows with the largest id all are responses. An empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fields

ARCHIVE_BYTES = 8 * 1024 * 1024
REVISIT_BYTES = 1000
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"

RECORD = fields(
    ("page_id", "long"), ("url", "string"), ("captured", "string"), ("record_type", "string"),
    ("refers_to", "long"), ("payload_bytes", "long"), ("payload_digest", "string"),
    ("archive", "string"), ("position", "long"), ("stored_bytes", "long"),
)


def deduplicated(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Add digest, payload size and the id that a revisit refers to.

    Groups are counted on digests alone; only payloads with several rows enter the join, so its
    right side is small, and adaptive execution splits a hot payload on the left.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", body.alias("body"),
        F.octet_length(body).cast("long").alias("bytes"), F.sha1(body).alias("digest"), F.sha2(body, 256).alias("same"),
    )
    groups = (
        rows.where(F.col("bytes") >= min_bytes).groupBy("same")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    refers = F.when(F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    return rows.join(groups, "same", "left").withColumn("refers_to", refers).drop("same", "kept")


def record_lines(rows: DataFrame) -> DataFrame:
    """One WARC record a row, without the blank lines at its end."""
    eol = F.lit("\r\n")
    clean = F.regexp_replace("url", "[\\r\\n]", "")
    revisit = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"), F.lit(_END),
    )
    block = F.concat(http.cast("binary"), F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("body")))
    # Pages have no capture time of their own: one second per id from a fixed start.
    time = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce("page_id", F.lit(0)) % 100_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")), F.lit("\r\nWARC-Date: "), time,
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), clean), F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col("refers_to")), eol, F.lit(f"WARC-Profile: {_REVISIT_PROFILE}"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END),
    )
    return rows.select(F.concat(header.cast("binary"), block).cast("string").alias("value"))


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, compression: str = "gzip"
) -> None:
    """Write one record per page. Archives are the partitions of the join that finds copies, cut after as many
    records as take ``archive_bytes`` on average; pages are not shuffled again."""
    size = F.octet_length("html").cast("long") + 600
    mean = pages.select(F.avg(F.coalesce(size, F.lit(600))).alias("b")).first()["b"] or 600
    lines = record_lines(deduplicated(pages, min_bytes))
    most = max(1, int(archive_bytes / mean))
    lines.write.option("lineSep", _END).option("maxRecordsPerFile", most).option("compression", compression).text(path)


def parse_archive(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position, header fields, block) of each record of an archive."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {}
        for line in lines[1:]:
            key, _, value = line.partition(":")
            head[key.strip().lower()] = value.strip()
        block_at = head_end + 4
        end = block_at + int(head["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut")
        yield at, head, data[block_at:end]
        at = end + 4


def _page(name: str | None) -> int | None:
    value = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return None if value in ("", "null") else int(value)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives; a ``position`` counts bytes before compression. Digest and size of a response are taken from its payload, and a
    payload that differs from its header ends the job; a revisit has them in its headers."""

    def records(batches: Iterator) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"]):
                rows = []
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                for at, head, block in parse_archive(data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, size = head["warc-payload-digest"].removeprefix("sha1:"), len(payload)
                    if head["warc-type"] == "revisit":
                        size = int(http.rpartition(b"Content-Length:")[2])
                    elif hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
                    rows.append((
                        _page(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-date"], head["warc-type"],
                        _page(head.get("warc-refers-to")), size, digest, file, at, len(block),
                    ))
                frame = pd.DataFrame(rows, columns=RECORD.names)
                for name in ("page_id", "refers_to"):
                    frame[name] = frame[name].astype("Int64")
                yield frame

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInPandas(records, RECORD)


def url_key(url):
    """Sort-friendly key: reversed host labels, then path and query in lower case, no fragment."""
    plain = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://|#.*$", ""))
    host = F.regexp_extract(plain, "^([^/?:]*)", 1)
    return F.concat(
        F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.regexp_replace(plain, "^[^/?]*", "")
    )


class LoserTree:
    """Merge sorted runs: each inner node remembers the loser, one path is replayed per row."""

    def __init__(self, runs: Sequence[Sequence[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.losers = [-1] * self.k
        for leaf in range(self.k - 1, -1, -1):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        """Whether run ``a`` wins; -1 stands for a run not entered yet, which wins always."""
        if a == -1 or b == -1:
            return a == -1
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None
        return (x, a) < (y, b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            if self._before(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (row := self.heads[run := self.losers[0]]) is not None:
            yield row
            self.heads[run] = next(self.runs[run], None)
            self._replay(run)


def capture_history(records: DataFrame, range_rows: int = 100_000) -> DataFrame:
    """Records in one order of (URL key, time, id): ``history_range`` and ``history_place`` number it.

    A run is what one archive gives to a range, in the order of the key.
    """
    key = ["url_key", "captured", "_id"]
    rows = records.withColumn("url_key", url_key(F.col("url"))).withColumn("_id", F.coalesce("page_id", F.lit(-(2**63))))
    ranges = max(1, -(-records.count() // range_rows))
    dealt = rows.repartitionByRange(ranges, *key, "archive", "position").sortWithinPartitions("archive", *key, "position")
    names = [*RECORD.names, "url_key"]
    schema = fields(*[(f.name, f.dataType) for f in RECORD], ("url_key", "string"), ("history_range", "int"), ("history_place", "long"))

    def merged(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        columns = [table.column(c).to_pylist() for c in ("url_key", "captured", "_id", "archive", "position")]
        runs: dict[str, list] = {}
        for row in zip(*columns, range(table.num_rows)):
            runs.setdefault(row[3], []).append(row)
        order = pa.array([row[-1] for row in LoserTree(list(runs.values()))], pa.int64())
        out = table.select(names).take(order)
        n = out.num_rows
        out = out.append_column("history_range", pa.array([TaskContext.get().partitionId()] * n, pa.int32()))
        yield from out.append_column("history_place", pa.array(range(n), pa.int64())).combine_chunks().to_batches()

    return dealt.mapInArrow(merged, schema)


def archive_pages(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as archives, read them back and merge their index."""
    scratch = Scratch(pages.sparkSession)
    path = path or scratch.path("warc")
    write_archives(pages, path, **options)
    records = scratch.store(read_archives(pages.sparkSession, path), "records")
    return capture_history(records)
