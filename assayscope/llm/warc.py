"""WARC archives of captures, and their index in global order.

Writing: one WARC/1.1 record per page. Equal payloads of MIN_REVISIT bytes or more are stored once: the
page of smallest id is the response, the others revisit it. Records are text (the payload is UTF-8), so
Spark's text writer, with the records' blank lines as line separator, makes the archive files.

Reading: every archive file is parsed record by record by its Content-Length.

Index: external merge. Each archive gives a locally sorted run of (url key, timestamp, page) entries.
Range partitioning hands each merge task one interval of the key order, with a slice of every run; a
loser tree merges the slices. The key order includes timestamp and page, so a url key that holds a third
of all captures is cut over many tasks. Positions in the whole order come from the partitions' counts.

Null html is an empty payload; null urls have an empty url key and sort first; pages that share an id
and payload are separate records.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayscope.llm.common import Scratch, small

MIN_REVISIT = 100
#: Records per archive file, at most; fewer where the largest payload is long, so that a file, which is read as
#: one value, stays below FILE_BYTES (or holds one record).
RECORDS_PER_FILE = 2_000
FILE_BYTES = 1 << 28
#: Captures that one merge task handles on average, at most.
MERGE_ROWS = 250_000
#: First capture time; a page is captured page_id seconds later, at the first or the last second that a date
#: can tell if that is outside of them. Captures of one time are in the order of their pages.
EPOCH, LAST = 1_577_836_800, 253_402_300_799
#: Where records without a page id are put.
NO_PAGE = -(1 << 63)

_RECORD = re.compile(rb"WARC/1\.1\r\n(.*?)\r\n\r\n", re.S)


def payload_roles(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """pages with payload, payload_bytes, payload_digest, record_type and refers_to. Payloads are only shuffled
    where the digests that recur are too many to be broadcast."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    p = pages.withColumn("payload", payload)
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    first = p.where((F.col("payload_bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull())
    # only digests that occur again matter
    first = first.groupBy("payload_digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).where("n > 1").drop("n")
    p = p.join(small(scratch, first, "repeated"), "payload_digest", "left")
    revisit = F.coalesce(F.col("page_id") > F.col("first_page"), F.lit(False))
    return p.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first_page"))}).drop("first_page")


def _header(value: Column) -> Column:
    """Header values lie on one line."""
    return F.translate(F.coalesce(value.cast("string"), F.lit("")), "\r\n", "  ")


def _utc(seconds: Column) -> Column:
    """ISO time of seconds from 1970 on, whatever the session's time zone is."""
    of_day = seconds % 86_400
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int")), "yyyy-MM-dd")
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(date, F.lit("T"), two(of_day / 3600), F.lit(":"), two(of_day % 3600 / 60), F.lit(":"), two(of_day % 60), F.lit("Z"))


def records(roles: DataFrame) -> DataFrame:
    """value: the text of each record, without the two line ends that close it."""
    stored = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload"))
    seconds = F.least(F.greatest(F.coalesce("page_id", F.lit(0)), F.lit(0)), F.lit(LAST - EPOCH)) + F.lit(EPOCH)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), _header(F.col("page_id")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), _header(F.col("url"))),
        F.concat(F.lit("WARC-Date: "), _utc(seconds)),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(stored).cast("string")),
    ]
    return roles.select(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), stored).alias("value"))


def write_archives(pages: DataFrame, path: str, scratch: Scratch) -> None:
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    a_file = max(1, min(RECORDS_PER_FILE, FILE_BYTES // (largest + 1_000)))
    writer = records(payload_roles(pages, scratch)).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", a_file)
    writer.text(path)


def parse(data: bytes):
    """(offset, headers, payload) of each record. Raises where bytes are left that are no record, or a record is cut
    short: what follows a damaged one is not lost silently."""
    at = 0
    while m := _RECORD.match(data, at):
        head = {}
        for line in m[1].decode().split("\r\n"):
            name, _, value = line.partition(": ")
            head[name] = value
        end = m.end() + int(head["Content-Length"])
        yield at, head, data[m.end() : end]
        at = end + 4
    if at != len(data):
        raise ValueError(f"the archive is damaged at byte {min(at, len(data))} of {len(data)}")


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, then the rest."""
    _, _, rest = url.partition("://")
    m = re.match(r"([^/?#]*)(.*)", rest, re.S)
    return ",".join(reversed(m[1].lower().split("."))) + ")" + m[2] if rest else ""


_PARSED = "archive string, offset long, page_id long, url_key string, captured string, record_type string, refers_to long, payload_digest string, payload_bytes long, intact boolean"


def _page(urn: str | None):
    digits = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(digits[1]) if digits else None


def _read(batches):
    """One run for each archive, sorted by url key, time and page."""
    for batch in batches:
        for path, data in zip(batch.column("path"), batch.column("content")):
            rows = []
            for offset, h, body in parse(data.as_buffer().to_pybytes()):
                digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                whole = h["WARC-Type"] == "revisit" or (hashlib.sha256(body).hexdigest() == digest and len(body) == int(h["X-Payload-Length"]))
                rows.append((path.as_py(), offset, _page(h["WARC-Record-ID"]), url_key(h["WARC-Target-URI"]), h["WARC-Date"], h["WARC-Type"], _page(h.get("WARC-Refers-To")), digest, int(h["X-Payload-Length"]), whole))
            rows.sort(key=_order)
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
                names = [x.split()[0] for x in _PARSED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _order(row):
    """url key, time, page, archive, offset."""
    return (row[3], row[4], NO_PAGE if row[2] is None else row[2], row[0], row[1])


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, so a new entry plays log2(k) matches."""

    _END = (1,)

    def __init__(self, runs: list, key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(self.runs))
        self.heads: list = [None] * self.k
        self.keys: list = [self._END] * self.k
        for i in range(len(self.runs)):
            self._advance(i)
        self.losers = [0] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _advance(self, i):
        row = next(self.runs[i], None)
        self.heads[i], self.keys[i] = row, self._END if row is None else (0, self.key(row))

    def _build(self, node):
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if self.keys[b] < self.keys[a]:
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self):
        while self.keys[self.winner] != self._END:
            w = self.winner
            yield self.heads[w]
            self._advance(w)
            node = (w + self.k) // 2
            while node:
                if self.keys[self.losers[node]] < self.keys[w]:
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def _merge(frames):
    """The slices of all runs that fall into this partition, merged into one sequence."""
    runs: dict[str, list] = {}
    names = None
    for f in frames:
        names = list(f.columns)
        for row in f.itertuples(index=False, name=None):
            row = tuple(None if isinstance(x, float) and x != x or x is pd.NA else x for x in row)
            runs.setdefault(row[0], []).append(row)
    if not runs:
        return
    for r in runs.values():
        if any(_order(a) > _order(b) for a, b in zip(r, r[1:])):
            r.sort(key=_order)  # a run's slice can arrive in several blocks
    rows = list(LoserTree(list(runs.values()), _order))
    out = pd.DataFrame(rows, columns=names)
    for c in ("page_id", "refers_to"):
        out[c] = pd.array([r[names.index(c)] for r in rows], dtype="Int64")
    out["position"] = range(len(out))
    yield out


def read_archives(scratch: Scratch, path: str) -> DataFrame:
    """Every record of the archives under path."""
    files = scratch.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(_read, _PARSED)


def capture_index(scratch: Scratch, runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """runs in global order: index_position counts from 0 over all captures."""
    spark = scratch.spark
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartitionByRange(n, "url_key", "captured", F.coalesce("page_id", F.lit(-1)), "archive", "offset")
    merged = dealt.mapInPandas(_merge, _PARSED + ", position long").withColumn("slice", F.spark_partition_id())
    merged = scratch.save(merged, "index")
    counts = merged.groupBy("slice").agg(F.count("*").alias("n")).orderBy("slice").collect()  # one row per partition
    before, total = {}, 0
    for r in counts:
        before[r["slice"]] = total
        total += r["n"]
    starts = spark.createDataFrame(list(before.items()) or [(0, 0)], "slice int, before long")
    merged = merged.join(F.broadcast(starts), "slice").withColumn("index_position", F.col("before") + F.col("position"))
    return merged.drop("slice", "before", "position")


def archive_pages(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Write the archives, read them back, and merge their index: one row per page."""
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    path = scratch.path("archives")
    write_archives(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), path, scratch)
    tasks = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // MERGE_ROWS))
    return capture_index(scratch, read_archives(scratch, path), tasks)


ORACLE = """
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d,
    regexp_extract(coalesce(url, ''), '://(.*)$', 1, 's') AS rest FROM pages),
k AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS host FROM p),
i AS (SELECT page_id, n, d, CASE WHEN rest = '' THEN '' ELSE array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || substr(rest, length(host) + 1) END AS url_key FROM k),
f AS (SELECT d, min(page_id) AS first_page FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
    CASE WHEN page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id > first_page THEN first_page END AS refers_to,
    row_number() OVER (ORDER BY url_key, page_id) - 1 AS index_position, true AS intact FROM i LEFT JOIN f USING (d)
"""
