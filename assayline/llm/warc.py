"""WARC archives of pages, and an external merge of their capture indexes.

Archives are uncompressed WARC 1.1 files, so that an index entry's offset and length
address a record. Spark writes them as text whose line separator is the two line ends
that close a record, and reads them whole as binary files, so any store that Spark
reaches will do.

Each archive is one capture run. Its entries are sorted by URL key and time where it is
read; sampled splitters cut the sorted run into pieces, a piece travels to its range as
one row, and a loser tree merges the pieces of a range, which are not sorted again. A
splitter is a whole sort key, so captures of one URL are cut as well.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, few, shuffle_partitions
from .url_filter import parts

#: Records and bytes of one archive, which holds one record more at most.
RECORDS, ARCHIVE_BYTES = 5_000, 32 << 20
#: Repeated payloads (60 bytes each) that a broadcast may have.
BROADCAST_ROWS = 200_000
#: Entries of a range on average, and entries sampled for splitters at most.
RANGE, SAMPLE = 50_000, 20_000
_END = "\r\n\r\n"
_HEX5, _B32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_ENTRY = "url_key string, captured_at string, record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, archive string, offset long, length long"
_NAMES = [x.split(" ")[0] for x in _ENTRY.split(", ")]


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's bytes."""
    digest = F.sha1(text.cast("binary"))
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(digest, k, 10), 16, 32), 8, "0"), _HEX5, _B32) for k in (1, 11, 21, 31)])


def _utc(time: Column) -> Column:
    """ISO 8601 in UTC with six decimals, so that the order of texts is that of times."""
    micros = F.unix_micros(time.cast("timestamp"))
    rest = F.pmod(micros, F.lit(86_400_000_000))
    days = F.date_add(F.lit("1970-01-01").cast("date"), ((micros - rest) / F.lit(86_400_000_000)).cast("int"))
    part = lambda unit, size: F.lpad(F.pmod(F.floor(rest / F.lit(unit)), F.lit(size)).cast("string"), 2, "0")
    second = F.concat(part(1_000_000, 60), F.lit("."), F.lpad(F.pmod(rest, F.lit(1_000_000)).cast("string"), 6, "0"))
    return F.concat(days.cast("string"), F.lit("T"), part(3_600_000_000, 24), F.lit(":"), part(60_000_000, 60), F.lit(":"), second, F.lit("Z"))


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    least_bytes: int = 0,
    time_col: str | None = None,
) -> None:
    """A record for each row of ``pages`` in archives under ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes that with the largest id
    becomes a response and the others revisits that refer to it; smaller payloads are
    responses. Payloads are equal when their SHA-256 is, and their SHA-1 is written. A
    null payload is empty, a null url is written as an empty URI, a null id is never
    referred to while its group has others. Rows that repeat the largest id of their group
    are responses all. Line ends in a url are percent-encoded. ``time_col`` has the times
    of capture, written in UTC to the microsecond; without it, or where it is null, the
    time is ``date``.

    An archive ends after ``RECORDS`` records or ``ARCHIVE_BYTES`` bytes, so a payload may
    be as long as Spark's strings.
    """
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    uri = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    uri = F.replace(F.replace(uri, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    when = F.coalesce(_utc(F.col(time_col)), F.lit(date)) if time_col else F.lit(date)
    rows = pages.select(F.col(id_col).cast("string").alias("i"), F.col(id_col).alias("order"), uri.alias("u"), text.alias("t"), when.alias("at")).withColumn("d", base32_sha1(F.col("t"))).withColumn("e", F.sha2("t", 256))
    equal = rows.filter(F.octet_length("t") >= least_bytes).groupBy("e").agg(F.max("order").cast("string").alias("keep"), F.count(F.lit(1)).alias("c")).filter("c > 1 AND keep IS NOT NULL")
    joined = _with_kept(rows, cut(equal))
    revisit = F.col("keep").isNotNull() & ~F.col("keep").eqNullSafe(F.col("i"))
    line = F.lit("\r\n")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("t").cast("string"), F.lit(_END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("t")))
    name = lambda c: F.concat(F.lit("<urn:capture:"), F.coalesce(c, F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), line,
        F.lit("WARC-Record-ID: "), name(F.col("i")), line,
        F.lit("WARC-Date: "), F.col("at"), line,
        F.lit("WARC-Target-URI: "), F.col("u"), line,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("d"), line,
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("keep")), line)).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END), block,
    )
    dealt = joined.select(record.alias("value")).mapInArrow(_dealt, "value string, archive int")
    dealt.write.partitionBy("archive").option("lineSep", _END).text(path)


def _with_kept(rows: DataFrame, equal: DataFrame) -> DataFrame:
    """``rows`` with ``keep``, the id that stays of payloads equal to theirs, or null.

    ``equal`` (e, keep, c) is broadcast if it is small. If it isn't, what is broadcast are
    the payloads that more than a task's share of the rows have, and the rest is joined by
    a shuffle, in which the rows found already are spread.
    """
    kept = equal.select("e", "keep")
    known = few(kept, BROADCAST_ROWS)
    if known is kept:
        parts = shuffle_partitions(rows.sparkSession)
        share = (equal.agg(F.sum("c")).first()[0] or 0) // parts
        hot = equal.filter(F.col("c") > share).select(F.col("e").alias("hot"), F.col("keep").alias("hot_keep"))
        marked = rows.join(F.broadcast(hot), F.col("e") == F.col("hot"), "left").withColumn("key", F.when(F.col("hot").isNotNull(), F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))).otherwise(F.col("e")))
        return marked.join(equal.select(F.col("e").alias("key"), "keep"), "key", "left").withColumn("keep", F.coalesce("keep", "hot_keep"))
    return rows.join(known, "e", "left")


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records with the number of their archive among those of their task."""
    archive, records, size = 0, 0, 0
    for batch in batches:
        out = []
        for n in pc.binary_length(batch.column(0)).to_pylist():
            if records >= RECORDS or size >= ARCHIVE_BYTES:
                archive, records, size = archive + 1, 0, 0
            out.append(archive)
            records, size = records + 1, size + n
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32())], names=["value", "archive"])


def records_of(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers by lower-cased name, block) of each record."""
    at = 0
    while at < len(archive):
        head = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:head].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        begin = head + 4
        end = begin + int(headers["content-length"])
        if archive[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} doesn't end")
        yield at, end + 4 - at, headers, archive[begin:end]
        at = end + 4


def url_key(url: str) -> str:
    """Host labels from the right, then the path and the rest: com,example,www)/path?query."""
    host, path = parts(url)
    at = url.find("?", url.find("://") + 3) if "://" in url else -1
    return ",".join(reversed(host.split("."))) + ")" + path.lower() + (url[at:].split("#")[0].lower() if at >= 0 else "")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    named = lambda x: x.removeprefix("<urn:capture:").removesuffix(">") or None
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            run = []
            for offset, length, head, block in records_of(content.as_py()):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"record at byte {offset} of {path} is damaged")
                url = head["warc-target-uri"]
                run.append((url_key(url), head["warc-date"], named(head["warc-record-id"]), url, size, digest, head["warc-type"], named(head.get("warc-refers-to", "")), path.as_py(), offset, length))
            run.sort(key=_sort_key)
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, x, strict=True)) for x in run], schema=_schema())


def _schema() -> pa.Schema:
    return pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split(" ") for x in _ENTRY.split(", "))])


def _sort_key(entry: tuple) -> tuple:
    """URL key and time, then what tells equal captures apart: archive and offset."""
    return entry[0], entry[1], entry[8], entry[9]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An entry for each record of the archives under ``path``, sorted within each archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(_entries, _ENTRY)


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[list], key) -> None:
        self.runs, self.key, self.at = runs, key, [0] * len(runs)
        n = max(1, len(runs))
        self.size = 1 << (n - 1).bit_length()
        self.heads = [key(r[0]) if r else None for r in runs] + [None] * (self.size - len(runs))
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.size > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def __iter__(self) -> Iterator:
        while self.heads and self.heads[self.winner] is not None:
            run = self.winner
            rows = self.runs[run]
            yield rows[self.at[run]]
            self.at[run] += 1
            self.heads[run] = self.key(rows[self.at[run]]) if self.at[run] < len(rows) else None
            node = (run + self.size) // 2
            while node:
                if self._before(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def merge_index(index: DataFrame) -> DataFrame:
    """The entries with their range and place in the global order by URL key and time.

    ``index`` has sorted runs, as ``read_index`` gives them. Every entry of range k comes
    before those of range k + 1; ``place`` counts from 0 over all ranges. A range holds some
    ``RANGE`` entries, whatever their keys, and at most a bounded sample of sort keys comes
    to the driver. An empty index gives an empty result.
    """
    n = index.count()
    ranges = -(-n // RANGE)
    keys = []
    if ranges > 1:
        drawn = index.select("url_key", "captured_at", "archive", "offset").sample(min(1.0, SAMPLE / (2 * n)), seed=0).limit(SAMPLE).collect()
        drawn = sorted(tuple(r) for r in drawn)
        keys = sorted({drawn[k * len(drawn) // ranges] for k in range(1, ranges)}) if drawn else []

    def cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each stretch of a batch that has one run's entries of one range."""
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_pylist() for k in (0, 1, 8, 9)]
            at = np.fromiter((bisect_right(keys, k) for k in zip(*columns, strict=True)), np.int32, batch.num_rows)
            run = np.unique(columns[2], return_inverse=True)[1].reshape(-1)
            begins = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (run[1:] != run[:-1])))
            offsets = pa.array(np.append(begins, batch.num_rows), pa.int32())
            rows = pa.StructArray.from_arrays(batch.columns, names=_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(at[begins]), pa.ListArray.from_arrays(offsets, rows)], names=["range", "run"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("range", pa.int32()), ("within", pa.int64()), *_schema()])
        now, runs = None, []

        def done() -> pa.RecordBatch:
            rows = list(LoserTree(runs, _sort_key))
            columns = [[now] * len(rows), range(len(rows)), *zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for at, run in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if at != now:
                    if runs:
                        yield done()
                    now, runs = at, []
                runs.append(list(zip(*(c.to_pylist() for c in run.values.flatten()), strict=True)))
        if runs:
            yield done()

    entry = ", ".join(f"{n}: {t}" for n, t in (x.split(" ") for x in _ENTRY.split(", ")))
    pieces = index.mapInArrow(cut_runs, f"range int, run array<struct<{entry}>>")
    merged = cut(pieces.repartition("range").sortWithinPartitions("range").mapInArrow(merge, f"range int, within long, {_ENTRY}"))
    # One row for each range, and so one in some RANGE entries.
    counts = merged.groupBy("range").agg(F.count(F.lit(1)).alias("c"))
    before = cut(counts.select("range", (F.sum("c").over(W.orderBy("range")) - F.col("c")).alias("before")))
    placed = merged.join(few(before, BROADCAST_ROWS), "range")
    return placed.select("range", (F.col("before") + F.col("within")).alias("place"), *_NAMES)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def captured(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, time_col: str | None = None) -> DataFrame:
    """Archives under ``path``, read back: the merged capture index, ids in their own type.

    Cases as for ``write_archives``; an empty table gives an empty index. Equal keys and
    times come by archive and offset. Other columns of ``pages`` are not read, whatever
    their names.
    """
    write_archives(pages, path, id_col, url_col, payload_col, least_bytes=least_bytes, time_col=time_col)
    kind = pages.schema[id_col].dataType
    index = cut(read_index(pages.sparkSession, path))
    merged = merge_index(index)
    return merged.withColumn(id_col, F.col("record_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind)).drop("record_id")
