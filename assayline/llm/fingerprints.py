"""Document fingerprints by one-permutation MinHash.

Every shingle is hashed once; the hash's upper part names a bin and the lowest hash of a
bin is its value. Empty bins borrow by optimal densification: bin b asks the bins
h(b, 1), h(b, 2), ... of one fixed random function until a full one answers. Only the
low bits of each value are kept, packed, and the estimate corrects for chance matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut
from .word_hashes import mix, shingles, text_buffer, words

BINS, BITS = 256, 4
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def one_permutation(hashes: np.ndarray, offsets: np.ndarray, bins: int = BINS) -> np.ndarray:
    """A row of bin values for each set of hashes; a set without hashes has no full bin."""
    n = len(offsets) - 1
    values = np.full(n * bins, _EMPTY)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    spread = mix(hashes ^ np.uint64(0xA0761D6478BD642F))
    cell = owner * bins + (spread >> np.uint64(32)).astype(np.int64) % bins
    np.minimum.at(values, cell, spread & np.uint64(0xFFFFFFFF))
    return values.reshape(n, bins)


def densify(values: np.ndarray) -> np.ndarray:
    """Empty bins filled from full ones; rows without a full bin stay empty."""
    bins = values.shape[1]
    out = values.copy()
    row, col = np.nonzero((values == _EMPTY) & (values != _EMPTY).any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        asked = (mix(mix(col.astype(np.uint64) + np.uint64(1)) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        answer = values[row, asked]
        full = answer != _EMPTY
        out[row[full], col[full]] = answer[full]
        row, col = row[~full], col[~full]
    return out


def low_bits(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low ``bits`` of each value, mixed anew in each bin, so that unlike texts of one
    shingle don't agree or differ in all bins at once; 0 for rows without a value."""
    place = np.arange(1, values.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.where(values == _EMPTY, np.uint64(0), mix(values + place) & np.uint64((1 << bits) - 1)).astype(np.uint8)


def packed(low: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Each row's low bits, most significant first, ``bits`` for a bin."""
    each = (low[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    return [x.tobytes() for x in np.packbits(each.reshape(len(low), -1), axis=1)]


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of rows of low bits: matches less those by chance, 0 to 1."""
    chance = 0.5**bits
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)


class Fingerprints:
    """Low bits of a batch of texts, and which have shingles at all."""

    def __init__(self, texts: list[str], size: int) -> None:
        data, offsets = text_buffer(pa.array(texts, pa.large_string()))
        hashes, at = shingles(*words(data, offsets), size)
        self.low = low_bits(densify(one_permutation(hashes, at)))
        self.full = np.diff(at) > 0

    def packed(self) -> list[bytes]:
        """Each text's packed bits; none for a text without words."""
        return [x if full else b"" for x, full in zip(packed(self.low), self.full.tolist(), strict=True)]


def compared(a_low: np.ndarray, a_full: np.ndarray, b_low: np.ndarray, b_full: np.ndarray) -> np.ndarray:
    """Likeness; 1 where neither text has words and 0 where one alone has."""
    out = likeness(a_low, b_low)
    return np.where(a_full & b_full, out, (a_full == b_full).astype(float))


def edited(text: str, after: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (packed low bits in hex).

    A null text is empty; a text without words has the empty fingerprint, and one with
    fewer words than a shingle has its whole sequence as its one shingle. Equal texts
    have equal fingerprints; long texts are read whole. Null ids, repeated rows and an
    empty table pass through.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.hex() for x in Fingerprints(texts, words_per_shingle).packed()], pa.string())], names=["i", "f"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"i {rows.schema['i'].dataType.simpleString()}, f string").select(F.col("i").alias(id_col), F.col("f").alias("fingerprint"))


_RESULT = "i long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[t]) for n, t in (x.split(" ") for x in ddl.split(", "))])


def _compared(ids: list, texts: list[str], size: int) -> list[list]:
    """The result's columns for all of ``texts`` but the last, each beside the one that follows."""
    own = texts[:-1]
    if not own:
        return [[] for _ in range(7)]
    new = [edited(a, b) for a, b in zip(own, texts[1:], strict=True)]
    one, two = Fingerprints(texts, size), Fingerprints(new, size)
    return [
        ids, list(map(len, own)), [hashlib.sha256(t.encode()).digest() for t in new], one.packed()[:-1], two.packed(),
        compared(one.low[:-1], one.full[:-1], two.low, two.full).tolist(),
        compared(one.low[:-1], one.full[:-1], one.low[1:], one.full[1:]).tolist(),
    ]


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5) -> DataFrame:
    """Fingerprints of each row, of its edited text, and how like the next row's it is.

    The next row has the next smaller id; after the last comes the first. The edited text
    ends in the beginning of the next. Returns id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Null ids follow the smallest id; rows that repeat an id come in the order of their
    texts' first 16 bytes, and then of a hash. A single row is its own next. Texts without
    words have the empty fingerprint, are wholly like each other and not at all like
    others. Long texts are read whole. An empty table gives an empty result; other columns
    are not read.

    Sampled splitters cut the rows into ranges, whatever ids repeat. A range compares its
    own neighbours and hands on its first and last text; the last of each then meets the
    first of the next range, so two texts a range are moved again. Only the numbers of the
    ranges that have rows come to the driver.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), text.alias("t"))
    rows = rows.select("i", "t", F.substring(F.col("t").cast("binary"), 1, 16).alias("p"), F.xxhash64("t").alias("x"), F.monotonically_increasing_id().alias("k"))
    order = [F.col("i").desc_nulls_last(), F.col("p"), F.col("x"), F.col("k")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("range"), "i", "t")
    handed = f"{_RESULT}, range int, first string, last string"

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, before, ends = _schema(handed), None, None
        for batch in bounded(batches, 2):
            if not batch.num_rows:
                continue
            here, ids, texts = (c.to_pylist() for c in batch.columns)
            if before is None:
                ends = (here[0], texts[0])
            else:
                ids, texts = [before[0], *ids], [before[1], *texts]
            before = ids[-1], texts[-1]
            columns = _compared(ids[:-1], texts, words_per_shingle)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)), *(pa.nulls(len(columns[0]), f.type) for f in list(schema)[len(columns) :])], schema=schema)
        if before is not None:
            row = dict.fromkeys(schema.names) | {"i": before[0], "range": ends[0], "first": ends[1], "last": before[1]}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(_RESULT)
        for batch in bounded(batches, 1):
            for i, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                columns = _compared([i], [text, after], words_per_shingle)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    found = cut(ranged.mapInArrow(within, handed))
    ends = found.filter("range IS NOT NULL")
    there = sorted(r["range"] for r in ends.select("range").collect())
    inner = found.filter("range IS NULL").select(*_schema(_RESULT).names)
    written = lambda df: df.select(*[F.lower(F.hex(c)).alias(c) if k == "binary" else F.col(c).alias(id_col if c == "i" else c) for c, k in df.dtypes])
    if not there:
        return written(inner)
    behind = spark.createDataFrame(list(zip(there, there[1:] + there[:1], strict=True)), "range int, behind int")
    firsts = ends.select(F.col("range").alias("behind"), F.col("first").alias("after"))
    meeting = ends.select("range", "i", "last").join(behind, "range").join(firsts, "behind").select("i", "last", "after")
    return written(inner.unionByName(meeting.mapInArrow(across, _RESULT)))
