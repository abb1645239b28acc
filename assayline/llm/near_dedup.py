"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Two permutations make a whole signature: the first scatters the shingles over the
numbers below 2**32, the second, shifted round by k, orders them for coordinate k.

Only distinct shingle sets are banded. A bucket never expands into its pairs:

1. every member is compared, on full sets, with one smaller member that it shares the
   most buckets with; the links make a forest whose trees are found by pointer jumping;
2. in the buckets that still hold several trees, the members outside the largest one
   meet the rest in blocks of signatures; the texts of those that signatures don't rule
   out against any other by a wide margin come to the same blocks and are compared on
   full sets, and the links join trees. Pairs are never rows; only links are.

So a large group of copies costs comparisons in proportion to its members, and no link
that banding proposes is lost. Hashes of shingles find a link, and the words themselves
confirm it. Rows are one vertex if their words are the same in the same order, which
their SHA-256 says.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, cut, few, gathered, salt_of
from .word_hashes import mix, shingles, text_buffer, words

#: Bands and rows of a band: a pair of similarity 0.8 shares no band with probability 5e-6.
BANDS, ROWS = 40, 6
#: Members of one side of a comparison block, on average: a 64th of the unit's, but within
#: these bounds, so that a large unit is copied to fewer blocks; and the bytes of their texts.
BLOCK, LARGE_BLOCK, BLOCK_BYTES = 128, 4096, 16 << 20
#: Standard deviations below the threshold at which a signature rules a pair out.
MARGIN = 5
#: Rows (32 bytes each) that a broadcast may have.
BROADCAST_ROWS = 200_000
_CELLS = 1 << 16


def circulant_signature(found: np.ndarray, coordinates: int) -> np.ndarray:
    """Low bytes of the minima of the shifted permutation over a set of 64-bit hashes."""
    spread = (mix(found ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty(coordinates, np.uint32)
    step = max(1, min(coordinates, _CELLS // max(1, len(spread))))
    for k in range(0, coordinates, step):
        shifts = np.arange(k, min(k + step, coordinates), dtype=np.uint32)
        low = None
        for at in range(0, len(spread), _CELLS):
            y = shifts[:, None] + spread[None, at : at + _CELLS]
            y ^= y >> np.uint32(16)
            y *= np.uint32(0x85EBCA6B)
            y ^= y >> np.uint32(13)
            y *= np.uint32(0xC2B2AE35)
            part = y.min(axis=1)
            low = part if low is None else np.minimum(low, part)
        out[k : k + len(shifts)] = low
    out ^= out >> np.uint32(15)
    return (out & np.uint32(255)).astype(np.uint8)


def _sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    data, offsets = text_buffer(texts)
    hashes, at = shingles(*words(data, offsets), size)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield np.unique(hashes[a:b])


def _contents(text: str, size: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves: runs of ``size`` words, or the whole sequence of fewer."""
    found = text.encode().lower().split()
    if len(found) < size:
        return {tuple(found)} if found else set()
    return set(zip(*(found[k:] for k in range(size)), strict=False))


def _signatures(size: int):
    """Rows (i, t, x, b) to (i, x, b, n, d, sig): set size, digest of the words, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            n, digests, signed = [], [], []
            for own, text in zip(_sets(batch.column(1), size), batch.column(1).cast(pa.binary()), strict=True):
                n.append(len(own))
                digests.append(hashlib.sha256(b" ".join((text.as_py() or b"").lower().split())).digest())
                signed.append(circulant_signature(own, BANDS * ROWS).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signed, pa.binary())],
                names=["i", "x", "b", "n", "d", "sig"],
            )

    return run


class Shingled:
    """A text's shingles: hashes to find a link by, and, once one is found, the words to confirm it."""

    def __init__(self, text: str, size: int, hashes: np.ndarray | None = None) -> None:
        self.text, self.size = text, size
        self.hashes = next(_sets(pa.array([text], pa.large_string()), size)) if hashes is None else hashes
        self.words: set | None = None

    def contents(self) -> set:
        if self.words is None:
            self.words = _contents(self.text, self.size)
        return self.words

    def similar(self, other: Shingled, percent: int) -> bool:
        a, b = self.hashes, other.hashes
        if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        if 100 * both < percent * (len(a) + len(b) - both):
            return False
        one, two = self.contents(), other.contents()
        both = len(one & two)
        return both > 0 and 100 * both >= percent * (len(one) + len(two) - both)


def _compare(size: int, percent: int):
    """Rows (a, block, m, t), sorted so that the text of ``a`` itself (m null) leads its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in bounded(batches, 3):
            a, m = [], []
            texts = batch.column(3).to_pylist()
            for *key, text, found in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), texts, _sets(batch.column(3), size), strict=True):
                row = Shingled(text, size, found)
                if key[:2] != at:
                    at, own = key[:2], None
                if key[2] is None:
                    own = row
                elif own is not None and own.similar(row, percent):
                    a.append(key[0])
                    m.append(key[2])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(m, pa.int64())], names=["a", "m"])

    return run


def _verified(pairs: DataFrame, vertices: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, m) whose full sets are similar; a's members are dealt over blocks.

    Up to ``BROADCAST_ROWS`` wanted texts are found by a broadcast of their ids, more by
    a shuffled join.
    """
    dealt = cut(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")))
    placed = pairs.join(few(dealt, BROADCAST_ROWS), "a").select("a", "m", F.pmod(F.xxhash64("m"), F.col("blocks")).alias("block"))
    asked = placed.select(F.col("m").alias("u"), "a", "block", "m").unionByName(
        dealt.select(F.col("a").alias("u"), "a", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), F.lit(None).cast("long").alias("m"))
    )
    wanted = cut(asked.join(vertices.select("u", "i", "x"), "u").select("i", "x", "a", "block", "m"))
    return cut(
        texts.join(few(wanted, BROADCAST_ROWS), ["i", "x"])
        .select("a", "block", "m", "t")
        .repartition("a", "block")
        .sortWithinPartitions("a", "block", F.col("m").asc_nulls_first())
        .mapInArrow(_compare(size, percent), "a long, m long")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``edges`` (a, m): the smallest vertex it can reach.

    Each round every vertex takes the least label around it and then its label's label,
    so labels travel twice as far with each round. Labels are broadcast while there are
    at most ``BROADCAST_ROWS``, and joined by shuffles beyond.
    """
    both = cut(edges.select("a", F.col("m").alias("b")).unionByName(edges.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct())
    n = both.count()
    both = gathered(both, n)
    labels = cut(gathered(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("v"), F.least("a", "least").alias("label")), n))
    while True:
        known = few(labels, BROADCAST_ROWS)
        near = both.join(known, both.b == labels.v).groupBy("a").agg(F.min("label").alias("near"))
        step = near.join(known, near.a == labels.v).select("v", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("v").alias("next"), F.col("label").alias("far"))
        jump = F.broadcast(jump) if known is not labels else jump
        moved = cut(gathered(step.join(jump, "next", "left").select("v", F.col("label").alias("old"), F.least("next", F.coalesce("far", "next")).alias("label")), n))
        labels = moved.select("v", "label")
        if moved.filter("label <> old").isEmpty():
            return labels


def _candidates(asked: list, given: list, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each asked row (u, label, n, sig, ...) the places of the given rows of other trees
    that share a band with it and that sizes and signatures don't rule out, likeliest first."""
    threshold = percent / 100
    least = (threshold - MARGIN * (threshold * (1 - threshold) / (BANDS * ROWS)) ** 0.5) * BANDS * ROWS
    d = np.frombuffer(b"".join(x[3] for x in given), np.uint8).reshape(len(given), -1)
    label, n = (np.array([x[k] for x in given], np.int64) for k in (1, 2))
    for k, row in enumerate(asked):
        at = np.flatnonzero((label != row[1]) & (100 * np.minimum(n, row[2]) >= percent * np.maximum(n, row[2])))
        same = d[at] == np.frombuffer(row[3], np.uint8)
        agree = same.sum(axis=1)
        near = (agree >= least) & same.reshape(len(at), BANDS, ROWS).all(axis=2).any(axis=1)
        at, agree = at[near], agree[near]
        yield k, at[np.argsort(-agree, kind="stable")]


def _blocks(found, names: list[str]):
    """Applies ``found(asked, given)`` to the blocks of sorted rows (unit, qb, db, role, ...),
    asked rows having role 0; its rows follow the block's unit, qb and db."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, given = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            rows = found(at, asked, given) if asked and given else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "sig" else pa.int32() if n == "role" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

        for batch in batches:
            for unit, qb, db, role, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (unit, qb, db) != at:
                    yield from done()
                    at, asked, given = (unit, qb, db), [], []
                (given if role else asked).append(tuple(row))
        yield from done()

    return run


def _worth(percent: int):
    """Rows of a block that are in any candidate pair, with their role."""

    def found(at: tuple, asked: list, given: list) -> list[tuple]:
        out, there = [], np.zeros(len(given), bool)
        for k, places in _candidates(asked, given, percent):
            if len(places):
                out.append((*at, 0, *asked[k]))
                there[places] = True
        return out + [(*at, 1, *given[j]) for j in np.flatnonzero(there).tolist()]

    return _blocks(found, ["unit", "qb", "db", "role", "u", "label", "n", "sig"])


def _cross(size: int, percent: int):
    """Links (a, m) of a block: every asked row meets its candidates until it has a link to their tree."""

    def found(at: tuple, asked: list, given: list) -> list[tuple]:
        shingled: dict[int, Shingled] = {}

        def of(row: tuple) -> Shingled:
            if row[0] not in shingled:
                shingled[row[0]] = Shingled(row[4], size)
            return shingled[row[0]]

        out = []
        for k, places in _candidates(asked, given, percent):
            row, joined = asked[k], set()
            for j in places.tolist():
                other = given[j]
                if other[1] not in joined and of(row).similar(of(other), percent):
                    joined.add(other[1])
                    out.append((min(row[0], other[0]), max(row[0], other[0])))
        return out

    return _blocks(found, ["a", "m"])


def _between_trees(shared: DataFrame, labels: DataFrame, vertices: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between members of different trees that share a bucket.

    Buckets with several trees whose largest tree is the same make one unit, in which each
    member stands once however many buckets it shares. Those outside the largest tree in
    some bucket are asked about all others. Signatures go to all blocks of a unit; texts
    only where a pair of a block needs them.
    """
    named = shared.select("bucket", "u").join(few(labels.withColumnRenamed("v", "u"), BROADCAST_ROWS), "u", "left").select("bucket", "u", F.coalesce("label", "u").alias("label"))
    trees = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    several = cut(trees.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("bucket", F.col("top.label").alias("unit")))
    held = named.join(few(several, BROADCAST_ROWS), "bucket").groupBy("unit", "u", "label").agg(F.count(F.lit(1)).alias("buckets")).drop("buckets")
    held = cut(held.join(vertices, "u").select("unit", "u", "label", "n", "sig", "b", (F.col("label") != F.col("unit")).alias("asked")))
    held = gathered(held, held.count(), 20_000)
    each = F.greatest(F.lit(BLOCK), F.least(F.lit(LARGE_BLOCK), F.floor(F.count(F.lit(1)) / 64)))
    count = lambda rows, size: F.greatest(F.ceil(rows / each), F.ceil(size / BLOCK_BYTES), F.lit(1))
    blocks = held.groupBy("unit").agg(count(F.count_if("asked"), F.sum(F.when(F.col("asked"), F.col("b")))).alias("qs"), count(F.count(F.lit(1)), F.sum("b")).alias("ds"))
    places = F.expr(
        "concat(transform(sequence(0L, qs - 1), k -> named_struct('qb', k, 'db', pmod(xxhash64(u), ds), 'role', 1)), "
        "if(asked, transform(sequence(0L, ds - 1), k -> named_struct('qb', pmod(xxhash64(u), qs), 'db', k, 'role', 0)), array()))"
    )
    block, own = ["unit", "qb", "db", "role"], ["u", "label", "n", "sig"]

    met = held.join(few(cut(blocks), BROADCAST_ROWS), "unit").withColumn("at", F.explode(places))
    met = met.select("unit", F.col("at.qb").alias("qb"), F.col("at.db").alias("db"), F.col("at.role").alias("role"), *own)
    # A unit's blocks are many and alike, so ranges deal them more evenly than hashes do.
    met = met.repartitionByRange("unit", "qb", "db").sortWithinPartitions(*block)
    worth = cut(met.mapInArrow(_worth(percent), "unit long, qb long, db long, role int, u long, label long, n long, sig binary"))
    ids = few(cut(vertices.join(worth.select("u").distinct(), "u", "left_semi").select("u", "i", "x")), BROADCAST_ROWS)
    bodies = texts.join(ids, ["i", "x"]).select("u", "t")
    full = worth.join(bodies, "u").select(*block, *own, "t").repartition("unit", "qb", "db").sortWithinPartitions(*block)
    return cut(full.mapInArrow(_cross(size, percent), "a long, m long").distinct())


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = 5,
    percent: int = 80,
) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept, text_hash.

    Words are lower-cased in A-Z and split at ASCII white space; two texts are linked
    when their sets of distinct shingles reach ``percent`` per cent of Jaccard
    similarity. A text with fewer words than a shingle has one shingle, its whole
    sequence. ``component_id`` is the smallest id that links reach, and ``kept`` says
    that the row's id is this one.

    A null or wordless text has no shingles and is linked with nothing. A row with a
    null id has a null component, is kept, and links nothing. Rows that repeat an id
    have links of their own: ``text_hash``, Spark's ``xxhash64`` of the text, tells them
    apart. Long texts are compared whole. An empty table gives an empty result. Other
    columns of ``docs`` are not read, whatever their names. Ids are whole numbers.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("i"), text.alias("t")).select("i", "t", F.xxhash64("t").alias("x"), F.octet_length("t").cast("long").alias("b"))
    signed = base.mapInArrow(_signatures(words_per_shingle), "i long, x long, b long, n long, d binary, sig binary")
    # The checkpoint fixes the rows' numbers, which name vertices from here on.
    signed = cut(signed.withColumn("u", F.monotonically_increasing_id()).withColumn("s", salt_of(spark, F.col("u"))))

    # Rows of the same words are one vertex, that of their smallest id; the salt spreads words that many rows have.
    full = signed.filter("n > 0 AND i IS NOT NULL")
    sets = full.groupBy("d", "s").agg(F.min(F.struct("i", "x", "u")).alias("v")).select("d", "s", F.min("v").over(W.partitionBy("d")).alias("v"))
    members = cut(full.join(sets, ["d", "s"]).select("i", "x", "b", "n", "u", F.col("v.u").alias("v"), F.col("v.i").alias("least"), F.when(F.col("u") == F.col("v.u"), F.col("sig")).alias("sig")))
    vertices = members.filter("sig IS NOT NULL").select("u", "i", "x", "b", "n", "sig")

    band = F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(sig, b * {ROWS} + 1, {ROWS})))"))
    rows = vertices.select("u", band.alias("band", "bucket"))
    buckets = rows.groupBy("bucket").agg(F.min("u").alias("rep"), F.max("u").alias("last"), F.count(F.lit(1)).alias("size")).filter("rep < last")
    shared = cut(rows.join(buckets, "bucket").select("bucket", "band", "u", "rep", "size"))
    texts = _one_each(base.filter("i IS NOT NULL").select("i", "x", "t"), members)

    # 1: a forest.
    asked = shared.filter("u > rep").groupBy("u", "rep").agg(F.count(F.lit(1)).alias("c"))
    tested = cut(asked.groupBy(F.col("u").alias("m")).agg(F.max_by("rep", F.struct(F.col("c"), -F.col("rep"))).alias("a")).select("a", "m"))
    tested = gathered(tested, tested.count())
    links = _verified(tested, vertices, texts, words_per_shingle, percent)
    labels = components(links)

    # 2: what is left between trees; a bucket of two has been settled.
    settled = shared.filter("size = 2 AND u > rep").join(few(tested, BROADCAST_ROWS), (F.col("rep") == F.col("a")) & (F.col("u") == F.col("m"))).select("bucket")
    open_ = shared.join(few(cut(settled), BROADCAST_ROWS), "bucket", "left_anti")
    more = _between_trees(open_, labels, vertices, texts, words_per_shingle, percent)
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    # A component has the smallest id of its vertices, each of which has that of its rows.
    linked = labels.join(vertices.select(F.col("u").alias("v"), "i"), "v")
    least = cut(linked.groupBy("label").agg(F.min("i").alias("c")))
    found = cut(labels.join(few(least, BROADCAST_ROWS), "label").select("v", "c"))
    named = members.join(few(found, BROADCAST_ROWS), "v", "left").select("i", "x", "n", F.coalesce("c", "least").alias("c"))
    rest = signed.filter("n = 0 OR i IS NULL").select("i", "x", "n", F.col("i").alias("c"))
    return named.unionByName(rest).select(
        F.col("i").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("c").alias("component_id"),
        F.col("i").eqNullSafe(F.col("c")).alias("kept"),
        F.col("x").alias("text_hash"),
    )


def _one_each(texts: DataFrame, members: DataFrame) -> DataFrame:
    """``texts`` with one of the rows that repeat both id and text, so that no search meets them all."""
    again = cut(members.groupBy("i", "x").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("i", "x"))
    if again.isEmpty():
        return texts
    marked = few(again, BROADCAST_ROWS)
    once = texts.join(marked, ["i", "x"], "left_semi").groupBy("i", "x").agg(F.min("t").alias("t"))
    return texts.join(marked, ["i", "x"], "left_anti").unionByName(once)
