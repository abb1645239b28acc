"""URL rules in a trie over reversed host labels and path segments.

The trie is built on the driver from the rule list and sent to every worker once. A
lookup walks down the labels of the host from the right and, at every node with paths,
down the segments of the path; the deepest rule wins, by host labels first and path
length next, and a block wins over an allow of the same host and path.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rules that a broadcast trie may have, some 500 bytes each; more are joined as a table.
MOST_RULES = 200_000
_UPPER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


@dataclass
class _Path:
    """Below a host: whole segments lead on; ``ends`` are rules whose last segment is a beginning."""

    segments: dict[str, _Path] = field(default_factory=dict)
    ends: list[tuple[str, str, str]] = field(default_factory=list)


@dataclass
class _Host:
    labels: dict[str, _Host] = field(default_factory=dict)
    paths: _Path | None = None


class Trie:
    """Rules (verdict, host, path); the path is a beginning of the url's path, maybe empty."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.root = _Host()
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r}")
            node = self.root
            host = host.translate(_UPPER)
            for label in reversed(host.split(".")) if host else ():
                node = node.labels.setdefault(label, _Host())
            node.paths = node.paths or _Path()
            at = node.paths
            *whole, last = path.split("/")
            for segment in whole:
                at = at.segments.setdefault(segment, _Path())
            at.ends.append((last, verdict, host + path))
            at.ends.sort(key=lambda e: (-len(e[0]), e[1] != "block"))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits, or None."""
        found = None
        node = self.root
        segments = path.split("/")
        labels = iter(reversed(host.split("."))) if host else iter(())
        while node is not None:
            if node.paths is not None:
                found = _deepest(node.paths, segments) or found
            label = next(labels, None)
            node = None if label is None else node.labels.get(label)
        return found


def _deepest(paths: _Path, segments: list[str]) -> tuple[str, str] | None:
    found, at = None, paths
    for segment in segments:
        for start, verdict, rule in at.ends:
            if segment.startswith(start):
                found = (verdict, rule)
                break
        at = at.segments.get(segment)
        if at is None:
            break
    return found


def parts(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for k in (rest.find(c) for c in "?#") if k >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    return (rest.translate(_UPPER), "") if slash < 0 else (rest[:slash].translate(_UPPER), rest[slash:])


def judge(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]],
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule (null if none fits), verdict.

    A rule fits its host and all subdomains, if the path begins with the rule's. A null
    url, or one without ``://``, has an empty host and path and fits only rules with an
    empty host. Null ids, repeated rows and an empty table pass through; rules that
    repeat count once, and a block wins over an equal allow. Long urls are read whole.
    Other columns are not read. Up to ``MOST_RULES`` rules are a broadcast trie; more are
    a table, joined to the beginnings that the urls have, with the same result.
    """
    spark = pages.sparkSession
    rules = list(rules)
    rows = pages.select(F.col(id_col).alias("i"), F.col(url_col).cast("string").alias("u"))
    if len(rules) > MOST_RULES:
        return _joined(rows, rules, default).withColumnRenamed("i", id_col)
    trie = spark.sparkContext.broadcast(cloudpickle.dumps(Trie(rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = cloudpickle.loads(trie.value).find
        for batch in batches:
            split = [parts(u) for u in batch.column(1).to_pylist()]
            hits = [find(*x) for x in split]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in split], pa.string()),
                    pa.array([p for _, p in split], pa.string()),
                    pa.array([x and x[1] for x in hits], pa.string()),
                    pa.array([x[0] if x else default for x in hits], pa.string()),
                ],
                names=["i", "host", "path", "rule", "verdict"],
            )

    return rows.mapInArrow(run, f"i {rows.schema['i'].dataType.simpleString()}, host string, path string, rule string, verdict string").withColumnRenamed("i", id_col)


def _joined(rows: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """The verdicts by a join of (host, path beginning): a url has one of each for every
    label of its host and every length that a rule's path has, and the longest fit wins.

    Distinct urls are joined, so that no url that many rows have meets the rules more than once.
    """
    spark = rows.sparkSession
    for verdict, _, _ in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
    named = [(v, h.translate(_UPPER), p) for v, h, p in rules]
    lengths = F.array(*[F.lit(n) for n in sorted({len(p) for _, _, p in named})])
    table = spark.createDataFrame(named, "v string, rhost string, rpath string").groupBy("rhost", "rpath").agg(F.max("v").alias("v"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parts(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.string())], names=["i", "host", "path"])

    urls = rows.mapInArrow(split, f"i {rows.schema['i'].dataType.simpleString()}, host string, path string")
    labels = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.split("host", r"\."))
    suffixes = F.transform(F.sequence(F.lit(0), F.size(labels)), lambda k: F.struct(k.alias("n"), F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".").alias("rhost")))
    starts = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    asked = urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("s")).select("host", "path", "s.n", "s.rhost", F.explode(starts).alias("rpath"))
    best = asked.join(table, ["rhost", "rpath"]).groupBy("host", "path").agg(F.max(F.struct("n", F.length("rpath").alias("size"), "rhost", "rpath", "v")).alias("best"))
    best = best.select(F.col("host").alias("h"), F.col("path").alias("p"), F.concat("best.rhost", "best.rpath").alias("rule"), F.col("best.v").alias("verdict"))
    out = urls.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    return out.select("i", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
