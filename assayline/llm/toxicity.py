"""Toxicity by a counterfactually regularised classifier.

A logistic model over the words of a text and their beginnings is fitted on labelled
texts. Every labelled text makes counterfactual pairs. One that names a group of people is
paired with copies in which another name of its kind stands for it. One that names nobody
is given a neutral sentence about a group, by a template; it is paired with the text
without it and with the same sentence about another group. The fit is penalised by the
squared change of the score's logit between the two of a pair, so that naming a group
gains no weight of its own, whatever it stands beside in the sample.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut

#: Labelled rows that a model is fitted on at most: those with the smallest hash of their id.
SAMPLE = 10_000
#: Rows of the sample that must have a feature, and how many standard deviations its toxic
#: rows must be off, to be one of the model's; the features of groups' names always are.
SEEN, DEVIATION = 5, 5.0
#: Weights of the penalties: on changes under swaps, and on the sum of absolute weights.
COUNTERFACTUAL, SPARSE = 5.0, 1e-4
STEPS = 600

#: Names of groups by kind; a swap puts another name of the same kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "jewish", "christian", "hindu", "buddhist", "atheist"),
    ("muslims", "jews", "christians", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("mexican", "chinese", "indian", "german", "french", "spanish", "turkish", "polish"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "elderly", "young", "old"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "juden", "christen", "ausländer", "flüchtlinge"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "juifs", "chrétiens", "immigrés", "réfugiés"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "judíos", "cristianos", "inmigrantes", "refugiados"),
)
#: Neutral sentences about a group, whose name they are given.
TEMPLATES = ("the {} of the town", "many {} live here", "my neighbours are {}", "a book about {}")
_WORD = re.compile(r"[^\W\d_]+")
_HEADS = (4, 5, 6)


def features_of(words: set[str]) -> set[str]:
    """Whole words, and their first 4, 5 and 6 letters marked by an asterisk."""
    out = set(words)
    for n in _HEADS:
        out.update([w[:n] + "*" for w in words if len(w) >= n])
    return out


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def swapped(words: set[str], kinds: tuple[tuple[str, ...], ...], turn: int) -> set[str] | None:
    """The words with every group name moved on by ``turn`` in its kind; None without names."""
    moved = {w: kind[(k + turn) % len(kind)] for kind in kinds for k, w in enumerate(kind) if w in words}
    return {moved.get(w, w) for w in words} if moved else None


def counterfactuals(text: str, kinds: tuple[tuple[str, ...], ...]) -> list[tuple[set[str], set[str]]]:
    """Pairs of sets of words that differ in the group they name alone.

    Which name and template a text without names gets depends on the text alone, so that
    over many texts all names and templates come up alike.
    """
    words = words_of(text)
    if swapped(words, kinds, 0) is not None:
        return [(words, c) for turn in (1, 2) if (c := swapped(words, kinds, turn)) is not None]
    if not kinds:
        return []
    draw = zlib.crc32(text.encode())
    kind = kinds[draw % len(kinds)]
    k, template = draw // len(kinds), TEMPLATES[draw // 7 % len(TEMPLATES)]
    one, two = (words | words_of(template.format(kind[(k + j) % len(kind)])) for j in (0, 1))
    return [(words | words_of(template.format("")), one), (one, two)]


class Model:
    """Weights by feature and an intercept; scores are probabilities of label 1. ``pairs``
    is the number of counterfactual pairs that it was fitted with."""

    def __init__(self, weights: dict[str, float], intercept: float, pairs: int = 0) -> None:
        self.weights, self.intercept, self.pairs = weights, intercept, pairs
        self.whole = {k: v for k, v in weights.items() if not k.endswith("*")}
        self.heads = [(n, {k[:-1]: v for k, v in weights.items() if k.endswith("*") and len(k) == n + 1}) for n in _HEADS]

    def score(self, text: str) -> float:
        words = words_of(text)
        logit = self.intercept + sum(self.whole[w] for w in words & self.whole.keys())
        for n, heads in self.heads:
            if heads:
                logit += sum(heads[h] for h in {w[:n] for w in words} & heads.keys())
        return 1 / (1 + math.exp(-min(max(logit, -30.0), 30.0)))


def neutral_mentions(model: Model, kinds: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> tuple[int, int, float]:
    """How many of all neutral sentences about groups a model flags, of how many, and the
    largest difference of score between a sentence and the same one without the name."""
    scores = [(model.score(t.format(name)), model.score(t.format(""))) for t in TEMPLATES for kind in kinds for name in kind]
    return sum(s >= 0.5 for s, _ in scores), len(scores), max((abs(a - b) for a, b in scores), default=0.0)


class Objective:
    """The smooth part of the loss of rows (label, features, pairs): mean log loss, plus
    ``counterfactual`` times the mean squared difference of logits over all pairs.

    A pair has the features that only its first text has, as c + 1, and those that only
    its second has, as -(c + 1).
    """

    def __init__(self, rows: list[tuple[int, list[int], list[list[int]]]], n: int, counterfactual: float) -> None:
        self.n, self.rows, self.counterfactual = n, len(rows), counterfactual
        self.y = np.array([r[0] for r in rows], float)
        self.row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
        self.col = np.array([c for r in rows for c in r[1]], np.int64)
        pairs = [p for r in rows for p in r[2]]
        self.pairs = len(pairs)
        signed = np.array([c for p in pairs for c in p], np.int64)
        self.drow, self.dcol, self.dval = np.repeat(np.arange(len(pairs)), list(map(len, pairs))), np.abs(signed) - 1, np.sign(signed).astype(float)

    def _differences(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.drow, self.dval * w[self.dcol], self.pairs)

    def _spread(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.dcol, self.dval * d[self.drow], self.n) * (2 * self.counterfactual / self.pairs)

    def loss(self, w: np.ndarray, b: float) -> float:
        z = np.bincount(self.row, w[self.col], self.rows) + b
        out = float((np.logaddexp(0, z) - self.y * z).mean())
        return out + self.counterfactual * float((self._differences(w) ** 2).mean()) if self.pairs else out

    def gradient(self, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        p = 1 / (1 + np.exp(-np.clip(np.bincount(self.row, w[self.col], self.rows) + b, -30, 30)))
        g = np.bincount(self.col, (p - self.y)[self.row], self.n) / self.rows
        return g + self._spread(self._differences(w)) if self.pairs else g, float((p - self.y).mean())

    def curvature(self, v: np.ndarray) -> np.ndarray:
        """A matrix that bounds the Hessian, times (weights, intercept)."""
        z = (np.bincount(self.row, v[self.col], self.rows) + v[self.n]) / (4 * self.rows)
        out = np.append(np.bincount(self.col, z[self.row], self.n), z.sum())
        if self.pairs:
            out[: self.n] += self._spread(self._differences(v))
        return out


def fit(rows: list[tuple[int, list[int], list[list[int]]]], n: int, counterfactual: float = COUNTERFACTUAL, sparse: float = SPARSE) -> tuple[np.ndarray, float]:
    """Weights and intercept that make ``Objective`` plus ``sparse`` times the absolute
    weights least, by accelerated proximal gradient steps."""
    if not rows:
        return np.zeros(n), 0.0
    f = Objective(rows, n, counterfactual)
    w, b = np.zeros(n), math.log((f.y.mean() + 1e-6) / (1 - f.y.mean() + 1e-6))
    # The largest eigenvalue bounds the step, by power iteration.
    v, step = np.full(n + 1, 1.0), 1.0
    for _ in range(30):
        u = f.curvature(v)
        norm = np.linalg.norm(u)
        if not norm:
            break
        step, v = 1 / (1.1 * norm / np.linalg.norm(v)), u / norm
    at, bt, momentum = w.copy(), b, 1.0
    for _ in range(STEPS):
        g, gb = f.gradient(at, bt)
        x = at - step * g
        new, new_b = np.sign(x) * np.maximum(np.abs(x) - step * sparse, 0), bt - step * gb
        following = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        at, bt = new + (momentum - 1) / following * (new - w), new_b + (momentum - 1) / following * (new_b - b)
        w, b, momentum = new, new_b, following
    return w, b


def train(
    docs: DataFrame,
    labels: DataFrame,
    usable: Callable[[Column], Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
    kinds: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
) -> Model:
    """A model from at most ``sample`` labelled rows whose id ``usable`` admits.

    Null ids, labels other than 0 and 1, and labelled ids without a document are passed
    over. An id with labels of both kinds is toxic, and one with several texts counts with
    the least of them. A null text is empty; long texts are read whole. Without rows of
    both labels the model scores every text alike.
    """
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).filter("i IS NOT NULL AND y IN (0, 1)").filter(usable(F.col("i")))
    chosen = known.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(sample)
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    # The sample's bound makes it small enough to send everywhere.
    learning = cut(texts.join(F.broadcast(chosen), "i").groupBy("i", "y").agg(F.min("t").alias("t")).select("y", "t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = Counter(), Counter()
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = features_of(words_of(t))
                seen.update(found)
                if y:
                    toxic.update(found)
        names = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[x] for x in names], pa.int64()), pa.array([toxic[x] for x in names], pa.int64())], names=["f", "n", "k"])

    rows, toxic = learning.agg(F.count("y"), F.sum("y")).first()
    if not rows or not toxic or toxic == rows:
        share = (toxic or 0) / rows if rows else 0.0
        return Model({}, math.log((share + 1e-6) / (1 - share + 1e-6)))
    rate = toxic / rows
    off = F.abs(F.col("k") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))
    counted = learning.mapInArrow(count, "f string, n long, k long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # Bounded by the sample's words.
    strong = {r["f"] for r in counted.filter((F.col("n") >= SEEN) & (off >= DEVIATION)).select("f").collect()}
    named = features_of({w for kind in kinds for name in kind for t in TEMPLATES for w in words_of(t.format(name))}) if kinds else set()
    index = {f: k for k, f in enumerate(sorted(strong | named))}

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = lambda words: {index[x] for x in features_of(words) & index.keys()}
        for batch in batches:
            own, pairs = [], []
            for t in batch.column(1).to_pylist():
                own.append(sorted(find(words_of(t))))
                both = [(find(a), find(b)) for a, b in counterfactuals(t, kinds)]
                pairs.append([[*(c + 1 for c in sorted(a - b)), *(-c - 1 for c in sorted(b - a))] for a, b in both])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32())), pa.array(pairs, pa.list_(pa.list_(pa.int32())))], names=["y", "x", "d"])

    # Bounded by the sample: a list of features and of differences for each of its rows.
    data = sorted((r["y"], r["x"], r["d"]) for r in learning.mapInArrow(indexed, "y int, x array<int>, d array<array<int>>").collect())
    weights, intercept = fit(data, len(index))
    return Model({f: float(weights[k]) for f, k in index.items() if weights[k]}, float(intercept), sum(len(d) for _, _, d in data))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, score (0 to 1), predicted (1 if score >= 0.5).

    Whole texts are scored and nothing else of a row is read. A null text counts as
    empty, and an empty text has the score of a text without any known feature. Null ids,
    repeated rows and an empty table pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            found = [model.score(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["i", "score"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    return rows.mapInArrow(run, f"i {kind}, score double").select(F.col("i").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, text_col: str = "text", below: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores less than ``below``.

    Cases as for ``score``; rows are not moved between partitions.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, at):
            yield batch.filter(pa.array([model.score(t or "") < below for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
