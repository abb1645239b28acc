"""Token counts by rank-synchronous array merging, and token ids through the library.

Texts are cut at ASCII white space, where the word tokenizer never joins tokens, and
each distinct chunk is worked out once and remembered in a bounded table. A hash finds a
chunk there and its bytes confirm it.

Counting holds the pre-tokens of all new chunks as one ragged array of symbols. In every
round each pre-token finds its pair of lowest rank and merges all its occurrences at
once, left to right; pre-tokens without a mergeable pair are done. A merge only makes
pairs of higher rank, so a round equals the library's single steps. A round costs what is
left of the pre-token, so in a very long one (thousands of letters without a space) the
rounds find the places of their rank in a queue instead, and all rounds together cost some
n log n.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded
from .word_hashes import Words, located, text_buffer

#: Chunks, and ids of chunks, that a worker's table holds before it starts anew.
REMEMBERED, REMEMBERED_IDS = 400_000, 8_000_000
#: Symbols from which a pre-token is merged by a queue of ranks, not in arrays.
LONG = 2_000
_NONE = np.iinfo(np.int32).max
_LATIN = "\u024f"
_MARKS = frozenset(".,;:!?")
#: What the library's patterns mean by white space, to stand in a character class.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [chr(hidden.get(b, b)) for b in range(256)]


def _normal(text: str) -> str:
    """Composed, and lower-cased character by character, without the rule for a final sigma."""
    text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


class PairTable:
    """Ranks by pair, in an open table that answers whole arrays at once."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        rank = np.arange(len(keys))
        at = self._slot(keys)
        while len(rank):
            free = self.keys[at] < 0
            _, first = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[at[placed]], self.ranks[at[placed]] = keys[rank[placed]], rank[placed]
            left = np.ones(len(rank), bool)
            left[placed] = False
            rank, at = rank[left], (at[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair, or a number above all ranks."""
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], _NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.keys) - 1)
            found, wanted = self.keys[at], keys[open_]
            hit = found == wanted
            out[open_[hit]] = self.ranks[at[hit]]
            go = ~hit & (found >= 0)
            open_, at = open_[go], at[go]
        return out


class MergeCounter:
    """Counts the tokens of chunks of text for a byte-level BPE file with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.width = max(vocab.values()) + 1
        keys = left * self.width + right
        self.keys, self.rank_of = keys, {}
        self.pairs = PairTable(keys)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {c: b for b, c in enumerate(letters)}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", _WHITE))
        self.apart = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))

    def _pieces(self, text: str) -> list[bytes]:
        if text.isascii() or max(text) <= _LATIN:
            text = text.lower() if text.isascii() else _normal(text)
            # Most chunks are a word, or a word and a mark: the pattern would find the same.
            if text.isalpha():
                return [text.encode()]
            if text[-1:] in _MARKS and text[:-1].isalpha():
                return [text[:-1].encode(), text[-1].encode()]
            return [x.encode() for x in self.pieces.findall(text)]
        # The library's own tables know which code points of other scripts are letters.
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes.__getitem__, x)) for x, _ in found]

    def pre_tokens(self, chunk: str) -> list[bytes | int]:
        """UTF-8 pre-tokens, and the ids of special tokens that stand among them."""
        if "<|" not in chunk:
            return self._pieces(chunk)
        out, at = [], 0
        for m in self.apart.finditer(chunk):
            out += [*self._pieces(chunk[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self._pieces(chunk[at:])

    def merge_long(self, pre: bytes) -> list[int]:
        """The symbols that survive in one long pre-token: ranks in rising order, each merged
        at all its places from the left, and new pairs put under their own rank."""
        if not self.rank_of:
            self.rank_of = {k: r for r, k in enumerate(self.keys.tolist())}
        data = np.frombuffer(pre, np.uint8)
        symbols = [*self.first[data[:-1]].tolist(), int(self.last[data[-1]])]
        n, width, rank_of = len(symbols), self.width, self.rank_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = {}
        queue: list[int] = []

        def put(k: int) -> None:
            rank = rank_of.get(symbols[k] * width + symbols[after[k]])
            if rank is not None:
                if rank not in places:
                    places[rank] = []
                    heapq.heappush(queue, rank)
                places[rank].append(k)

        for k in range(n - 1):
            put(k)
        while queue:
            rank = heapq.heappop(queue)
            key, made = int(self.keys[rank]), int(self.made[rank])
            for k in sorted(places.pop(rank)):
                nxt = after[k]
                if symbols[k] < 0 or nxt >= n or symbols[k] * width + symbols[nxt] != key:
                    continue  # one of the two has been merged since
                symbols[k], symbols[nxt] = made, -1
                after[k] = after[nxt]
                if after[k] < n:
                    before[after[k]] = k
                    put(k)
                if before[k] >= 0:
                    put(before[k])
        return [x for x in symbols if x >= 0]

    def merge(self, pre: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that survive all merges, end to end, and how many each pre-token has."""
        long = {k: self.merge_long(x) for k, x in enumerate(pre) if len(x) >= LONG}
        if not long:
            return self._merge(pre)
        ids, sizes = self._merge([x for k, x in enumerate(pre) if k not in long])
        rest = iter(np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else ())
        parts = [np.array(long[k], np.int64) if k in long else next(rest) for k in range(len(pre))]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def _merge(self, pre: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, pre), np.int64, len(pre))
        data = np.frombuffer(b"".join(pre), np.uint8)
        ends = np.cumsum(lengths) - 1
        symbols = self.first[data]
        symbols[ends] = self.last[data[ends]]
        owner = np.repeat(np.arange(len(pre)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = self.pairs.find(symbols[:-1] * self.width + symbols[1:])
            rank = np.append(np.where(owner[:-1] == owner[1:], rank, _NONE), _NONE)
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(symbols)))
            best = np.repeat(best, size)
            # Pre-tokens without a pair leave the arrays.
            open_ = best < _NONE
            done.append((owner[~open_], symbols[~open_]))
            hit = (rank == best) & open_
            # In a run of overlapping hits every second one merges, from the left.
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
            where = np.flatnonzero(hit & ((place - run) % 2 == 0))
            symbols[where] = self.made[rank[where]]
            open_[where + 1] = False
            symbols, owner = symbols[open_], owner[open_]
        if not done:
            return np.zeros(0, np.int64), lengths
        owner, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        return symbols[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(pre))

    def merged(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, end to end, and how many each chunk has."""
        split = [self.pre_tokens(c.decode()) for c in chunks]
        where: dict[bytes | int, int] = {}
        for pre in split:
            for x in pre:
                where.setdefault(x, len(where))
        words = [x for x in where if not isinstance(x, int)]
        ids, size = self.merge(words)
        at = np.cumsum(size) - size
        if len(words) < len(where):
            order = {x: k for k, x in enumerate(words)}
            fixed = [x for x in where if isinstance(x, int)]
            order |= {x: len(words) + k for k, x in enumerate(fixed)}
            at, size = np.append(at, len(ids) + np.arange(len(fixed))), np.append(size, np.ones(len(fixed), np.int64))
            ids = np.append(ids, np.array(fixed, np.int64))
            where = order
        each = np.fromiter((where[x] for pre in split for x in pre), np.int64)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        owner = np.repeat(np.arange(len(split)), counts)
        n = size[each]
        before = np.cumsum(n) - n
        flat = ids[np.repeat(at[each] - before, n) + np.arange(int(n.sum()))]
        return flat.astype(np.uint32), np.bincount(owner, weights=n, minlength=len(split)).astype(np.int64)


class Growing:
    """An array that takes more at its end; ``held[:used]`` is what it has."""

    def __init__(self, kind: type) -> None:
        self.held, self.used = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        while self.used + len(values) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.used : self.used + len(values)] = values
        self.used += len(values)


class Remembered:
    """The merged ids of chunks, found by a hash of a chunk's bytes and confirmed by the bytes.

    Chunks that meet another's hash are kept by their bytes in ``odd``.
    """

    def __init__(self, merger: MergeCounter) -> None:
        self.merger = merger
        self._anew()

    def _anew(self) -> None:
        self.hashes, self.which = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.sizes, self.lengths = (np.zeros(0, np.int64) for _ in range(3))
        self.flat, self.lanes, self.lane_at = Growing(np.uint32), Growing(np.uint64), np.zeros(1, np.int64)
        self.odd: dict[bytes, int] = {}

    def _learn(self, found: Words, body: bytes, which: np.ndarray) -> np.ndarray:
        """Places of the chunks ``which`` of a batch, worked out and put at the end."""
        begin, size = found.starts[which], found.lengths[which]
        ids, sizes = self.merger.merged([body[a:b] for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)])
        place = len(self.starts) + np.arange(len(which))
        self.starts = np.append(self.starts, self.flat.used + np.cumsum(sizes) - sizes)
        self.sizes, self.lengths = np.append(self.sizes, sizes), np.append(self.lengths, size)
        n = (size + 7) >> 3
        before = np.cumsum(n) - n
        self.lane_at = np.append(self.lane_at, self.lane_at[-1] + before + n)
        self.lanes.add(found.lanes[np.repeat(found.lane_at[which] - before, n) + np.arange(int(n.sum()))])
        self.flat.add(ids)
        return place

    def _unlike(self, found: Words, which: np.ndarray) -> np.ndarray:
        """The chunks of a batch whose bytes are not those of the places given them."""
        wrong = found.lengths != self.lengths[which]
        n = np.where(wrong, 0, np.diff(found.lane_at))
        before = np.cumsum(n) - n
        step = np.arange(int(n.sum()))
        own = found.lanes[np.repeat(found.lane_at[:-1] - before, n) + step] if wrong.any() else found.lanes
        off = np.flatnonzero(own != self.lanes.held[np.repeat(self.lane_at[which] - before, n) + step])
        if len(off):
            wrong[np.searchsorted(before + n, off, side="right")] = True
        return np.flatnonzero(wrong)

    def chunks_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The place here of every chunk of the texts, and n + 1 offsets of each text's."""
        if len(self.starts) > REMEMBERED or self.flat.used > REMEMBERED_IDS:
            self._anew()
        data, offsets = text_buffer(texts)
        found = located(data, offsets, lower=False)
        distinct, first, every = np.unique(found.hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        there = place < len(self.hashes)
        new[there] = self.hashes[place[there]] != distinct[there]
        body = b""
        if new.any():
            body = data.tobytes()
            put = self._learn(found, body, first[new])
            self.hashes, self.which = np.insert(self.hashes, place[new], distinct[new]), np.insert(self.which, place[new], put)
            place = np.searchsorted(self.hashes, distinct)
        which = self.which[place][every.reshape(-1)]
        for k in self._unlike(found, which).tolist():
            body = body or data.tobytes()
            chunk = body[found.starts[k] : found.starts[k] + found.lengths[k]]
            if chunk not in self.odd:
                self.odd[chunk] = int(self._learn(found, body, np.array([k]))[0])
            which[k] = self.odd[chunk]
        return which, found.at

    def counts(self, texts: pa.Array) -> list[int]:
        """Tokens of each text."""
        which, at = self.chunks_of(texts)
        total = np.append(0, np.cumsum(self.sizes[which]))
        return (total[at[1:]] - total[at[:-1]]).tolist()

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text as 32-bit numbers."""
        which, at = self.chunks_of(texts)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = which[a:b]
            size = self.sizes[own]
            before = np.cumsum(size) - size
            yield self.flat.held[np.repeat(self.starts[own] - before, size) + np.arange(int(size.sum()))]


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, empty for null; ``bytes.split`` then cuts at ASCII white space."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Whole texts are counted as the vocabulary file's own library gives them, without
    added tokens; special strings inside a text count as one token each. A null text is
    empty, with 0 tokens; null ids, repeated rows and an empty table pass through. Other
    columns are not read. ``path`` is the file's place on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Remembered(MergeCounter(path))
        for batch in bounded(batches, 1):
            size = np.diff(text_buffer(batch.column(1))[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(table.counts(batch.column(1)), pa.int64())], names=["i", "b", "n"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    return rows.mapInArrow(run, f"i {kind}, b long, n long").select(
        F.col("i").alias(id_col), F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit")
    )
