"""Benchmark decontamination by winnowing.

Words are mapped to the numbers they have in the benchmark (others break every window). Of each run of ``window - k + 1``
consecutive k-grams the least hash is kept (the rightmost of equals), in documents and benchmark items alike, so any
shared span of ``window`` words shares a kept fingerprint. A document's fingerprints are looked up among those of the
benchmark, and around each hit every window that holds the fingerprint is compared word for word. Items of fewer words
than ``window`` are one window of their own length, whose only k-gram is the window itself.

The benchmark is taken in blocks of at most ``block_words`` words; each block's index is broadcast (its size is bounded
by that parameter) and documents pass through one step per block where they lie, so nothing is shuffled and a passage
that a third of the documents share costs no more than any other.

Defined cases: null or empty texts have no words and no hits; items without words never occur; equal item ids count
once; repeated documents are judged row by row; ties and extra columns have no influence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Bytes of a word: digits, lower-case letters and all of a character beyond ASCII; capitals are lowered.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_WORD_BYTES).split() if text else []


def rolling_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k ids from each position on; the greatest value where one of them is 0."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, mixed = np.zeros(n, np.uint64), ids.astype(np.uint64) * _MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    zeros = np.concatenate([[0], (ids == 0).cumsum()])
    for j in range(k):
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out += mixed[j : j + n]
        out ^= out >> np.uint64(31)
    out[zeros[k:] != zeros[:-k]] = _NONE
    return out


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least hash of each w consecutive ones, the rightmost of equals."""
    n = len(hashes) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, w):
        lower = hashes[j : j + n] <= best
        best[lower] = hashes[j : j + n][lower]
        at[lower] = np.flatnonzero(lower) + j
    at = at[best != _NONE]
    return np.unique(at)


class WindowIndex:
    """The distinct windows of one length, with the items that hold them, and their fingerprints."""

    def __init__(self, length: int, k: int, rows: np.ndarray, owner: np.ndarray, fingerprints: np.ndarray):
        self.length, self.k = length, k
        self.fingerprints = np.unique(fingerprints)
        windows, which = np.unique(rows, axis=0, return_inverse=True)
        hashes = np.array([rolling_hashes(r, length)[0] for r in windows], np.uint64) if len(windows) else np.empty(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.windows = hashes[order], windows[order]
        # windows that share a 64-bit hash lie next to each other
        self.most = int(np.unique(hashes, return_counts=True)[1].max(initial=1))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pairs = np.unique(np.stack([rank[which.ravel()], owner], axis=1), axis=0)
        self.item_starts = np.searchsorted(pairs[:, 0], np.arange(len(order) + 1))
        self.items = pairs[:, 1]

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``ids`` where a window starts, and the windows' numbers."""
        none = np.empty(0, np.int64)
        hashes = rolling_hashes(ids, self.k)
        kept = winnow(hashes, self.length - self.k + 1)
        kept = kept[np.isin(hashes[kept], self.fingerprints)]
        if not len(kept):
            return none, none
        starts = np.unique((kept[:, None] - np.arange(self.length - self.k + 1)).ravel())
        starts = starts[(starts >= 0) & (starts + self.length <= len(ids))]
        rows = ids[starts[:, None] + np.arange(self.length)]
        hashed = np.zeros(len(starts), np.uint64)
        for j in range(self.length):
            mixed = rows[:, j].astype(np.uint64) * _MULTIPLIER
            hashed = hashed * np.uint64(0xBF58476D1CE4E5B9) + (mixed ^ (mixed >> np.uint64(29)))
            hashed ^= hashed >> np.uint64(31)
        first, found = np.searchsorted(self.hashes, hashed), []
        for j in range(self.most):
            at = (first + j).clip(max=len(self.hashes) - 1)
            same = (self.windows[at] == rows).all(axis=1)
            found.append((starts[same], at[same]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class BlockIndex:
    """A block of benchmark items, ready to be looked up."""

    def __init__(self, items: list[tuple[object, str | None]], window: int, k: int):
        self.vocabulary: dict[bytes, int] = {}
        self.item_ids = [i for i, _ in items]
        numbered = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(t)], np.uint32) for _, t in items]
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for n, ids in enumerate(numbered):
            if len(ids):
                by_length.setdefault(min(len(ids), window), []).append((n, ids))
        self.indexes = []
        for length, held in sorted(by_length.items()):
            kk = k if length == window else length
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, length) for _, ids in held])
            owner = np.concatenate([np.full(len(ids) - length + 1, n) for n, ids in held])
            prints = []
            for _, ids in held:
                hashes = rolling_hashes(ids, kk)
                prints.append(hashes[winnow(hashes, length - kk + 1)])
            self.indexes.append(WindowIndex(length, kk, rows, owner, np.concatenate(prints)))
        self.shortest = min((x.length for x in self.indexes), default=0)

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list]]:
        """Per text: words, merged spans of hit words (end exclusive) and the ids of the items found."""
        return [found for k in range(0, len(texts), 500) for found in self._scan(texts[k : k + 500])]

    def _scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list]]:
        get = self.vocabulary.get
        split = [words(t) for t in texts]
        lengths = np.array([len(w) for w in split], np.int64)
        ids = np.zeros(int(lengths.sum()) + len(split), np.uint32)
        bounds = np.concatenate([[0], (lengths + 1).cumsum()])
        for start, ws in zip(bounds.tolist(), split, strict=False):
            if ws:
                ids[start : start + len(ws)] = [get(w, 0) for w in ws]
        out: list[tuple[int, list[tuple[int, int]], list]] = [(int(n), [], []) for n in lengths]
        if not self.indexes or not len(ids):
            return out
        # only runs of known words that a window fits in are looked at further
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids != 0, [False]]).astype(np.int8)))
        runs = edges.reshape(-1, 2)
        runs = runs[runs[:, 1] - runs[:, 0] >= self.shortest]
        if not len(runs):
            return out
        sizes = runs[:, 1] - runs[:, 0]
        ends = (sizes + 1).cumsum()
        origin = np.arange(ends[-1]) + np.repeat(runs[:, 0] - (ends - sizes - 1), sizes + 1)
        dense = ids[origin]
        dense[ends - 1] = 0
        spans, found = [], []
        for index in self.indexes:
            starts, which = index.find(dense)
            if len(starts):
                spans.append(np.stack([origin[starts], origin[starts] + index.length], axis=1))
                doc = np.searchsorted(bounds, origin[starts], side="right") - 1
                uses = np.unique(np.stack([doc, which], axis=1), axis=0)
                for d, x in uses.tolist():
                    found.extend((d, int(n)) for n in index.items[index.item_starts[x] : index.item_starts[x + 1]])
        if spans:
            every = np.concatenate(spans)
            every = every[np.lexsort((every[:, 1], every[:, 0]))]
            for d, a, b in zip((np.searchsorted(bounds, every[:, 0], side="right") - 1).tolist(), every[:, 0].tolist(), every[:, 1].tolist(), strict=True):
                held = out[d][1]
                a, b = a - int(bounds[d]), b - int(bounds[d])
                if held and a <= held[-1][1]:
                    held[-1] = (held[-1][0], max(held[-1][1], b))
                else:
                    held.append((a, b))
            for d, n in sorted(set(found)):
                out[d][2].append(self.item_ids[n])
        return out


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[object, str | None]]]:
    """Whole items, in blocks whose characters are at most twice ``block_words`` (an item is never cut)."""
    block, size = [], 0
    for r in items.toLocalIterator():
        n = len(r["text"] or "")
        if block and size + n > 2 * block_words:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    yield block


SPANS = ArrayType(StructType([StructField("start", LongType(), False), StructField("end", LongType(), False)]), False)


def _shared(docs: DataFrame, items: DataFrame, window: int, k: int, block_words: int) -> list:
    """The benchmark as broadcast blocks, each of a bounded size."""
    return [docs.sparkSession.sparkContext.broadcast(BlockIndex(b, window, k)) for b in _blocks(items.select("item_id", "text"), block_words)]


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 6, block_words: int = 500_000, text_col: str = "text", into: str = "contamination") -> DataFrame:
    """``docs`` with the struct column ``into``, in place of any of that name: n_words, spans (hit words) and items (ids as
    text). Only the text passes through Python, once for all blocks."""
    blocks = _shared(docs, items, window, k, block_words)

    @F.pandas_udf(StructType([StructField("n_words", LongType()), StructField("spans", SPANS), StructField("items", ArrayType(StringType()))]))
    def find(column: pd.Series) -> pd.DataFrame:
        texts = [t if isinstance(t, str) else None for t in column.tolist()]
        ns, spans, names = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
        for block in blocks:
            for d, (n, hit, ids) in enumerate(block.value.scan(texts)):
                ns[d] = n
                spans[d] += hit
                names[d].update(str(i) for i in ids if i is not None)
        return pd.DataFrame({"n_words": ns, "spans": [[{"start": a, "end": b} for a, b in merge(x)] for x in spans], "items": [sorted(x) for x in names]})

    return docs.withColumn(into, find(F.col(text_col)))


def flagged(docs: DataFrame, items: DataFrame, into: str, window: int = 10, k: int = 6, block_words: int = 500_000, text_col: str = "text") -> DataFrame:
    """``docs`` with the boolean column ``into``, in place of any of that name: some window of an item occurs."""
    blocks = _shared(docs, items, window, k, block_words)

    @F.pandas_udf("boolean")
    def hit(column: pd.Series) -> pd.Series:
        texts = [t if isinstance(t, str) else None for t in column.tolist()]
        found = np.zeros(len(texts), bool)
        for block in blocks:
            found |= np.array([bool(spans) for _, spans, _ in block.value.scan(texts)], bool)
        return pd.Series(found)

    return docs.withColumn(into, hit(F.col(text_col)))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def digest(found: DataFrame, into: str = "contamination") -> DataFrame:
    """The summary columns of ``find_contamination``'s result."""
    spans, names = F.col(into)["spans"], F.col(into)["items"]
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id",
        F.col(into)["n_words"].alias("n_words"),
        hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(names)), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def digest_of(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()
