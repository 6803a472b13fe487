"""Sequence packing by best-fit decreasing.

Documents are tokenized where they lie and packed in groups of about ``group_tokens`` tokens, so a task holds one group
and nothing is shuffled. In a group, full windows are cut from overlong documents first; the tails, longest first, go
to the open window with the least room that still holds them, found by a segment tree indexed by remaining capacity.
Gaps of ``min_gap`` tokens or more that are left are then filled by cutting the tails of the emptiest windows, so a
group ends with at most one window that is padded (or with gaps below ``min_gap``).

Defined cases: null text counts as empty; an empty document is its end id alone; repeated rows and ids are packed each
on their own; an empty table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import tokens

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_to long"


class CapacityTree:
    """Counts of open windows by remaining capacity; ``best_fit(n)`` is the least capacity >= n that some window has."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves <= size:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        k = self.leaves + capacity
        while k:
            self.count[k] += by
            k //= 2

    def best_fit(self, need: int) -> int | None:
        k = self.leaves + need
        if self.count[k]:
            return need
        while k > 1:
            if k % 2 == 0 and self.count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.leaves
            k //= 2
        return None


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Indices of ``lengths`` (each in 1..window) by window."""
    tree, by_room, windows = CapacityTree(window), {}, []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[item]
        room = tree.best_fit(need)
        if room is None:
            k, room = len(windows), window
            windows.append([item])
        else:
            k = by_room[room].pop()
            windows[k].append(item)
            tree.add(room, -1)
        if room > need:
            by_room.setdefault(room - need, []).append(k)
            tree.add(room - need, 1)
    return windows


def padded_length(n: int, window: int) -> int:
    """A sequence whose length is a power of two stays as it is; any other is padded to the window."""
    return n if n & (n - 1) == 0 else window


def pack_group(lengths: list[int], window: int, min_gap: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold each token of each document once."""
    full = [[(d, s, window)] for d, n in enumerate(lengths) for s in range(0, n - n % window, window)]
    tails = [(d, n - n % window, n % window) for d, n in enumerate(lengths) if n % window]
    open_ = [[tails[i] for i in w] for w in best_fit_decreasing([t[2] for t in tails], window)]
    room = lambda w: window - sum(p[2] for p in w)
    open_.sort(key=room)
    done, low, high = [], 0, len(open_) - 1
    while low < high:
        gap = room(open_[low])
        if gap < min_gap:
            done.append(open_[low])
            low += 1
            continue
        source = open_[high]
        d, s, n = source.pop()
        open_[low].append((d, s, min(n, gap)))
        if n > gap:
            source.append((d, s + gap, n - gap))
        if not source:
            high -= 1
    if low == high:
        done.append(open_[low])
    return full + done


def pack(
    docs: DataFrame,
    vocabulary_path: str,
    end_id: int,
    style: str = "word",
    window: int = 4096,
    group_tokens: int = 4_000_000,
    min_gap: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece, with the columns of ``PIECES``.

    ``sequence_id`` is unique over all tasks (task number and a counter); ``sequence_tokens`` is the number of ids in
    the piece's sequence and ``padded_to`` its length with padding.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = tokens.encoder(vocabulary_path, style).encode
        next_sequence = TaskContext.get().partitionId() << 33
        held: list[tuple[object, bytes]] = []
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal next_sequence
            rows = []
            for sequence in pack_group([len(x[1]) // 4 for x in held], window, min_gap):
                total, offset = sum(p[2] for p in sequence), 0
                for d, start, n in sequence:
                    doc_id, ids = held[d]
                    rows.append((doc_id, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4, next_sequence, offset, total, padded_length(total, window)))
                    offset += n
                next_sequence += 1
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
            out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64").tolist(), batch["text"].tolist(), strict=True):
                ids = (encode(text) if text else b"") + end
                held.append((None if doc_id is pd.NA else doc_id, ids))
                size += len(ids) // 4
                if size >= group_tokens:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, PIECES)
