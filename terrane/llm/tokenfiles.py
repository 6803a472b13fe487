"""Token-id files in patched frame-of-reference blocks.

Segment format (little-endian), one segment per row of the written table, in ascending id order over the files:

    magic "TPF1" | u32 values | u32 values per block | u32 blocks | u32 start of each block, from the first block on
    per block: u32 minimum | u8 width | u8 0 | u16 exceptions | u16 positions of the exceptions | u32 their values
               | packed values of ``width`` bits, in 64-bit words

A block's values are stored less its minimum. Its width is the cheapest of those that hold the values at a few
percentiles of the block; values that need more bits are exceptions: stored whole in the list, 0 in the packed part.
The block starts allow a block to be read by itself (``read_block``).

Defined cases: null text counts as empty; an empty document is its end id alone; rows with equal ids follow each other,
ordered by text; a null id comes first and is returned as null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm import tokens
from terrane.session import scratch_path

MAGIC = b"TPF1"
BLOCK = 1024
PERCENTILES = (50, 75, 90, 95, 98, 99, 100)
SEGMENT = "part int, seg int, part_start long, n_docs long, n_tokens long, doc_ids binary, null_ids binary, doc_lengths binary, payload binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``values`` (a multiple of 64 columns, each below 2**width) as rows of 64-bit words."""
    rows, cols = values.shape
    lanes = np.ascontiguousarray(values.reshape(rows * cols // 64, 64).T).astype(np.uint64)
    out = np.zeros((width, lanes.shape[1]), np.uint64)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        out[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(rows, -1)


def unpack_bits(words: np.ndarray, width: int, cols: int) -> np.ndarray:
    """The inverse of ``pack_bits``."""
    rows = words.shape[0]
    if not width:
        return np.zeros((rows, cols), np.uint32)
    lanes = np.ascontiguousarray(words.reshape(rows * cols // 64, width).T)
    out, mask = np.empty((64, lanes.shape[1]), np.uint32), np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        x = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (lanes[word + 1] << np.uint64(64 - shift))
        out[j] = x & mask
    return np.ascontiguousarray(out.T).reshape(rows, cols)


def encode_values(values: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment of unsigned 32-bit values."""
    n = len(values)
    blocks = -(-n // block)
    padded = np.empty(blocks * block, np.uint32)
    padded[:n] = values
    padded[n:] = values[-1] if n else 0
    padded = padded.reshape(blocks, block)
    if not n:
        return MAGIC + struct.pack("<III", 0, block, 0)
    low = padded.min(axis=1)
    rest = padded - low[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    counts = np.bincount((bits + np.arange(blocks)[:, None] * 33).ravel(), minlength=blocks * 33).reshape(blocks, 33)
    below = counts.cumsum(axis=1)
    cost = np.arange(33) * block + (block - below) * 48
    allowed = np.zeros((blocks, 33), bool)
    for p in PERCENTILES:
        allowed[np.arange(blocks), (below >= block * p / 100).argmax(axis=1)] = True
    width = np.where(allowed, cost, 1 << 60).argmin(axis=1)
    outlier = bits > width[:, None]
    packed: list[bytes] = [b""] * blocks
    small = np.where(outlier, 0, rest)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        words = pack_bits(small[at], int(w))
        for k, row in zip(at.tolist(), words, strict=True):
            packed[k] = row.tobytes()
    where = np.nonzero(outlier)
    firsts = np.searchsorted(where[0], np.arange(blocks + 1))
    positions, excess = where[1].astype("<u2"), rest[where].astype("<u4")
    body, starts, at = [], [], 0
    for k in range(blocks):
        a, b = int(firsts[k]), int(firsts[k + 1])
        part = struct.pack("<IBBH", int(low[k]), int(width[k]), 0, b - a) + positions[a:b].tobytes() + excess[a:b].tobytes() + packed[k]
        starts.append(at)
        at += len(part)
        body.append(part)
    return MAGIC + struct.pack("<III", n, block, blocks) + np.array(starts, "<u4").tobytes() + b"".join(body)


def _header(blob: bytes) -> tuple[int, int, int, np.ndarray, int]:
    if bytes(blob[:4]) != MAGIC:
        raise ValueError("not a token segment")
    n, block, blocks = struct.unpack_from("<III", blob, 4)
    return n, block, blocks, np.frombuffer(blob, "<u4", blocks, 16), 16 + 4 * blocks


def _block_parts(blob: bytes, at: int) -> tuple[int, int, np.ndarray, np.ndarray, int]:
    low, width, _, exceptions = struct.unpack_from("<IBBH", blob, at)
    positions = np.frombuffer(blob, "<u2", exceptions, at + 8)
    values = np.frombuffer(blob, "<u4", exceptions, at + 8 + 2 * exceptions)
    return low, width, positions, values, at + 8 + 6 * exceptions


def read_block(blob: bytes, k: int) -> np.ndarray:
    """Block ``k`` of a segment, found by the index alone."""
    n, block, blocks, starts, base = _header(blob)
    if not 0 <= k < blocks:
        raise IndexError(k)
    low, width, positions, values, at = _block_parts(blob, base + int(starts[k]))
    out = unpack_bits(np.frombuffer(blob, "<u8", width * block // 64, at).reshape(1, -1), width, block)[0]
    out[positions] = values
    return (out + np.uint32(low))[: min(block, n - k * block)]


def decode_values(blob: bytes) -> np.ndarray:
    """All values of a segment."""
    n, block, blocks, starts, base = _header(blob)
    out = np.zeros((blocks, block), np.uint32)
    parts = [_block_parts(blob, base + int(s)) for s in starts]
    width = np.array([p[1] for p in parts])
    for w in np.unique(width) if blocks else ():
        at = np.flatnonzero(width == w)
        words = np.stack([np.frombuffer(blob, "<u8", int(w) * block // 64, parts[k][4]) for k in at.tolist()])
        out[at] = unpack_bits(words, int(w), block)
    for k, (low, _, positions, values, _) in enumerate(parts):
        out[k, positions] = values
        out[k] += np.uint32(low)
    return out.ravel()[:n]


def write(
    docs: DataFrame,
    vocabulary_path: str,
    end_id: int,
    path: str,
    style: str = "byte",
    segment_tokens: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Tokenize ``docs`` and write the segments under ``path``, ids ascending over parts and within a part.

    The text is dealt out once, by ranges of the id; a task holds ``segment_tokens`` ids and one batch of texts.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, part = tokens.encoder(vocabulary_path, style).encode, TaskContext.get().partitionId()
        doc_ids, held, size, seg, before = [], [], 0, 0, 0

        def segment() -> pd.DataFrame:
            nulls = np.array([x is None for x in doc_ids], np.uint32)
            row = {
                "part": part, "seg": seg, "part_start": before, "n_docs": len(held), "n_tokens": size,
                "doc_ids": np.array([x or 0 for x in doc_ids], "<i8").tobytes(), "null_ids": encode_values(nulls),
                "doc_lengths": encode_values(np.array([len(x) // 4 for x in held], np.uint32)),
                "payload": encode_values(np.frombuffer(b"".join(held), "<u4")),
            }
            return pd.DataFrame([row])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64").tolist(), batch["text"].tolist(), strict=True):
                doc_ids.append(None if doc_id is pd.NA else doc_id)
                held.append((encode(text) if text else b"") + end)
                size += len(held[-1]) // 4
                if size >= segment_tokens:
                    yield segment()
                    doc_ids, held, seg, before, size = [], [], seg + 1, before + size, 0
        if held:
            yield segment()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInPandas(run, SEGMENT).write.option("compression", "none").parquet(path)


def read(spark, path: str) -> DataFrame:
    """One row per document of the written files: id, ids of all documents before it, its ids' number and CRC-32.

    Only the totals by part (as many rows as the writing had tasks) are brought together and broadcast.
    """
    segments = spark.read.parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, lengths = decode_values(r.payload), decode_values(r.doc_lengths).astype(np.int64)
                ends = lengths.cumsum()
                data = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
                doc_ids = pd.array(np.frombuffer(r.doc_ids, "<i8").copy(), dtype="Int64")
                doc_ids[decode_values(r.null_ids) == 1] = pd.NA
                yield pd.DataFrame({"doc_id": doc_ids, "start": r.base + r.part_start + ends - lengths, "n_tokens": lengths, "ids_crc32": np.array(crcs, np.int64)})

    placed = segments.join(F.broadcast(bases), "part").select("base", "part_start", "doc_ids", "null_ids", "doc_lengths", "payload")
    return placed.mapInPandas(run, RESULT)


def round_trip(docs: DataFrame, vocabulary_path: str, end_id: int, style: str = "byte") -> DataFrame:
    """Write the files to the shared folder and read them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write(docs, vocabulary_path, end_id, path, style)
    return read(spark, path)
