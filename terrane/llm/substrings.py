"""Removal of repeated word windows, by Rabin-Karp hashes of every window, counted in Spark.

1. Documents are stored once, in chunks of up to ``chunk_words`` words: a chunk is one row with its texts compressed, so
   every later step sees the same chunks, however often an executor is lost.
2. Each chunk hashes all its windows: prefix sums of word hashes times powers of an odd base give the polynomial hash of
   every window at once, for two bases. A chunk's distinct windows are dealt into groups by
   ranges of one hash; a group's part is one row of the other hash of each and its least document id, packed.
3. A task works through one group: windows that several chunks hold are found by sorting, and each chunk gets back one bit
   for each of its windows, set where the window starts earlier elsewhere. What a chunk repeats itself, it knows.
4. Bits and chunks meet again, and windows with a bit merge into maximal intervals of words.

The number of groups follows the number of windows (``group_windows`` in each), so a group fits in a task at every size,
and a window that every document holds is one entry of each chunk. A row of step 2 holds about ``chunk_words *
group_windows / windows of the corpus`` entries; beyond some terabytes of text both should be raised together. Windows
are told apart by 64 bits and their group's number, which grows with the corpus: among 10^13 windows a false repeat is
expected less than once (within a chunk 128 bits are compared).

Defined cases: a null, empty or blank text has no words, and one of fewer words than a window loses none; null ids come
after all others; rows of one id are documents of their own, the earlier being the one that was stored first, so of
repeated rows one keeps its words; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.batches import written

#: Odd bases of the two hashes; both are 5 modulo 8, for which differences of powers keep all but a few low bits.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_LAST = np.iinfo(np.int64).max
_CHUNKS = "chunk long, n_windows long, doc_ids binary, blank binary, sizes binary, texts binary"
_RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"


def word_hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    """64-bit hashes of n words; as fast without a memory of words, a fifth of which are new in most texts."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(hashed: np.ndarray, window: int) -> np.ndarray:
    """Two Rabin-Karp hashes of each window of ``window`` words, in two rows, the second over the words' mixed hashes.

    With prefix sums S of w[k] * b**-k, the hash of the window from i on is (S[i + window] - S[i]) * b**i.
    """
    n = len(hashed) - window + 1
    if n <= 0:
        return np.empty((2, 0), np.uint64)
    out = np.empty((2, n), np.uint64)
    for k, (base, values) in enumerate(zip(_BASES, (hashed, mix(hashed)), strict=True)):
        sums = np.zeros(len(hashed) + 1, np.uint64)
        np.cumsum(values * powers(pow(base, -1, 1 << 64), len(hashed)), out=sums[1:])
        out[k] = mix((sums[window:] - sums[:-window]) * powers(base, n))
    return out


def merged(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The maximal intervals that windows from these ascending starts cover, ends exclusive; touching ones are one."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window)
    first, last = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]
    return list(zip(first.tolist(), (last + window).tolist(), strict=True))


class Chunk:
    """The windows of a chunk's documents, taken in the order of their ids."""

    def __init__(self, doc_ids: np.ndarray, blank: np.ndarray, texts: list[bytes], window: int):
        order = np.lexsort((np.arange(len(doc_ids)), doc_ids))
        self.doc_ids, self.blank, self.window = doc_ids[order], blank[order], window
        self.words = [texts[d].split() for d in order.tolist()]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.bounds = np.concatenate([[0], sizes.cumsum()])
        n = int(self.bounds[-1])
        rank = np.repeat(np.arange(len(sizes)), sizes)
        # all words stand in one row; windows that reach into the next document are none
        self.at = np.flatnonzero(rank[: max(0, n - window + 1)] == rank[window - 1 :])
        self.hashes = window_hashes(word_hashes(itertools.chain.from_iterable(self.words), n), window)[:, self.at]
        self.rank = rank[self.at]

    def dealt(self, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first windows of each hash in the order of one of the hashes, the bounds of the groups that have some, and
        the numbers of those groups: a group is a range of that hash."""
        key = self.hashes[1]
        if not len(key):
            return np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.int64)
        order = np.argsort(key)
        k, other = key[order], self.hashes[0][order]
        new = np.ones(len(order), bool)
        new[1:] = k[1:] != k[:-1]
        if (other[1:] != other[:-1])[~new[1:]].any():  # one hash is equal and the other is not: nearly never
            order = np.lexsort((self.hashes[0], key))
            k, other = key[order], self.hashes[0][order]
            new[1:] = (k[1:] != k[:-1]) | (other[1:] != other[:-1])
        starts = np.flatnonzero(new)
        first = np.minimum.reduceat(order, starts)  # of equal windows the earliest
        group = (((k[starts] >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        return first, np.append(cuts, len(first)), group[cuts]

    def results(self, groups: int, bits: dict[int, bytes]) -> Iterator[tuple]:
        """A row for each document, ``bits`` telling by group which windows start earlier in other chunks."""
        first, bounds, numbers = self.dealt(groups)
        removed = np.ones(self.hashes.shape[1], bool)
        # a window whose hash came before in this chunk goes in any case, the first of them if another chunk has it earlier
        removed[first] = False
        for k, g in enumerate(numbers.tolist()):
            if g in bits:
                part = first[bounds[k] : bounds[k + 1]]
                removed[part] = np.unpackbits(np.frombuffer(bits[g], np.uint8), count=len(part)).view(bool)
        gone = np.zeros(int(self.bounds[-1]), bool)
        gone[self.at[removed]] = True
        for d, words in enumerate(self.words):
            spans = merged(np.flatnonzero(gone[self.bounds[d] : self.bounds[d + 1]]), self.window)
            left, at = [], 0
            for s, e in spans:
                left += words[at:s]
                at = e
            left += words[at:]
            intervals = [{"start": s, "end": e} for s, e in spans]
            yield (None if self.blank[d] else int(self.doc_ids[d]), len(words), len(words) - len(left), intervals, b" ".join(left).decode("utf-8"))


def _stored(texts: list[bytes]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(texts))


def _opened(row, window: int) -> Chunk:
    import zstandard

    joined = zstandard.ZstdDecompressor().decompress(bytes(row.texts))
    ends = np.frombuffer(row.sizes, np.int64).cumsum()
    texts = [joined[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    return Chunk(np.frombuffer(row.doc_ids, np.int64), np.frombuffer(row.blank, bool), texts, window)


def chunked(docs: DataFrame, window: int, chunk_words: int, id_col: str, text_col: str) -> DataFrame:
    """One row per chunk: its documents' ids, sizes and texts. A document is never cut."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        ids, texts, words, windows = [], [], 0, 0

        def row() -> pd.DataFrame:
            blank = np.array([x is None for x in ids], bool)
            numbers = np.array([_LAST if x is None else x for x in ids], np.int64)
            sizes = np.array([len(t) for t in texts], np.int64)
            return pd.DataFrame([(number, windows, numbers.tobytes(), blank.tobytes(), sizes.tobytes(), _stored(texts))], columns=["chunk", "n_windows", "doc_ids", "blank", "sizes", "texts"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                blob = text.encode("utf-8") if isinstance(text, str) else b""
                n = len(blob.split())
                if texts and words + n > chunk_words:
                    yield row()
                    number, words, windows = number + 1, 0, 0
                    ids.clear()
                    texts.clear()
                ids.append(int(doc_id) if doc_id is not None else None)
                texts.append(blob)
                words, windows = words + n, windows + max(0, n - window + 1)
        if texts:
            yield row()

    # ids go as text: as numbers a column with nulls would come as floats
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, _CHUNKS)


def packed(values: np.ndarray, most: int) -> bytes:
    """Numbers up to ``most``: a byte each, and a bit for every further binary digit."""
    planes = [np.packbits((values >> b & 1).astype(bool)).tobytes() for b in range(8, max(8, most.bit_length()))]
    return values.astype(np.uint8).tobytes() + b"".join(planes)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    """The n numbers of ``packed``."""
    out, size = np.frombuffer(blob[:n], np.uint8).astype(np.int64), (n + 7) // 8
    for b, at in enumerate(range(n, len(blob), size), 8):
        out |= np.unpackbits(np.frombuffer(blob[at : at + size], np.uint8), count=n).astype(np.int64) << b
    return out


def dealt_windows(chunks: DataFrame, window: int, groups: int) -> DataFrame:
    """(grp, chunk, hashes, ids, which): a chunk's distinct windows of a group, and the document of each: its place among
    those that the group meets, whose ids ascend."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                chunk = _opened(r, window)
                first, bounds, numbers = chunk.dealt(groups)
                ranks, hashes, rows = chunk.rank[first], chunk.hashes[0][first], []
                for g, s, e in zip(numbers.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    there = np.zeros(len(chunk.doc_ids), bool)
                    there[ranks[s:e]] = True
                    known, which = chunk.doc_ids[there], (there.cumsum() - 1)[ranks[s:e]]
                    rows.append((g, r.chunk, hashes[s:e].tobytes(), zlib.compress(np.diff(known, prepend=0).tobytes(), 1), packed(which, len(known) - 1)))
                yield pd.DataFrame(rows, columns=["grp", "chunk", "hashes", "ids", "which"])

    return chunks.mapInPandas(run, "grp long, chunk long, hashes binary, ids binary, which binary")


def earlier_elsewhere(dealt: DataFrame) -> DataFrame:
    """(chunk, grp, bits): the windows of a chunk and group that another chunk has in an earlier document.

    Of documents with one id the one in the lower chunk is the earlier. Chunks without such windows have no row.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sizes = np.array([len(x) // 8 for x in group["hashes"]], np.int64)
        hashes = np.frombuffer(b"".join(group["hashes"]), np.uint64)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        often = np.zeros(len(order), bool)
        often[1:] |= same
        often[:-1] |= same
        some = order[often]  # only windows whose hash occurs again are looked at further
        ids = []
        for n, known, which in zip(sizes.tolist(), group["ids"], group["which"], strict=True):
            ids.append(np.frombuffer(zlib.decompress(known), np.int64).cumsum()[unpacked(which, n)])
        row = np.repeat(np.arange(len(sizes)), sizes)[some]
        ids, chunk = np.concatenate(ids)[some], group["chunk"].to_numpy()[row]
        turn = np.lexsort((chunk, ids, hashes[some]))
        a = hashes[some][turn]
        later = np.zeros(len(turn), bool)
        later[1:] = a[1:] == a[:-1]
        flags = np.zeros(len(order), bool)
        flags[some[turn[later]]] = True
        bounds, out = np.concatenate([[0], sizes.cumsum()]).tolist(), []
        for k, number in enumerate(group["chunk"].tolist()):
            part = flags[bounds[k] : bounds[k + 1]]
            if part.any():
                out.append((number, int(group["grp"].iloc[0]), np.packbits(part).tobytes()))
        return pd.DataFrame(out, columns=["chunk", "grp", "bits"])

    return dealt.groupBy("grp").applyInPandas(run, "chunk long, grp long, bits binary")


def without_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = 250_000, group_windows: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (removed intervals of words, ends exclusive) and kept_text
    (the words left, joined by one blank).

    A word goes where a window of ``window`` words that covers it starts earlier too: in a document of a lesser id, or
    earlier in the same one.
    """
    spark = docs.sparkSession
    chunks = written(chunked(docs, window, chunk_words, id_col, text_col), "chunks")
    windows = chunks.agg(F.sum("n_windows")).first()[0] or 0
    least = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(least, -(-windows // group_windows))
    # a chunk's row holds many words: few of them go to a worker at once
    found = written(earlier_elsewhere(dealt_windows(chunks, window, groups)), "repeats", rows=8)
    bits = found.groupBy("chunk").agg(F.collect_list(F.struct("grp", "bits")).alias("bits")).select("chunk", "bits.grp", "bits.bits")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                flags = dict(zip(map(int, r.grp), map(bytes, r.bits), strict=True)) if r.grp is not None else {}
                rows = pd.DataFrame(list(_opened(r, window).results(groups, flags)), columns=["doc_id", "n_words", "n_removed", "spans", "kept_text"])
                rows["doc_id"] = rows["doc_id"].astype("Int64")
                yield rows

    return chunks.join(bits, "chunk", "left").mapInPandas(run, _RESULT)


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of the rows of ``without_repeats``."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
