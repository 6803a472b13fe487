"""Vector codes by product quantization in integers, the codebooks learned by Elkan's form of Lloyd's iteration.

Each kept vector becomes integers floor(scale * x) and is cut into equal parts; each part position has a codebook that
starts as that part of the vectors of the least ids. A round assigns every part to its nearest entry (squared Euclidean
distance, ties to the lower index) and then replaces each entry by the floored mean of its parts.

What a vector carries from round to round, written beside it: its entry, an upper bound of the distance to it, and a
lower bound of the distance to *every* entry, for each part. A part is passed over whole if twice its upper bound is
below the distance of its entry to the nearest other one; else an entry is passed over if its lower bound, or half its
distance to the part's own entry, is above the upper bound (strictly: equal bounds may be a tie). For what is left the
distance is worked out in integers, so ties are decided exactly. When entries move, upper bounds grow and lower bounds
shrink by the movement.

Bounds are kept in whole steps, 1 / 32,768 of the greatest possible distance: lower ones rounded down to 16 bits, upper
ones up, each by a step more than needed, so that rounding never makes a bound wrong. They take 2 bytes an entry and part.

The driver sees codebooks and sums by entry only: parts * entries rows of dimension / parts numbers.

Defined cases: rows whose vector is null, empty or holds null or non-finite components are dropped; with fewer vectors
than entries, codebooks have as many entries as there are vectors; equal ids are ordered by their vectors, null ids come
last; equal vectors get equal codes; an entry without parts stays; extra columns are not read; an empty table gives no
rows. Vectors of unequal length, of a length that the number of parts doesn't divide, or with integers of 2**23 or more
are a ValueError.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.batches import small_batches, written
from terrane.session import release

_LIMIT = 1 << 23
_STEPS = 32_768
_STATE = "vec_id long, label string, vec binary, entry binary, upper binary, lower binary"


class Codebooks:
    """Integer entries (parts, entries, width), and the step in which bounds are measured."""

    def __init__(self, entries: np.ndarray, step: float):
        self.entries, self.step = entries, step
        gaps = np.stack([np.sqrt(squared(e, e)) for e in entries]) / step
        #: distances between entries, rounded down and less a step
        self.between = np.maximum(np.floor(gaps).astype(np.int64) - 1, 0)
        apart = self.between.copy()
        apart[:, np.arange(apart.shape[1]), np.arange(apart.shape[1])] = np.iinfo(np.int64).max
        self.nearest = apart.min(axis=2, initial=np.iinfo(np.int64).max)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def replaced(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """The codebooks with the floored means of (count, sums) by (part, entry); others stay."""
        new = self.entries.copy()
        for (part, entry), (n, total) in sums.items():
            new[part, entry] = [x // n for x in total]
        return Codebooks(new, self.step)

    def movement(self, old: Codebooks) -> np.ndarray:
        """How far each entry went from ``old`` to these, in steps, rounded up and a step more."""
        far = np.sqrt(((self.entries - old.entries) ** 2).sum(axis=2)) / self.step
        return np.where(far > 0, np.ceil(far).astype(np.int64) + 1, 0)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all of y, integers below 2 ** 24 in size."""
    a, b = x.astype(np.float64), y.astype(np.float64)
    if a.shape[1] * float(max(abs(a).max(initial=0), abs(b).max(initial=0))) ** 2 < 2.0**51:
        # every term and sum is an integer that a double holds exactly
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in y], axis=1)


def assign_all(x: np.ndarray, books: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, upper and lower bounds of one part of some vectors, from all distances."""
    d = squared(x, books)
    entry = d.argmin(axis=1)  # the first of equal ones
    steps = np.floor(np.sqrt(d) / step).astype(np.int64)
    return entry, steps[np.arange(len(x)), entry] + 2, np.maximum(steps - 1, 0)


def assign_pruned(x: np.ndarray, part: int, books: Codebooks, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Elkan's step for one part of some vectors, and how many distances were worked out."""
    entries, between = books.entries[part], books.between[part]
    entry, upper, lower = entry.copy(), upper.copy(), lower.copy()
    todo = np.flatnonzero(2 * upper >= books.nearest[part][entry])

    def left(rows: np.ndarray) -> np.ndarray:
        u = upper[rows][:, None]
        open_ = (lower[rows] <= u) & (between[entry[rows]] <= 2 * u)
        open_[np.arange(len(rows)), entry[rows]] = False
        return open_

    todo = todo[left(todo).any(axis=1)]
    if not len(todo):
        return entry, upper, lower, 0
    # the upper bound of those still open is brought to its own distance first
    own = ((x[todo] - entries[entry[todo]]) ** 2).sum(axis=1)
    steps = np.floor(np.sqrt(own) / books.step).astype(np.int64)
    upper[todo], lower[todo, entry[todo]] = steps + 2, np.maximum(steps - 1, 0)
    at, other = np.nonzero(left(todo))
    found = np.empty(len(at), np.int64)
    for k in range(0, len(at), 200_000):
        found[k : k + 200_000] = ((x[todo[at[k : k + 200_000]]] - entries[other[k : k + 200_000]]) ** 2).sum(axis=1)
    steps = np.floor(np.sqrt(found) / books.step).astype(np.int64)
    lower[todo[at], other] = np.maximum(steps - 1, 0)
    # the least (distance, index) of what was worked out and the entry held
    rows = np.concatenate([np.arange(len(todo)), at])
    which, far = np.concatenate([entry[todo], other]), np.concatenate([own, found])
    order = np.lexsort((which, far, rows))
    first = order[np.concatenate([[True], rows[order][1:] != rows[order][:-1]])]
    entry[todo], upper[todo] = which[first], np.floor(np.sqrt(far[first]) / books.step).astype(np.int64) + 2
    return entry, upper, lower, len(todo) + len(at)


def integers(column: str, scale: int):
    """The vector as long integers."""
    return F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def kept_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, ints) of the rows with finite vectors."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    held = rows.where(v.isNotNull() & (F.size(v) > 0)).where(fine)
    return held.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), integers(vector_col, scale).alias("ints"))


def _arrays(column: pd.Series, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), kind).reshape(len(column), *shape)


def _blobs(values: np.ndarray, kind: type) -> list[bytes]:
    return [x.tobytes() for x in values.astype(kind)]


def _frame(batch: pd.DataFrame, vecs: list[bytes], entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "vec": vecs, "entry": _blobs(entry, np.uint16), "upper": _blobs(upper, np.int32), "lower": _blobs(lower, np.uint16)})


def first_state(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """Every vector assigned by all its distances."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        parts, n, width = held.entries.shape
        for batch in batches:
            if len(batch):
                x = np.array(batch["ints"].tolist(), np.int64).reshape(len(batch), parts, width)
                found = [assign_all(x[:, p], held.entries[p], held.step) for p in range(parts)]
                yield _frame(batch, _blobs(x, np.int32), *(np.stack(f, axis=1) for f in zip(*found, strict=True)))

    ids = F.col("vec_id").cast("string")  # as numbers a column with nulls would come as floats
    return vectors.select(ids.alias("vec_id"), "label", "ints").mapInPandas(run, _STATE.replace("vec_id long", "vec_id string"))


def next_state(state: DataFrame, books: Codebooks, old: Codebooks) -> DataFrame:
    """Bounds shifted by the movement of the entries since ``old``, and every part assigned anew."""
    shared = state.sparkSession.sparkContext.broadcast((books, books.movement(old)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, moved = shared.value
        parts, n, width = held.entries.shape
        for batch in batches:
            if not len(batch):
                continue
            x, entry = _arrays(batch["vec"], np.int32, parts, width).astype(np.int64), _arrays(batch["entry"], np.uint16, parts).astype(np.int64)
            upper, lower = _arrays(batch["upper"], np.int32, parts).astype(np.int64), _arrays(batch["lower"], np.uint16, parts, n).astype(np.int64)
            upper = upper + moved[np.arange(parts), entry]
            lower = np.maximum(lower - moved[None], 0)
            found = [assign_pruned(x[:, p], p, held, entry[:, p], upper[:, p], lower[:, p])[:3] for p in range(parts)]
            yield _frame(batch, list(map(bytes, batch["vec"])), *(np.stack(f, axis=1) for f in zip(*found, strict=True)))

    return state.mapInPandas(run, state.schema)


def entry_sums(state: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and componentwise sums by (part, entry): partial sums in the tasks, one row an entry at the driver."""
    parts, n, width = books.entries.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros(parts * n, np.int64), np.zeros((parts * n, width), np.int64)
        for batch in batches:
            if len(batch):
                x, entry = _arrays(batch["vec"], np.int32, parts, width), _arrays(batch["entry"], np.uint16, parts)
                at = (entry + np.arange(parts) * n).ravel()
                count += np.bincount(at, minlength=parts * n)
                np.add.at(total, at, x.reshape(-1, width))
        some = np.flatnonzero(count)
        if len(some):
            yield pd.DataFrame({"at": some, "n": count[some], "total": list(total[some])})

    partial = state.select("vec", "entry").mapInPandas(run, "at long, n long, total array<long>")
    sums = [F.sum(F.col("total")[k]) for k in range(width)]
    rows = partial.groupBy("at").agg(F.sum("n").alias("n"), F.array(*sums).alias("total")).collect()
    return {divmod(r["at"], n): (r["n"], r["total"]) for r in rows}


def train(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """The final state of every kept vector (vec_id and label as text, vec, entry, ...) and the codebooks."""
    vectors = kept_vectors(rows, id_col, vector_col, label_col, scale)
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "ints").select("ints").limit(entries).collect()
    size, most = F.size("ints"), F.array_max(F.transform("ints", F.abs))
    shortest, longest, most = vectors.agg(F.min(size), F.max(size), F.max(most)).first()
    if shortest is None:
        return vectors.select(F.col("vec_id").cast("string").alias("vec_id"), "label", *[F.lit(b"").alias(c) for c in ("vec", "entry")]), None
    if shortest != longest or longest % parts:
        raise ValueError(f"vectors have {shortest} to {longest} components; all must have as many, a multiple of {parts}")
    if most >= _LIMIT:
        raise ValueError(f"components reach {most} after scaling; the limit is {_LIMIT}")
    width = longest // parts
    begin = np.array([r["ints"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    # no distance is longer than this many steps: entries are means of vectors and stay within their range
    step = 2.0 * max(most, 1) * math.sqrt(width) / _STEPS
    books = Codebooks(begin.copy(), step)
    state = written(first_state(vectors, books), "codes", 2000)
    for _ in range(rounds):
        with small_batches(state.sparkSession, 10_000):
            new = books.replaced(entry_sums(state, books))
        moved = written(next_state(state, new, books), "codes", 2000)
        release(state)
        state, books = moved, new
    return state, books


def encoded(rows: DataFrame, label_col: str = "label", **options) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256): a code has two hexadecimal digits a part, ``error`` is the squared
    distance to the entries."""
    state, books = train(rows, label_col=label_col, **options)
    spark = rows.sparkSession
    schema = "vec_id long, label string, code string, error long"
    if books is None:
        return spark.createDataFrame([], schema).withColumn("codebooks_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    entries = books.entries
    digits = max(2, -(-(entries.shape[1] - 1).bit_length() // 4))
    shared = spark.sparkContext.broadcast(entries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        parts, _, width = held.shape
        for batch in batches:
            if len(batch):
                x, entry = _arrays(batch["vec"], np.int32, parts, width).astype(np.int64), _arrays(batch["entry"], np.uint16, parts)
                far = ((x - held[np.arange(parts), entry]) ** 2).sum(axis=(1, 2))
                yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "code": ["".join(f"{e:0{digits}x}" for e in row) for row in entry.tolist()], "error": far})

    coded = state.select("vec_id", "label", "vec", "entry").mapInPandas(run, schema.replace("vec_id long", "vec_id string"))
    held = written(coded.withColumn("vec_id", F.col("vec_id").cast("long")), "encoded", 10_000)
    release(state)
    return held.withColumn("codebooks_sha256", F.lit(books.sha256()))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over the rows of one label (nulls together)."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("label_"), "label_error")
    return coded.join(sums, coded["label"].eqNullSafe(sums["label_"])).drop("label_")
