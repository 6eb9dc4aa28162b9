"""Operator 13: codes of vectors by codebooks of their parts, nearest entries found with fixed pivots (LAESA).

A component x becomes the integer floor(scale * x), and a vector is cut into PARTS equal parts. A part position's codebook begins as that
part of the ENTRIES smallest ids' vectors; each of ROUNDS rounds gives every part to the nearest entry and moves each entry to its parts'
mean, rounded down.

PIVOTS parts of each position, taken from the first codebook so that each is far from those before it, stay fixed. The distance of every
part to the pivots is worked out once and written with the parts. Each round works out the entries' distances to the pivots; for a part and
an entry the greatest difference of their distances to a pivot bounds their own distance from below. The entry of the least bound is evaluated
first, then the others in waves of rising bounds, and those whose bound exceeds the best distance so far never are. Evaluations are exact, in
whole numbers; a bound counts as exceeded only beyond what its rounding could explain, and one that equals the best isn't.

A round is a map over the written parts: each task sums its parts by entry before anything is shuffled (PARTS * ENTRIES entries at most), and the
entries' sums, as many, go to the driver, from where the next round takes its codebooks.

Null vectors and those that hold null or non-finite components are dropped, and components that 2^27 / scale doesn't hold are refused
with ValueError, as are vectors whose lengths differ or aren't a multiple of PARTS. Null ids come after all others, equal ids by the bytes
of their integers, and repeated rows are entries of their own; equal entries tie to the lower index. With fewer vectors than ENTRIES there are fewer entries.
Null labels are one label. Other columns are left out, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, prepared

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 1024, 4, 256, 4, 8
#: Components beyond this could overflow the sums; vectors looked at at once.
LARGEST, ROWS = 2**27, 4096
#: Squared bounds of a wave, as shares of the best squared distance known before it.
WAVES = (1 / 4, 1 / 2, 3 / 4, 1)


def _integers(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out, dim = [], [], []
            for i, v in enumerate(batch["vector"]):
                if not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(scale * x)
                if (np.abs(x) > LARGEST).any():
                    raise ValueError(f"a component is beyond {LARGEST // scale}")
                keep.append(i)
                dim.append(len(x))
                out.append(x.astype("<i4").tobytes())
            named = batch.select(["vec_id", "label"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*named.columns, pa.array(dim, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "label", "dim", "x"])

    return run


def _split(packed: list[bytes], parts: int) -> np.ndarray:
    """(part, vector, component)."""
    x = np.frombuffer(b"".join(packed), "<i4").astype(np.int64).reshape(len(packed), parts, -1)
    return np.ascontiguousarray(x.transpose(1, 0, 2))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows to rows, from exact squares."""
    d = x[:, None, :] - y[None, :, :]
    return np.sqrt((d * d).sum(2).astype(np.float64))


def spread(entries: np.ndarray, n: int) -> np.ndarray:
    """n of the entries, the first and then always the one that is farthest from those taken."""
    taken = [0]
    far = _apart(entries, entries[:1])[:, 0]
    while len(taken) < min(n, len(entries)) and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, _apart(entries, entries[taken[-1:]])[:, 0])
    return entries[taken]


class Book:
    """A codebook of one part position, with its entries' distances to the pivots."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self.entries, self.to_pivots = entries, _apart(pivots, entries)
        self.evaluated = 0

    def _squares(self, x: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
        self.evaluated += len(row)
        d = x[row] - self.entries[entry]
        return np.einsum("ij,ij->i", d, d)

    def nearest(self, x: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each part the nearest entry, ties to the lower index, and the squared distance. to_pivots: (part, pivot)."""
        n, k = len(x), len(self.entries)
        bound = np.zeros((n, k))
        for p, line in enumerate(self.to_pivots):
            np.maximum(bound, np.abs(to_pivots[:, p, None] - line), out=bound)
        bound = np.maximum(bound - 1e-6, 0)  # roots of whole numbers below 2^62 are off by far less
        bound *= bound
        rows = np.arange(n)
        code = bound.argmin(1)
        best = self._squares(x, rows, code)
        bound[rows, code] = np.inf
        known = best * (1 + 1e-12) + 1  # as a float that isn't below the square
        for share in WAVES:
            row, entry = np.nonzero(bound <= (share * known)[:, None])
            if not len(row):
                continue
            bound[row, entry] = np.inf
            square = self._squares(x, row, entry)
            order = np.lexsort((entry, square, row))
            first = order[np.r_[True, row[order][1:] != row[order][:-1]]]
            r, s, e = row[first], square[first], entry[first]
            won = (s < best[r]) | ((s == best[r]) & (e < code[r]))
            best[r[won]], code[r[won]] = s[won], e[won]
            known = np.minimum(known, best * (1 + 1e-12) + 1)
        return code, best


def _measured(pivots: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _split(batch["x"].to_pylist(), len(pivots))
                far = [_apart(part, p).astype("<f8") for part, p in zip(x, pivots)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b"".join(f[i].tobytes() for f in far) for i in range(batch.num_rows)], pa.binary())], [*batch.schema.names, "far"])

    return run


def _assigned(batch: pa.RecordBatch, pivots: list[np.ndarray], books: list[Book]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part position its parts, their nearest entries and squared distances."""
    x = _split(batch["x"].to_pylist(), len(books))
    far = np.frombuffer(b"".join(batch["far"].to_pylist()), "<f8").reshape(batch.num_rows, -1)
    at = 0
    for part, book in enumerate(books):
        mine = far[:, at : at + len(pivots[part])]
        at += len(pivots[part])
        yield part, x[part], *book.nearest(x[part], mine)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _summed(pivots: list[np.ndarray], entries: list[np.ndarray]):
    """(part, entry, at, n, total): how many parts an entry has in this task, and the sum of their component `at`."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Book(e, p) for e, p in zip(entries, pivots)]
        sums, counts = [np.zeros_like(e) for e in entries], [np.zeros(len(e), np.int64) for e in entries]
        for batch in _pieces(batches):
            for part, x, code, _ in _assigned(batch, pivots, books):
                order = np.argsort(code, kind="stable")
                held = np.bincount(code, minlength=len(counts[part]))
                used = np.flatnonzero(held)
                sums[part][used] += np.add.reduceat(x[order], (np.cumsum(held) - held)[used])
                counts[part] += held
        for part, (total, n) in enumerate(zip(sums, counts)):
            used = np.flatnonzero(n)
            wide = total.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used) * wide, part), pa.int32()), pa.array(np.repeat(used, wide), pa.int32()), pa.array(np.tile(np.arange(wide), len(used)), pa.int32()), pa.array(np.repeat(n[used], wide)), pa.array(total[used].ravel())], schema=schema
            )

    return run


def _coded(pivots: list[np.ndarray], entries: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Book(e, p) for e, p in zip(entries, pivots)]
        for batch in _pieces(batches):
            if not batch.num_rows:
                continue
            codes, error = [], np.zeros(batch.num_rows, np.int64)
            for _, _, code, square in _assigned(batch, pivots, books):
                codes.append(code.tolist())
                error += square
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(["".join(f"{c:02x}" for c in line) for line in zip(*codes)], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def codebooks(measured: DataFrame, entries: list[np.ndarray], pivots: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The entries after the rounds."""
    for _ in range(rounds):
        sums = measured.select("x", "far").mapInArrow(_summed(pivots, entries), "part int, entry int, at int, n long, total long")
        entries = [e.copy() for e in entries]
        for r in sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # a row for each number of the codebooks
            entries[r.part][r.entry, r.at] = r.total // r.n
    return entries


def compress(df: DataFrame, scale: int = SCALE, parts: int = PARTS, size: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row."""
    prepared(df.sparkSession)
    if not 0 < size <= 256:
        raise ValueError("two hex digits name 256 entries at most")
    slim = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = kept(slim.mapInArrow(_integers(scale), "vec_id long, label string, dim int, x binary"), "integers")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(size).select("vec_id", "dim", "x").collect()
    shortest, longest = rows.agg(F.min("dim"), F.max("dim")).first()
    if not first:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    if shortest != longest or longest % parts or not longest:
        raise ValueError(f"vectors of {shortest} to {longest} components can't be cut into {parts} equal parts")
    entries = list(_split([bytes(r.x) for r in first], parts))
    fixed = [spread(e, pivots) for e in entries]
    measured = kept(rows.drop("dim").mapInArrow(_measured(fixed), "vec_id long, label string, x binary, far binary"), "measured")
    entries = codebooks(measured, entries, fixed, rounds)
    digest = hashlib.sha256(",".join(str(c) for e in entries for c in e.ravel().tolist()).encode()).hexdigest()
    coded = kept(measured.mapInArrow(_coded(fixed, entries), "vec_id long, label string, code string, error long"), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
