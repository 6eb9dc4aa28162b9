"""Operator 12: exact top-k inner products through an impact-ordered index, processed score at a time.

A component x of a vector becomes the integer floor(scale * x). A block of vectors is indexed by component: the rows in the order of their values,
cut into segments of LEVELS quantised values at most. A query gives each segment an impact, the most that the segment adds to a score: the
query's component times the segment's greatest value, or its least where the component is negative. Segments are processed by descending impact
over all components, a band of impacts (CUTS) after another, each adding what it holds to the accumulators of its rows.

What a component has left to give is at most the impact of its next segment, and nothing once that isn't positive. So an accumulator plus
what all components have left bounds a row's score from above. The best accumulators' rows, scored exactly, give a score that k rows reach.
A block is done when few rows are bounded by that score or more, or when no segment of positive impact is left: rows whose bound is below it
can't be among the k best, and all others, the possible members, are scored exactly. Nothing else ends the search.

Vectors are dealt out in parts of PART rows by their place, queries in blocks of QUERIES; each block of queries meets each part in one task,
which gives k rows a query at most, and the k best of those are ranked. The comparisons that the contract asks for are queries times rows.

Null vectors and those that hold null or non-finite components (also those that scaling makes infinite) take no part. Vectors of different lengths don't meet; empty ones score 0 with each
other. A query's own row is no candidate; rows that repeat its id or its vector are, and each row whose id the rule picks is a query of its own.
Null ids are no queries under the rule, but candidates, behind all others of their score. Scores beyond 2^53 are worked out in whole numbers without the index, and
those beyond a long count as the nearest long. Other columns are left out, whatever their names. Queries without candidates give no row, nor does an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, prepared

K, SCALE, EVERY = 5, 256, 50
#: Rows of an index, queries that meet it in a task, segments of a component.
PART, QUERIES, LEVELS = 10_000, 4_000, 64
#: Impacts, as shares of the greatest, at which the bound is looked at; the share of rows that may be left then.
CUTS, FEW = (1 / 4, 1 / 10, 1 / 30), 1 / 16
EXACT = 2**53


class Index:
    """Rows of one length: a posting list for each component, cut into segments by quantised value."""

    def __init__(self, x: np.ndarray):
        n, dims = x.shape
        self.x, self.most = x, float(np.abs(x).max(initial=0))
        order = np.argsort(x, 0, kind="stable")
        value = np.take_along_axis(x, order, 0)
        low, high = value[0], value[-1]
        level = (value - low) // np.maximum(1, np.ceil((high - low + 1) / LEVELS))
        starts = np.vstack([np.ones((1, dims), bool), level[1:] != level[:-1]]).T.ravel()
        self.rows, self.values = np.ascontiguousarray(order.T).ravel(), np.ascontiguousarray(value.T).ravel()
        first = np.flatnonzero(starts)
        self.edges = np.r_[first, n * dims]  # where each segment's postings begin
        self.of = first // n
        self.low, self.high = self.values[first], self.values[self.edges[1:] - 1]
        self.begins = np.searchsorted(self.of, np.arange(dims))
        self.ends = np.r_[self.begins[1:], len(first)]

    def members(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows, without `own` (-1: none), that hold the k best, and their scores."""
        n = len(self.x)
        weight = q[self.of]
        impact = np.maximum(weight * self.low, weight * self.high)
        up = q >= 0  # the greatest impacts are at the end of the list, else at its beginning
        top, before, reached, sums = max(impact.max(), 0), np.zeros(len(q), np.int64), -np.inf, np.zeros(n)
        for cut in (*CUTS, 0):
            done = np.add.reduceat(impact > cut * top, self.begins)  # of each component so many segments
            a = self.edges[np.where(up, self.ends - done, self.begins + before)].tolist()
            b = self.edges[np.where(up, self.ends - before, self.begins + done)].tolist()
            for d in np.flatnonzero(done > before).tolist():
                sums[self.rows[a[d] : b[d]]] += q[d] * self.values[a[d] : b[d]]
            more = np.where(up, self.ends - done - 1, self.begins + done)
            rest = np.where((more >= self.begins) & (more < self.ends), np.maximum(impact[np.minimum(more, len(impact) - 1)], 0), 0).sum()
            before = done
            if n > 4 * k:
                best = np.argpartition(sums, n - 4 * k)[n - 4 * k :]
                scores = self.x[best[best != own]] @ q
                reached = max(reached, np.partition(scores, len(scores) - k)[len(scores) - k])
            possible = np.flatnonzero(sums + rest >= reached)
            if len(possible) <= FEW * n:
                break
        possible = possible[possible != own]
        return possible, self.x[possible] @ q


def _ranked(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best among rows: by score, then by id, null ids last."""
    if len(scores) > 8 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[rows[some]], unnamed[rows[some]], -scores[some]))[:k]]


def _best(queries: list, vectors: list, k: int) -> Iterator[tuple[int, int, int | None, int]]:
    """(row of the query, its id, id, score) of the k best of the vectors for each query. Both: (row, id, vector)."""
    row = np.array([v[0] for v in vectors])
    ids = np.array([v[1] or 0 for v in vectors])
    unnamed = np.array([v[1] is None for v in vectors])
    held = lambda some: np.frombuffer(b"".join(v[2] for v in some), "<f8").reshape(len(some), -1)
    x, qs = held(vectors), held(queries)
    if not x.shape[1]:
        x, qs = np.zeros((len(x), 1)), np.zeros((len(qs), 1))
    place = {r: i for i, r in enumerate(row.tolist())}
    index = Index(x)
    whole = None
    for (q_row, q_id, _), q in zip(queries, qs):
        own = place.get(q_row, -1)
        if index.most * float(np.abs(q).sum()) < EXACT:
            rows, scores = index.members(q, own, k)
            best = _ranked(rows, scores, ids, unnamed, k)
        else:
            whole = np.array([[int(c) for c in line] for line in x.tolist()], object) if whole is None else whole
            rows = np.flatnonzero(np.arange(len(x)) != own)
            scores = [max(-(2**63), min(2**63 - 1, s)) for s in whole[rows].dot(np.array([int(c) for c in q.tolist()], object))]
            best = sorted(range(len(rows)), key=lambda i: (-scores[i], unnamed[rows[i]], ids[rows[i]]))[:k]
        for i in best:
            r = rows[i]
            yield q_row, q_id, None if unnamed[r] else int(ids[r]), int(scores[i])


def _searched(k: int):
    """Batches come sorted by group, a group's queries (role 0) before its vectors (role 1)."""
    schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries, vectors = None, [], []

        def found() -> Iterator[pa.RecordBatch]:
            if queries and vectors and (out := list(_best(queries, vectors, k))):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            for dim, part, block, role, *item in zip(*(batch[c].to_pylist() for c in ("dim", "part", "block", "role", "row", "vec_id", "x"))):
                if (dim, part, block) != now:
                    yield from found()
                    now, queries, vectors = (dim, part, block), [], []
                (vectors if role else queries).append(item)
        yield from found()

    return run


def _scaled(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, dim = [], [], []
            for i, v in zip(batch["vec_id"].to_pylist(), batch["vector"]):
                if not v.is_valid or v.values.null_count:
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype("<f8"))
                if np.isfinite(x).all():
                    ids.append(i)
                    dim.append(len(x))
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dim, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "x"])

    return run


def search(df: DataFrame, k: int = K, queries: Column | None = None, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each row that `queries` holds for (a condition on vec_id; by default divisible by EVERY) the k best among all other rows."""
    prepared(df.sparkSession)
    slim = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = kept(slim.mapInArrow(_scaled(scale), "vec_id long, dim int, x binary").withColumn("row", F.monotonically_increasing_id()), "vectors")
    chosen = rows.filter(F.col("vec_id") % EVERY == 0 if queries is None else queries)
    parts, blocks = max(1, -(-rows.count() // PART)), max(1, -(-chosen.count() // QUERIES))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    columns = ["dim", "part", "block", "role", "row", "vec_id", "x"]
    asking = chosen.withColumn("block", dealt(blocks)).withColumn("part", upto(parts)).withColumn("role", F.lit(0)).select(columns)
    asked = rows.withColumn("part", dealt(parts)).withColumn("block", upto(blocks)).withColumn("role", F.lit(1)).select(columns)
    groups = asking.unionByName(asked).repartition(parts * blocks, "dim", "part", "block").sortWithinPartitions("dim", "part", "block", "role")
    found = groups.mapInArrow(_searched(k), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
