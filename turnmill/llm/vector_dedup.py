"""Operator 9: near-duplicate vectors through an inverted multi-index.

Vectors of one label are compared by cosine. Equal vectors are one node with a weight. Each half of the unit vectors has a codebook
of its own (k-means on SAMPLE vectors at most); two codewords name a cell of the product grid, and every node is indexed in the
cell of its halves. A query visits cells in ascending sum of both distances (the multi-sequence order), as many as the target
recall needs: for PROBES vectors, chosen by hash, all links are found by brute force over all nodes, and the rank of the cell in
which each partner lies gives the number of visits. Where these have fewer than LINKS links, or fewer than LINKED of them have any,
the rest of the sample are probes too. What shares a visited cell is verified in double precision.

Where that is still too few, though not all nodes are probes, or where the recall is to be 1, the search is exact: a query visits
every cell that may hold a partner. A vector within d of a query lies in the cell of a codeword c only if the query is within d of
the half-space that is nearer to c than to any other codeword; over the halves these distances' squares add up to 2 - 2 threshold
at most. Of two cells only the lower one's nodes visit. The size of the codebooks is the one of the least estimated cost.

A pair is found if either visits the other's cell, and counts once for each: a member of a cell counts a visitor unless it
visits the visitor's cell itself. Cells of many members are split into blocks, and each visitor goes to all of them; the visitors of a
cell of many are split too, and meet its blocks in as many tasks. Counts and one link to a root per node leave a task, never pairs.
A node's number is a hash; should two different vectors have one, all are numbered anew with another seed.

Null labels, null or empty vectors, zero vectors and those with null or non-finite components link with nothing. Vectors of
different lengths don't link; each length has an index of its own. Labels may be of any type and are compared as their text. Null ids take part and are a component's id only if all its ids are null; rows that repeat an id
and a vector are separate copies. Other columns are left out, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, mixed, prepared
from .linked import components

THRESHOLD = 0.98
SAMPLE, PROBES, RECALL, BLOCK, CELL = 10_000, 1_000, 0.998, 2_000, 12
#: Sample vectors for each codeword, at least; visitors that meet a block in one task.
EACH, VISITORS = 4, 50_000
#: Links that probes must have, and probes that must have links, for a number of visits to be read from them.
LINKS, LINKED = 1_000, 100
#: Codewords whose half-spaces bound a cell; query-cell pairs looked at at once; comparisons that cost as much as shipping a row.
NEAREST, LOOKED, SHIPPED = 16, 4_000_000, 300


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _codebook(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """k-means from the first k different rows."""
    words = np.unique(x, axis=0)
    words = words[np.argsort(mixed(np.arange(len(words), dtype=np.uint64)))][:k].copy()
    for _ in range(rounds):
        near = _far(x, words).argmin(1)
        n = np.bincount(near, minlength=len(words))
        sums = np.stack([np.bincount(near, x[:, d], len(words)) for d in range(x.shape[1])], 1)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


def _far(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)


class Grid:
    """Two codebooks for vectors of one length."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.books = _codebook(sample[:, : self.half], k), _codebook(sample[:, self.half :], k)

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _far(x[:, : self.half], self.books[0]), _far(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self._halves(x)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def visits(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each row, nearest first. The m-th cell of the sequence has ranks whose product is m at most."""
        a, b = self._halves(x)
        n = min(n, a.shape[1] * b.shape[1])
        oa, ob = np.argsort(a, 1, kind="stable")[:, :n], np.argsort(b, 1, kind="stable")[:, :n]
        i, j = np.array([(i, j) for i in range(oa.shape[1]) for j in range(min(ob.shape[1], n // (i + 1)))]).T
        sums = np.take_along_axis(a, oa[:, i], 1) + np.take_along_axis(b, ob[:, j], 1)
        best = np.argsort(sums, 1, kind="stable")[:, :n]
        return np.take_along_axis(oa, i[best], 1) * b.shape[1] + np.take_along_axis(ob, j[best], 1)

    def _beyond(self, far: np.ndarray, words: np.ndarray) -> np.ndarray:
        """At most the squared distance of each row to the region of each codeword."""
        between = np.sqrt(np.maximum(_far(words, words), 0))
        out, rows = np.zeros_like(far), np.arange(len(far))
        for near in np.argsort(far, 1, kind="stable")[:, :NEAREST].T:
            apart = between[near]
            out = np.maximum(out, np.where(apart > 1e-6, (far - far[rows, near][:, None]) / np.maximum(2 * apart, 1e-6), 0))
        return out * out

    def reached(self, x: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of pieces of x: the first row, the rows' own cells, and (row of the piece, cell) of each cell, not below the own, that may hold a partner."""
        step = max(1, LOOKED // (len(self.books[0]) * len(self.books[1])))
        for at in range(0, len(x), step):
            a, b = self._halves(x[at : at + step])
            own = a.argmin(1) * b.shape[1] + b.argmin(1)
            a, b = self._beyond(a, self.books[0]), self._beyond(b, self.books[1])
            near = (a[:, :, None] + b[:, None, :]).reshape(len(a), -1) <= 2 - 2 * threshold + 1e-6
            near &= np.arange(near.shape[1]) >= own[:, None]
            near[np.arange(len(own)), own] = True
            yield at, own, *np.nonzero(near)

    def rank(self, x: np.ndarray, row: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Where in the sequence of a row of x a cell stands, for pairs of row and cell."""
        a, b = self._halves(x)
        own = a[row, cells // b.shape[1]] + b[row, cells % b.shape[1]]
        b = np.sort(b, 1)
        return np.array([int(np.searchsorted(b[i], o - a[i], "left").sum()) for i, o in zip(row.tolist(), own)], np.int64)


def _probed(grid: Grid, probes: np.ndarray, keys: np.ndarray, threshold: float):
    """(rank, probe, n): how many partners of a probe lie in the cell of such a rank of its sequence. A partner that visits the probe's cell in turn is found earlier, never later."""
    schema = pa.schema([("rank", pa.int64()), ("probe", pa.int64()), ("n", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, label = _unit(batch["vector"].to_pylist()), np.array(batch["label"].to_pylist(), object)
            cells = grid.cells(x).astype(np.int64)
            for y in set(label.tolist()):
                rows, mine = np.flatnonzero(label == y), np.flatnonzero(keys == y)
                if not len(mine):
                    continue
                i, j = np.nonzero(x[rows] @ probes[mine].T >= threshold)
                i, j = rows[i], mine[j]
                other = (np.abs(x[i] - probes[j]) > 0).any(1)
                at, n = np.unique(np.stack([j[other], cells[i[other]]], 1), axis=0, return_counts=True)  # a family's many vectors share few cells
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(grid.rank(probes, at[:, 0], at[:, 1])), pa.array(at[:, 0]), pa.array(n.astype(np.float64))], schema=schema)

    return run


def _placed(grid: Grid, visits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch["vector"].to_pylist())
            seen = grid.visits(x, visits).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * seen.shape[1], pa.int32()), pa.array(seen.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(grid.cells(x).astype(np.int64)), lists], [*batch.schema.names, "cell", "visits"])

    return run


def _reached(grid: Grid, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for at, own, row, cell in grid.reached(_unit(batch["vector"].to_pylist()), threshold):
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(own) + 1)), pa.int32()), pa.array(cell.astype(np.int64)))
                part = batch.slice(at, len(own))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int64)), lists], [*batch.schema.names, "cell", "visits"])

    return run


def _thriftiest(x: np.ndarray, each: float, threshold: float) -> Grid:
    """The grid of the least cost of an exact search, estimated on some of x; each label has so many nodes."""
    best, k = None, 2
    while k <= max(2, len(x) // EACH) and (k == 2 or k * k * CELL <= each):
        grid = Grid(x, k)
        some, inside = x[:500], each / (k * k)
        visits = sum(len(row) for _, _, row, _ in grid.reached(some, threshold)) / len(some)
        cost = visits * (max(1, inside / BLOCK) * SHIPPED + inside)
        if best is None or cost < best[0]:
            best = cost, grid
        k *= 2
    return best[1]


def _visits(nodes: DataFrame, grid: Grid, x: np.ndarray, keys: np.ndarray, n: int, threshold: float, recall: float) -> int | None:
    """How many cells each node visits for the recall; None where the links seen are too few to tell."""
    if recall >= 1:
        return None
    for probes in sorted({min(PROBES, len(x)), len(x)}):
        found = kept(nodes.select("node", "label", "vector").mapInArrow(_probed(grid, x[:probes], keys[:probes], threshold), "rank long, probe long, n double"), "ranks")
        total, linked = found.agg(F.sum("n"), F.count_distinct("probe")).first()
        if probes == n or (total or 0) >= LINKS and linked >= LINKED:
            seen = 0
            for rank, c in found.groupBy("rank").agg(F.sum("n")).orderBy("rank").collect():
                seen += c
                if seen >= recall * total:
                    return max(4, rank + 1)
            return 4
    return None


def _compared(threshold: float):
    """Rows come sorted by group, members (role 0) before visitors (role 1). Gives (node, links, root)."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, at = None, [], None

        def closed() -> Iterator[pa.RecordBatch]:
            if at is not None and (some := np.flatnonzero(at["links"])).size:
                yield pa.RecordBatch.from_arrays([pa.array(at["node"][some]), pa.array(at["links"][some]), pa.array(at["root"][some])], schema=schema)

        def opened(rows: list) -> dict:
            node, n, cell, visits, vector = zip(*rows)
            node = np.array(node, np.int64)
            return {"node": node, "n": np.array(n, np.int64), "cell": cell[0], "visits": np.array(visits, np.int64), "x": _unit(vector), "links": np.zeros(len(node), np.int64), "root": node.copy()}

        for batch in batches:
            group = np.array(batch["group"].to_pylist(), object)
            role = batch["role"].to_numpy()
            cut = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (role[1:] != role[:-1])])
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(group)]):
                if group[a] != now:
                    yield from closed()
                    now, members, at = group[a], [], None
                part = batch.slice(a, b - a)
                rows = list(zip(*(part[c].to_pylist() for c in ("node", "n", "cell", "visits", "vector"))))
                if role[a] == 0:
                    members += rows
                    continue
                if at is None:
                    if not members:
                        continue
                    at, members = opened(members), []
                node, n, cell, _, vector = zip(*rows)
                node, n, cell = np.array(node, np.int64), np.array(n, np.int64), np.array(cell, np.int64)
                hit = (_unit(vector) @ at["x"].T >= threshold) & (node[:, None] != at["node"])
                if not hit.any():
                    continue
                links = hit @ at["n"]
                # a member counts this visitor unless it visits the visitor's own cell, where it is a visitor itself
                again = np.zeros_like(hit)
                if at["cell"] is not None:
                    own = cell == at["cell"]
                    again[own] = True
                    for i in np.flatnonzero(~own & hit.any(1)).tolist():
                        again[i] = (at["visits"] == cell[i]).any(1)
                at["links"] += n @ (hit & ~again)
                before, top = at["root"].copy(), np.int64(2**63 - 1)
                while True:  # the smallest node that visitors and members reach through each other
                    low = np.minimum(node, np.where(hit, at["root"], top).min(1))
                    root = np.minimum(at["root"], np.where(hit, low[:, None], top).min(0))
                    if (root == at["root"]).all():
                        break
                    at["root"] = root
                some = np.flatnonzero(hit.any(1))
                moved = np.unique(np.stack([before, at["root"]], 1)[before != at["root"]], axis=0)  # visitors before may have the old root
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[some], moved[:, 0]])), pa.array(np.concatenate([links[some], np.zeros(len(moved), np.int64)])), pa.array(np.concatenate([low[some], moved[:, 1]]))], schema=schema)
        yield from closed()

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components as bytes, null where the vector links with nothing."""
    for batch in batches:
        out, dim = [], []
        for label, v in zip(batch["label"].to_pylist(), batch["vector"]):
            x = None
            if label is not None and v.is_valid and len(v) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False)
                x = x if np.isfinite(x).all() and x.any() else None
            if x is not None and len(x) == 1:
                x = np.append(x, 0.0)
            dim.append(None if x is None else len(x))
            out.append(None if x is None else x.astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(dim, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "label", "dim", "vector"])


def _found(nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(node, links, root) over nodes of one length: rows to be summed by node."""
    n, labels = nodes.agg(F.count("*"), F.approx_count_distinct("label")).first()
    k = int(min(max(2, SAMPLE // EACH), max(2, round((n / (labels * CELL)) ** 0.5))))
    sample = nodes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("label", "vector").collect()  # a bounded number
    x = _unit([bytes(r.vector) for r in sample])
    grid = Grid(x, k)
    visits = _visits(nodes, grid, x, np.array([r.label for r in sample], object), n, threshold, recall)
    place = _placed(grid, visits) if visits else _reached(_thriftiest(x, n / labels, threshold), threshold)
    placed = nodes.select("node", "label", "n", "vector").mapInArrow(place, "node long, label string, n long, vector binary, cell long, visits array<long>")
    placed = kept(placed, "placed")
    blocks = placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    coming = placed.select("label", F.explode("visits").alias("cell")).groupBy("label", "cell").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("parts"))
    blocks = kept(blocks.join(coming, ["label", "cell"], "left").fillna(1, ["parts"]), "blocks")
    again = F.col("visits") if visits else F.array().cast("array<long>")  # in an exact search no member visits a visitor's cell
    row = ["node", "n", F.col("own").alias("cell"), again.alias("visits"), "vector"]
    name = lambda block, part: F.concat_ws(":", "label", "cell", block, part).alias("group")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = placed.withColumn("own", F.col("cell")).join(blocks, ["label", "cell"]).withColumn("part", upto("parts"))
    members = own.select(name(F.pmod(F.xxhash64("node"), F.col("blocks")), F.col("part")), F.lit(0).alias("role"), *row)
    visitors = placed.withColumnRenamed("cell", "own").withColumn("cell", F.explode("visits")).join(blocks, ["label", "cell"])
    visitors = visitors.withColumn("block", upto("blocks")).select(name(F.col("block"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))), F.lit(1).alias("role"), *row)
    groups = members.unionByName(visitors).repartition("group").sortWithinPartitions("group", "role", "node")
    return groups.mapInArrow(_compared(threshold), "node long, links long, root long")


def _nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with node, null where the vector links with nothing, and the nodes: node, label, dim, vector, n, low."""
    seed = 0
    while True:
        numbered = rows.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(seed), "label", "vector")))
        nodes = kept(numbered.filter("vector is not null").groupBy("node", "label", "dim", "vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("low")), "nodes")
        if not nodes.groupBy("node").agg(F.count("*").alias("c")).filter("c > 1").limit(1).count():
            return numbered, nodes
        seed += 1


def dedup(df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    prepared(df.sparkSession)
    slim = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = slim.mapInArrow(_packed, "vec_id long, label string, dim int, vector binary")
    rows, nodes = _nodes(kept(rows, "vectors"))
    dims = [r.dim for r in nodes.select("dim").distinct().collect()]  # the lengths that there are
    links = None
    for d in sorted(dims):
        some = _found(nodes.filter(F.col("dim") == d), threshold, recall)
        links = some if links is None else links.unionByName(some)
    named = rows.select("vec_id", "node")
    if links is None:
        return named.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = kept(links, "links")
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    facts = nodes.select("node", "n", "low").join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    facts = facts.join(facts.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = named.join(facts, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
