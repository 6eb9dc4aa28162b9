"""Operator 8: a self-join of documents on the Jaccard similarity of their 5-word shingles, in size-banded tiles.

A document's set is its distinct shingles, as 64-bit hashes. Equal sets are one node, named by a 64-bit hash of the set; a second hash
tells whether two different sets have one name, and those few sets are then named by the second.

Bands. Sets of similarity t or more differ in size by a factor 1 / t at most, so a set in a size band can only link within it and
with the next one. For the sets of two neighbouring bands the hash space is cut into more cells than linked sets can differ in:
two sets that link must then hold exactly the same shingles in at least one cell. A tile is all sets of two bands that agree in a
cell; a set in fewer tiles than it has cells that can't all differ links with nothing. A shingle that very many documents share doesn't make a tile of them all, since the rest of the cell must agree too.
A set with so many empty cells that this isn't certain also enters tiles by the shingles of its prefix (the usual prefix
filter); of a pair that could be missed both sets do.

Tiles to links. Each set goes with one that it shares most tiles with, and that one with another in turn; the sets of such a family, in blocks of BLOCK, are compared
with each other in one task: hashed bitmaps bound the overlap from above by their bit counts, and what may still link is decided
by intersecting the sorted arrays. Pairs already connected by links are not compared. Tiles that then still hold sets of different
components, which no block has compared, are worked off: small ones by their open pairs, large ones whole, again in blocks. So every pair that links is in one component.
Copies never become pairs, only verified links count, and no task holds the sets of a group beyond a block; the keys of a bucket, 14 bytes
for each set of a tile, are sorted in one task.

Null and empty texts have an empty set and link with nothing. Copies and repeated rows are one node. Null ids take part and are
never a component's id unless all its ids are null. A very long text is a chunk of its own. Other columns are left out, whatever their
names. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, kept, mixed, prepared, raw, removed, texts, words
from .linked import components as connected

WIDTH, THRESHOLD = 5, (80, 100)
#: Sets of a block and their shingles; keys of a bucket; bits of the filter that tells which sets to send, for each of them, and in all (a power of two; beyond it the filter lets more through, and the join after it decides all the same); members of a tile whose open pairs are listed.
BLOCK, BLOCK_SHINGLES, BUCKET, FILTER_EACH, FILTER_MOST, SMALL = 4096, 6_000_000, 1_500_000, 16, 30, 64
_C = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("again", pa.int64())])


def _bands() -> list[int]:
    """The largest size of each band: 1 / t times the one before."""
    out = [1]
    while out[-1] < 2**40:
        out.append(max(out[-1] + 1, out[-1] * THRESHOLD[1] // THRESHOLD[0]))
    return out


BANDS = np.array(_bands(), np.int64)
_LINKED = THRESHOLD[0] + THRESHOLD[1]
#: In how many shingles linked sets of band i and i + 1 differ at most.
DIFFER = (BANDS[:-1] + BANDS[1:]) * (THRESHOLD[1] - THRESHOLD[0]) // _LINKED
#: Cells that may be empty in a set before it needs its prefix as well.
SPARE = 2 + (0.02 * BANDS[:-1] + 3 * np.sqrt(0.01 * BANDS[:-1])).astype(np.int64)
CELLS = DIFFER + 1 + SPARE


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and where each text's begin (one more than texts)."""
    _, _, word, first = words(data, offsets)
    n = np.diff(first)
    if len(word) >= width:
        every = np.zeros(len(word) - width + 1, np.uint64)
        for k in range(width):
            every += word[k : len(word) - width + 1 + k] * _C[k]
        every = mixed(every)
    else:
        every = np.zeros(0, np.uint64)
    out = []
    for a, k in zip(first[:-1].tolist(), n.tolist()):
        if k >= width:
            h = np.sort(every[a : a + k - width + 1])
            out.append(h[np.r_[True, h[1:] != h[:-1]]])
        elif k:
            out.append(mixed((word[a : a + k] * _C[:k]).sum(keepdims=True) + np.uint64(k) * _C[width + 1]))
        else:
            out.append(every[:0])
    return np.concatenate(out) if out else every, np.cumsum([0, *map(len, out)])


def set_ids(flat: np.ndarray, at: np.ndarray, shared: np.ndarray | None = None, salt: int = 9) -> np.ndarray:
    """The name of each set. shared, sorted: names that different sets have, which take their second hash instead."""
    n = np.diff(at)
    out = np.zeros(len(n), np.uint64)
    if (some := n > 0).any():
        out[some] = np.add.reduceat(mixed(flat ^ _C[salt]), at[:-1][some])
    out = mixed(out + n.astype(np.uint64) * _C[salt + 1]).view(np.int64)
    if shared is not None and len(shared) and (hit := shared[np.minimum(np.searchsorted(shared, out), len(shared) - 1)] == out).any():
        out[hit] = set_ids(flat, at, salt=20)[hit]
    return out


def _profiled(shared: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            flat, at = shingles(*raw(batch["text"]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(at)), pa.array(set_ids(flat, at, shared)), pa.array(set_ids(flat, at, salt=20))], schema=PROFILE)

    return run


def _profile(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n, sid of each document, and the names that different sets had: of n sets, n * n / 3.7e19 are expected."""
    shape = "doc_id long, n long, sid long, again long"
    made = kept(rows.mapInArrow(_profiled(np.zeros(0, np.int64)), shape), "profile")
    twice = made.filter("n > 0").groupBy("sid").agg(F.min("again").alias("a"), F.max("again").alias("b")).filter("a <> b")
    shared = np.sort(np.array([r.sid for r in twice.select("sid").collect()], np.int64))
    if len(shared):
        made = kept(rows.mapInArrow(_profiled(shared), shape), "profile")
    return made.drop("again"), shared


def cell_keys(flat: np.ndarray, at: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, text, need) of the cells of each set in its own band's cut (shift 0) or that of the band below (shift 1).

    need: of a set's filled cells at most DIFFER can differ from a linked set's, so this many tiles, 255 at most, are shared at least.
    """
    n = np.diff(at)
    cut = np.searchsorted(BANDS, n) - shift
    use = (n > 0) & (cut >= 0)
    use &= DIFFER[np.maximum(cut, 0)] > 0  # else only equal sets link
    doc = np.repeat(np.arange(len(n)), n)
    inside = use[doc]
    h, doc = flat[inside], doc[inside]
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    cells = CELLS[np.maximum(cut, 0)].astype(np.uint64)
    cell = ((h >> np.uint64(32)) * cells[doc]) >> np.uint64(32)  # ascends with h
    begin = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (doc[1:] != doc[:-1])])
    sums = np.add.reduceat(mixed(h ^ _C[11]), begin)
    of = doc[begin]
    keys = mixed(sums + cell[begin] * _C[12] + cut[of].astype(np.uint64) * _C[13])
    filled = np.bincount(of, minlength=len(n))
    sparse = np.flatnonzero(use & (filled <= DIFFER[np.maximum(cut, 0)]))
    more, whose = [], []
    for d in sparse.tolist():
        k = int(n[d] - -(-n[d] * THRESHOLD[0] // THRESHOLD[1]) + 1)
        more.append(mixed(flat[at[d] : at[d] + k] + _C[14] + np.uint64(cut[d]) * _C[15:16]))
        whose.append(np.full(k, d))
    of = np.concatenate([of, *whose])
    return np.concatenate([keys, *more]), of, np.clip(filled - DIFFER[np.maximum(cut, 0)], 1, 255).astype(np.uint8)[of]


def _keyed(buckets: int, shared: np.ndarray, most: int = 2_500_000):
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("sids", pa.binary()), ("needs", pa.binary())])

    def packed(keys: list, sids: list, needs: list) -> Iterator[pa.RecordBatch]:
        k, s, need = np.concatenate(keys), np.concatenate(sids), np.concatenate(needs)
        bucket = (k % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        k, s, need, bucket = k[order], s[order], need[order], bucket[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.append(cut[1:], len(k))
        # 40 bits besides the bucket's; what agrees by chance is sorted out with the rest
        part = np.ascontiguousarray((k >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
        for x in range(0, len(cut), 64):
            some = range(x, min(x + 64, len(cut)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[some]]), *(pa.array([x[cut[i] : ends[i]].tobytes() for i in some], pa.binary()) for x in (part, s, need))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sids, needs, n = [], [], [], 0
        seen: set[int] = set()  # copies within a partition enter once
        for batch in chunks(batches):
            flat, at = shingles(*raw(batch["text"]))
            ids = set_ids(flat, at, shared)
            fresh = []
            for i, x in enumerate(ids.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh.append(i)
            if len(seen) > 500_000:
                seen.clear()
            if len(fresh) < len(ids):
                size = np.zeros(len(ids), np.int64)
                size[fresh] = np.diff(at)[fresh]
                flat = flat[np.repeat(size > 0, np.diff(at))]
                at = np.cumsum(np.r_[0, size])
            for shift in (0, 1):
                k, of, need = cell_keys(flat, at, shift)
                keys.append(k)
                sids.append(ids[of])
                needs.append(need)
                n += len(k)
            if n > most:
                yield from packed(keys, sids, needs)
                keys, sids, needs, n = [], [], [], 0
        if n:
            yield from packed(keys, sids, needs)

    return run


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's keys that more than one set has, as rows: (tile, sid, then nulls) for each member of each different tile, (null, sid, pivot, tiles, need) for each set and the smallest of a tile."""
    schema = pa.schema([("tile", pa.int64()), ("sid", pa.int64()), ("pivot", pa.int64()), ("tiles", pa.int64()), ("need", pa.int64())])

    def bucket(keys: list[bytes], sids: list[bytes], needs: list[bytes]) -> Iterator[pa.RecordBatch]:
        part = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 5)
        k = np.zeros((len(part), 8), np.uint8)
        k[:, :5] = part
        k = k.view("<u8").ravel()
        s, need = np.frombuffer(b"".join(sids), np.int64), np.frombuffer(b"".join(needs), np.uint8)
        order = np.argsort(k)
        k, s, need = k[order], s[order], need[order]
        same = k[1:] == k[:-1]
        several = np.r_[False, same] | np.r_[same, False]
        k, s, need = k[several], s[several], need[several]
        order = np.lexsort((s, k))
        k, s, need = k[order], s[order], need[order]
        fresh = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])][: len(k)]
        k, s, need = k[fresh], s[fresh], need[fresh]
        begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
        n = np.diff(np.append(begin, len(k)))
        inside = np.repeat(n > 1, n)
        s, need, n = s[inside], need[inside], n[n > 1]
        if not len(n):
            return
        begin = np.cumsum(n) - n
        tile = mixed(np.add.reduceat(mixed(s.view(np.uint64) ^ _C[16]), begin) + n.astype(np.uint64)).view(np.int64)
        _, one, times = np.unique(tile, return_index=True, return_counts=True)
        n, start, tile = n[one], begin[one], tile[one]
        take = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        members, need = s[take], need[take].astype(np.int64)
        offsets = np.cumsum(np.r_[0, n])
        named = np.repeat(tile, n)
        for a in range(0, len(members), 50_000):
            b = min(a + 50_000, len(members))
            yield pa.RecordBatch.from_arrays([pa.array(named[a:b]), pa.array(members[a:b]), *[pa.nulls(b - a, pa.int64())] * 3], schema=schema)
        pivot, count = np.repeat(members[offsets[:-1]], n), np.repeat(times, n)
        order = np.lexsort((pivot, members))
        x, p, count, need = members[order], pivot[order], count[order], need[order]
        first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (p[1:] != p[:-1])])
        x, p, count, need = x[first], p[first], np.add.reduceat(count, first), np.minimum.reduceat(need, first)
        for a in range(0, len(x), 50_000):
            b = min(a + 50_000, len(x))
            yield pa.RecordBatch.from_arrays([pa.nulls(b - a, pa.int64()), pa.array(x[a:b]), pa.array(p[a:b]), pa.array(count[a:b]), pa.array(need[a:b])], schema=schema)

    now, held = None, ([], [], [])
    for batch in batches:
        for b, *row in zip(*(batch[c].to_pylist() for c in ("bucket", "keys", "sids", "needs"))):
            if b != now and held[0]:
                yield from bucket(*held)
                held = ([], [], [])
            now = b
            for some, x in zip(held, row):
                some.append(x)
    if held[0]:
        yield from bucket(*held)


def _chosen(words_: np.ndarray, bits: int, shared: np.ndarray):
    """(doc_id, sid, set) of the documents whose set the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            flat, at = shingles(*raw(batch["text"]))
            ids = set_ids(flat, at, shared)
            slot = mixed(ids.view(np.uint64)) >> np.uint64(64 - bits)
            hit = (words_[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
            some = np.flatnonzero((hit == 1) & (np.diff(at) > 0))
            if len(some):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(some)), pa.array(ids[some]), pa.array([flat[at[i] : at[i + 1]].tobytes() for i in some], pa.binary())], ["doc_id", "sid", "shingles"])

    return run


def _slots(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique(mixed(batch["sid"].to_numpy().view(np.uint64)) >> np.uint64(64 - bits))
            word = slot >> np.uint64(6)
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]][: len(word)])
            if len(begin):
                yield pa.RecordBatch.from_arrays([pa.array(word[begin].astype(np.int64)), pa.array(np.bitwise_or.reduceat(np.uint64(1) << (slot & np.uint64(63)), begin).view(np.int64))], ["word", "bits"])

    return run


def _sets(rows: DataFrame, wanted: DataFrame, reps: DataFrame, shared: np.ndarray) -> DataFrame:
    """sid and shingles of the wanted sids. A filter sized by their number, not a list, goes to the tasks; a join does the rest."""
    names = kept(wanted.select("sid").distinct(), "wanted")
    bits = min(FILTER_MOST, max(10, int(FILTER_EACH * names.count()).bit_length()))
    found = names.mapInArrow(_slots(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    held = np.zeros(1 << (bits - 6), np.uint64)
    for batch in found.toArrow().to_batches():  # 2 ** (bits - 6) rows at most
        held[batch["word"].to_numpy()] = batch["bits"].to_numpy().view(np.uint64)
    found = rows.mapInArrow(_chosen(held, bits, shared), "doc_id long, sid long, shingles binary")
    exact = names.join(reps.select("sid", "rep"), "sid")
    exact = exact.select(F.col("sid").alias("__sid"), F.col("rep").alias("__rep"))
    return found.join(exact, (F.col("sid") == F.col("__sid")) & F.col("doc_id").eqNullSafe(F.col("__rep"))).select("sid", "shingles")


def links(sids: list[int], sets: list[np.ndarray], labels: list[int]) -> list[tuple[int, int]]:
    """Verified links, enough to connect all that link. Sets of one label are connected already."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    number: dict[int, int] = {}
    root = np.array([number.setdefault(labels[i], k) for k, i in enumerate(order.tolist())])
    if len(number) < 2:
        return []
    size, sets, sids = size[order], [sets[i] for i in order], [sids[i] for i in order]
    bits = max(6, min(16, int(2 * size[-1]).bit_length()))
    maps = np.zeros((n, 1 << (bits - 6)), np.uint64)
    for k, s in enumerate(sets):
        flags = np.zeros(1 << bits, bool)
        flags[(s & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
        maps[k] = np.packbits(flags, bitorder="little").view(np.uint64)
    count = np.bitwise_count(maps).sum(1, dtype=np.int64)
    out = []
    for i in range(n - 1):
        last = int(np.searchsorted(size, size[i] * THRESHOLD[1] // THRESHOLD[0], "right"))
        j = np.flatnonzero(root[i + 1 : last] != root[i]) + i + 1
        if not len(j):
            continue
        shared = np.bitwise_count(maps[j] & maps[i]).sum(1, dtype=np.int64)
        most = np.minimum(size[i] - (count[i] - shared), size[j] - (count[j] - shared))
        for k in j[_LINKED * most >= THRESHOLD[0] * (size[i] + size[j])].tolist():
            if root[k] == root[i]:
                continue
            at = np.searchsorted(sets[k], sets[i])
            at[at == len(sets[k])] = 0
            overlap = int((sets[k][at] == sets[i]).sum())
            if _LINKED * overlap >= THRESHOLD[0] * int(size[i] + size[k]):
                out.append((sids[i], sids[k]))
                root[root == root[k]] = root[i]
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group; the rows come sorted by group."""

    def done(sids: list, sets: list, labels: list) -> Iterator[pa.RecordBatch]:
        if len(sids) > 1 and (found := links(sids, sets, labels)):
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    now, sids, sets, labels = None, [], [], []
    for batch in batches:
        for group, sid, label, held in zip(*(batch[c].to_pylist() for c in ("group", "sid", "label", "shingles"))):
            if group != now:
                yield from done(sids, sets, labels)
                now, sids, sets, labels = group, [], [], []
            if not sids or sids[-1] != sid:
                sids.append(sid)
                sets.append(np.frombuffer(held, np.uint64))
                labels.append(label)
    yield from done(sids, sets, labels)


def _links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b. groups: group (a string), sid, label."""
    rows = groups.join(sets, "sid").select("group", "sid", "label", "shingles")
    return rows.repartition("group").sortWithinPartitions("group", "sid").mapInArrow(_compared, "a long, b long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    prepared(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    profile, shared = _profile(rows)
    reps = profile.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"))
    total = profile.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(0.6 * total / BUCKET))
    keyed = rows.mapInArrow(_keyed(buckets, shared), "bucket int, keys binary, sids binary, needs binary")
    tiled = kept(keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_tiled, "tile long, sid long, pivot long, tiles long, need long"), "tiles")
    # sets in as many tiles as a link needs, and families of those that share most
    together = kept(tiled.filter("tile is null").groupBy("sid", "pivot").agg(F.sum("tiles").alias("tiles"), F.min("need").alias("need")), "shared")
    live = kept(together.groupBy("sid").agg(F.sum("tiles").alias("tiles"), F.min("need").alias("need")).filter("tiles >= need").select("sid"), "live")
    near = kept(together.filter("sid <> pivot").join(live, "sid").join(live.select(F.col("sid").alias("pivot")), "pivot").select("sid", "pivot", "tiles"), "near")
    best = lambda own, other: near.groupBy(F.col(own).alias("a")).agg(F.max(F.struct("tiles", F.col(other).alias("b")))["b"].alias("b"))
    up = best("sid", "pivot")
    roots = connected(up.unionByName(best("pivot", "sid").join(up.select("a"), "a", "left_anti")))
    pivots = kept(live.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("pivot")), "pivots")
    sizes = profile.filter("n > 0").groupBy("sid").agg(F.max("n").alias("n"))
    parts = pivots.join(sizes, "sid").groupBy("pivot").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    placed = kept(pivots.join(parts, "pivot").select("sid", "pivot", F.pmod(F.xxhash64("sid"), F.col("parts")).alias("block")), "placed")
    heads = placed.select("pivot", "block").distinct().select(F.col("pivot").alias("sid"), "pivot", "block")
    groups = placed.unionByName(heads).distinct().select(F.concat_ws(":", "pivot", "block").alias("group"), "sid", F.col("sid").alias("label"))
    first = kept(_links(groups, _sets(rows, placed, reps, shared)), "links")
    label = kept(placed.join(connected(first).withColumnRenamed("node", "sid"), "sid", "left").select("sid", "pivot", "block", F.coalesce("root", "sid").alias("label")), "labels")
    # tiles with sets that are neither connected nor compared
    tiles = tiled.filter("tile is not null").select("tile", "sid").distinct().join(label, "sid").join(sizes, "sid")
    open_ = tiles.groupBy("tile").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min(F.struct("pivot", "block")).alias("b0"), F.max(F.struct("pivot", "block")).alias("b1"), F.count("*").alias("k"), F.sum("n").alias("shingles"))
    open_ = open_.filter("l0 <> l1 and b0 <> b1").select("tile", "k", F.ceil(F.greatest(F.col("k") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    left = kept(tiles.join(open_, "tile"), "open")
    removed(docs.sparkSession, tiled, together, live, near)
    # of a small tile only the pairs that are open; each set with all its open partners is a group
    small = left.filter(F.col("k") <= SMALL).select("tile", "sid", "label", "pivot", "block")
    other = small.select("tile", *(F.col(c).alias(f"{c}2") for c in ("sid", "label", "pivot", "block")))
    pairs = small.join(other, "tile").filter("sid < sid2 and label <> label2 and (pivot <> pivot2 or block <> block2)").select("sid", "label", "sid2", "label2").distinct()
    pairs = kept(pairs, "pairs")
    # partners differ little in size from the set itself
    parts = pairs.join(sizes, "sid").groupBy("sid").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.count("*") * F.max("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    pairs = pairs.join(parts, "sid").withColumn("group", F.concat_ws(":", "sid", F.pmod(F.xxhash64("sid2"), F.col("parts"))))
    small = pairs.select("group", "sid", "label").distinct().unionByName(pairs.select("group", F.col("sid2").alias("sid"), F.col("label2").alias("label")))
    # of a large one each pair of parts is a group: every member is in as many groups as there are parts
    large = left.filter(F.col("k") > SMALL).withColumn("mine", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("parts")))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    large = large.select(F.concat_ws(":", "tile", F.least("mine", "other"), F.greatest("mine", "other"), F.lit("t")).alias("group"), "sid", "label")
    left = small.unionByName(large)
    left = kept(left, "open")
    links_ = first
    if not left.isEmpty():
        links_ = first.unionByName(kept(_links(left, _sets(rows, left, reps, shared)), "links"))
        label = placed.join(connected(links_).withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("label"))
    named = reps.join(label.select("sid", "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    low = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    member = named.join(low, "label").select("sid", "component_id")
    found = profile.join(member, "sid", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
