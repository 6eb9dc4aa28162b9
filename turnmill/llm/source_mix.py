"""Operator 3: mixing sources to target weights by a min-cost flow.

Documents are summed by membership pattern (the set of sources that a document belongs to; overlaps are allowed). A flow network
routes the patterns' words to the sources' quotas: each further repetition of a pattern's documents costs more than the one
before (convex costs), so nothing is repeated while fresh words can serve. Patterns and sources that share no document never meet
in the network, so it falls apart into its connected components, and each is solved in a task of its own; where every document has
one source, a component is one source. A pattern's flow then says how many whole repetitions all its documents get, and what is
left goes to the first of them in a seeded hash order, up to the document whose middle passes the rest.

The running sum in hash order is taken over sums of ranges of the hash, then over ranges of the range in which it ends, and so on
until few rows are left (LEAF) to be sorted; rows of one hash are told apart by their place in the input. Nothing that grows with
the documents, their patterns or their sources is collected, and no window holds a whole source.

Null texts have no words; documents without words are never taken. A null source is a source of its own, last in order. Rows that
repeat an id are separate documents; the hash is of id and size, so null ids are spread as well. A document longer than a quota is
taken whole or not at all, as its middle decides. Columns of the input pass through mix(), whatever their names; mix_documents()
has its own. An empty table gives an empty one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, kept, numbered, prepared, unused
from .linked import components

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Bits of the hash that a step of the search looks at, a part of 64; rows that are sorted at its end, of one pattern.
STEP, LEAF = 8, 20_000


def targets(sizes: dict, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> dict:
    """Source to target, in memory. sizes: words by source, in order; a target stops at most times its source's size and the excess goes to the others by weight."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    out: dict = {}
    rest, left = share * sum(sizes.values()), dict(sizes)
    while left:
        total = sum(weight[s] for s in left)
        above = [s for s in left if rest * weight[s] / total > most * left[s]]
        if not above:
            return out | {s: rest * weight[s] / total for s in left}
        for s in above:
            out[s] = float(most * left.pop(s))
        rest = share * sum(sizes.values()) - sum(out.values())
    return out


def targeted(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources (source, size) with target: as targets(), over a table. A round sums the sources not yet capped; it ends when a round caps none."""
    ranked = numbered(sources.select("source", "size", F.col("source").isNull().alias("__null")), ["__null", "source"], "__rank")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("__rank") % len(weights) + 1).cast("int"))
    state = kept(ranked.select("source", "size", weight.alias("__w"), F.lit(False).alias("__capped")), "sources")
    every = state.agg(F.sum("size")).first()[0] or 0
    while True:
        free = ~F.col("__capped")
        total, held = state.agg(F.sum(F.when(free, F.col("__w"))), F.sum(F.when(~free, F.col("size")))).first()
        rest = share * every - float(most * (held or 0))
        fair = F.lit(rest) * F.col("__w") / F.lit(total or 1)
        above = free & (fair > most * F.col("size"))
        if not state.filter(above).limit(1).count():
            return state.select("source", "size", F.when(free, fair).otherwise((most * F.col("size")).cast("double")).alias("target"))
        state = kept(state.withColumn("__capped", ~free | above), "sources")


def flow(patterns: dict[tuple, int], quotas: dict, most: int = MOST) -> dict[tuple, int]:
    """Words to take of each pattern: the largest flow of the least cost, the k-th repetition of a word costing k * k.

    Only the arcs from the origin cost anything, and their costs rise: so a flow that is first made as large as possible with the words themselves, then with one repetition, then the next, costs least (what a cheaper arc can carry is never better carried by a dearer one). Each of these flows is made by blocking flows along shortest paths."""
    names = [*patterns, *quotas]
    first = {p: 2 + i for i, p in enumerate(patterns)}
    last = {s: 2 + len(patterns) + i for i, s in enumerate(quotas)}
    to, room, out = [], [], [[] for _ in range(2 + len(names))]

    def arc(a: int, b: int, c: int) -> int:
        for x, y, r in ((a, b, c), (b, a, 0)):
            out[x].append(len(to))
            to.append(y)
            room.append(r)
        return len(to) - 2

    entry = {p: arc(0, first[p], 0) for p in patterns}
    for p, n in patterns.items():
        for s in p:
            if s in last:
                arc(first[p], last[s], most * n)
    for s, q in quotas.items():
        arc(last[s], 1, q)
    for _ in range(most):
        for p, n in patterns.items():
            room[entry[p]] += n
        while True:
            level = [-1] * len(out)
            level[0], todo = 0, deque([0])
            while todo:
                a = todo.popleft()
                for e in out[a]:
                    if room[e] and level[to[e]] < 0:
                        level[to[e]] = level[a] + 1
                        todo.append(to[e])
            if level[1] < 0:
                break
            at, path, here = [0] * len(out), [], 0
            while True:
                if here == 1:
                    n = min(room[e] for e in path)
                    for e in path:
                        room[e] -= n
                        room[e ^ 1] += n
                    path, here = [], 0
                    continue
                while at[here] < len(out[here]) and not (room[e := out[here][at[here]]] and level[to[e]] == level[here] + 1):
                    at[here] += 1
                if at[here] < len(out[here]):
                    path.append(out[here][at[here]])
                    here = to[path[-1]]
                elif path:
                    here = to[path.pop() ^ 1]
                    at[here] += 1
                else:
                    break
    return {p: room[entry[p] ^ 1] for p in patterns}


def _solved(most: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        some = part[part["role"] == 0].sort_values("id")
        quotas = {n: int(q) for n, q in part[part["role"] == 1].sort_values("id")[["id", "n"]].itertuples(index=False)}
        patterns = {(i, *sorted(m)): int(n) for i, n, m in some[["id", "n", "members"]].itertuples(index=False)}  # the id tells equal lists apart
        taken = flow({p: n for p, n in patterns.items()}, {q: v for q, v in quotas.items()}, most)
        return pd.DataFrame({"id": [p[0] for p in taken], "taken": list(taken.values())}).astype({"id": "int64", "taken": "int64"})

    return run


def _flows(patterns: DataFrame, quotas: DataFrame, most: int) -> DataFrame:
    """id, taken of each pattern. patterns: id, n, members (ids of quotas); quotas: id, n. Ids differ between the two."""
    arcs = patterns.select(F.col("id").alias("a"), F.explode("members").alias("b"))
    roots = components(arcs)
    nodes = patterns.select("id", "n", "members", F.lit(0).alias("role")).unionByName(quotas.select("id", "n", F.lit(None).cast("array<long>").alias("members"), F.lit(1).alias("role")))
    placed = nodes.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    return placed.groupBy("root").applyInPandas(_solved(most), "id long, taken long")  # a component's network: a row for each of its patterns and sources


def _digits(h: str, row: str) -> Iterator[Column]:
    """What the order by hash, then row, is searched by, step by step."""
    for k in range(0, 64, STEP):
        yield F.shiftrightunsigned(F.shiftleft(F.col(h).bitwiseXOR(-(2**63)), k), 64 - STEP)
    yield F.shiftrightunsigned(F.col(row), 33)  # the partition of the input


def mix(df: DataFrame, members: str, size: str, quotas: DataFrame, seed: int = 17, most: int = MOST, id_col: str = "doc_id", leaf: int = LEAF) -> DataFrame:
    """df with `repeats`, how often the mix takes each row. members: an array column of sources; size: a column of words; quotas: source, target (words). Null members, and null sources among them, are no sources; such rows stay, with repeats 0."""
    prepared(df.sparkSession)
    name = lambda x: unused(df.columns, f"__{x}")
    pat, h, row, pid, more, whole = (name(x) for x in ("pattern", "hash", "row", "pid", "more", "whole"))
    held = F.coalesce(F.array_compact(members), F.array().cast(df.schema[members].dataType))  # a row of no source is taken by none
    rows = df.withColumn(pat, F.array_sort(F.array_distinct(held))).withColumn(h, F.xxhash64(F.col(id_col), F.lit(seed), F.col(size)))
    rows = kept(rows.withColumn(row, F.monotonically_increasing_id()), "mix")
    sums = rows.groupBy(F.col(pat).alias("pattern")).agg(F.sum(size).cast("long").alias("n"))
    known = kept(sums.withColumn("id", F.monotonically_increasing_id() * 2).select("id", "pattern", F.coalesce("n", F.lit(0)).alias("n")), "patterns")
    goals = kept(quotas.select("source", F.round("target").cast("long").alias("n")).withColumn("id", F.monotonically_increasing_id() * 2 + 1), "quotas")
    arcs = known.select("id", F.explode("pattern").alias("source")).join(goals.select("source", F.col("id").alias("to")), "source").groupBy("id").agg(F.array_sort(F.collect_list("to")).alias("members"))
    taken = _flows(known.join(arcs, "id").select("id", "n", "members"), goals.select("id", "n"), most)
    plan = known.join(taken, "id", "left").select("id", "pattern", "n", F.coalesce("taken", F.lit(0)).alias("taken"))
    some = F.col("n") > 0
    plan = kept(plan.select("id", "pattern", F.when(some, F.floor(F.col("taken") / F.col("n"))).otherwise(0).alias("whole"), F.when(some, F.col("taken") % F.col("n")).otherwise(0).alias("rest")), "plan")
    rows = rows.join(plan.select(F.col("id").alias(pid), F.col("pattern").alias("__p"), F.col("whole").alias(whole)), F.col(pat) == F.col("__p")).drop("__p")
    slim = kept(rows.select(pid, h, row, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n")).filter("n > 0"), "order")
    edge = kept(plan.filter("rest > 0").select(F.col("id").alias(pid), F.col("rest").alias("left")), "edge")
    chosen, now = [], slim.join(edge, pid)  # of a pattern without a rest no row is searched
    for digit in _digits(h, row):
        now = now.withColumn("d", digit)
        n = now.groupBy(pid, "left", "d").agg(F.sum("n").alias("s"), F.count("*").alias("c"))
        n = kept(n.withColumn("before", F.sum("s").over(Window.partitionBy(pid).orderBy("d")) - F.col("s")), "ranges")
        cut = n.filter("before <= left and left < before + s").select(pid, F.col("d").alias("at"), (F.col("left") - F.col("before")).alias("rest"), "c")
        joined = now.join(cut.select(F.col(pid).alias("__i"), "at", "rest"), F.col(pid) == F.col("__i")).drop("__i")
        chosen.append(joined.filter("d < at").select(row))
        now = joined.filter("d = at").select(pid, h, row, "n", F.col("rest").alias("left"))
        if (cut.agg(F.max("c")).first()[0] or 0) <= leaf:
            break
        now = kept(now, "narrowed")
    order = Window.partitionBy(pid).orderBy(h, row).rowsBetween(Window.unboundedPreceding, 0)
    last = now.withColumn("run", F.sum("n").over(order)).filter(F.col("run") - F.col("n") / 2 <= F.col("left")).select(row)
    for x in chosen:
        last = last.unionByName(x)
    picked = kept(last.withColumn(more, F.lit(1)), "chosen")
    out = rows.join(picked, row, "left")
    repeats = F.when(F.col(size) > 0, F.col(whole) + F.coalesce(more, F.lit(0))).otherwise(0)
    return out.withColumn("repeats", repeats).drop(pat, h, row, pid, more, whole)


def mix_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, and repeats, of every document; each belongs to its one source."""
    prepared(docs.sparkSession)
    # names with a mark before them, since an array in a key may hold no null source
    key = F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))
    sized = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size")), "sizes")
    facts = kept(targeted(sized.groupBy("source").agg(F.sum("size").alias("size")), weights, share, most).select(key.alias("key"), F.col("size").alias("source_size"), "target"), "targets")
    marked = sized.select("doc_id", "size", F.array(key).alias("members"))
    out = mix(marked, "members", "size", facts.select(F.col("key").alias("source"), "target"), most=most)
    out = out.withColumn("key", F.col("members")[0]).join(facts, "key")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).cast("long").alias("taken"), F.col("repeats").cast("long").alias("repeats"))
