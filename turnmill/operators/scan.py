"""Running values in the order of a key's rows, where one key may hold most rows (J-5, W-4, W-7, W-8, W-12, R-3).

The rows are cut into blocks of a range partitioning by key and order, so that a large key spreads over many. Each block is scanned by itself; what it hands on,
a row, is combined over the key's blocks before it and sent to its rows. Keys within one block need no carry, so carries number two a block at most."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import folder, lean

BLOCK = "__block"
START, END = Window.unboundedPreceding, Window.unboundedFollowing


class Step(NamedTuple):
    """A running value: within its block; what a block hands on, given the order; that over other blocks of the key; both in one."""

    inside: Callable[[WindowSpec], Column]
    handed: Callable[[Column], Column]
    carried: Callable[[Column, WindowSpec], Column]
    joined: Callable[[Column, Column], Column]


def before(value: Column) -> Step:
    """The row before's value; null for a key's first row."""
    one = F.struct(value.alias("v"))
    return Step(lambda w: F.lag(one).over(w), lambda at: F.max_by(one, at), lambda h, w: F.lag(h).over(w), lambda i, c: F.coalesce(i, c)["v"])


def after(value: Column) -> Step:
    """The next row's value; null for a key's last row."""
    one = F.struct(value.alias("v"))
    return Step(lambda w: F.lead(one).over(w), lambda at: F.min_by(one, at), lambda h, w: F.lead(h).over(w), lambda i, c: F.coalesce(i, c)["v"])


def latest(value: Column) -> Step:
    """The last value that isn't null, up to the row."""
    return Step(
        lambda w: F.last(value, True).over(w.rowsBetween(START, 0)), lambda at: F.max_by(value, F.when(value.isNotNull(), at)),
        lambda h, w: F.last(h, True).over(w.rowsBetween(START, -1)), F.coalesce,
    )


def latest_before(value: Column) -> Step:
    """The last value that isn't null in a row before."""
    return Step(
        lambda w: F.last(value, True).over(w.rowsBetween(START, -1)), lambda at: F.max_by(value, F.when(value.isNotNull(), at)),
        lambda h, w: F.last(h, True).over(w.rowsBetween(START, -1)), F.coalesce,
    )


def total(value: Column) -> Step:
    """The sum up to the row; nulls count as 0."""
    zero = F.lit(0).cast("long")
    return Step(lambda w: F.sum(value).over(w.rowsBetween(START, 0)), lambda at: F.sum(value), lambda h, w: F.sum(h).over(w.rowsBetween(START, -1)), lambda i, c: F.coalesce(i, zero) + F.coalesce(c, zero))


def ever(flag: Column) -> Step:
    """Whether the flag was set in a row before."""
    return Step(lambda w: F.max(flag).over(w.rowsBetween(START, -1)), lambda at: F.max(flag), lambda h, w: F.max(h).over(w.rowsBetween(START, -1)), lambda i, c: F.coalesce(i, F.lit(False)) | F.coalesce(c, F.lit(False)))


def cut(rows: DataFrame, key: list[str], order: list[str], blocks: int | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """rows with the number of their block; rows of equal key and order share one. Written to the shared folder, since a range partitioning that is worked out again may cut elsewhere.

    blocks: how many; else as many as the session's shuffles have partitions, fewer where AQE joins small ones. also: columns to write with them, worked out once."""
    by = [*key, *order]
    dealt = rows.repartitionByRange(blocks, *by) if blocks else rows.repartitionByRange(*by)
    return lean(dealt.withColumns({**(also or {}), BLOCK: F.spark_partition_id()}), folder(rows.sparkSession, "blocks"))


def scan(rows: DataFrame, key: list[str], order: list[str], **steps: Step) -> DataFrame:
    """rows, as cut, with a column for each step. Nulls in the order come first, a null key is a key, and rows of equal order come in any."""
    w, over = Window.partitionBy(*key, BLOCK).orderBy(*order), Window.partitionBy(*key).orderBy(BLOCK)
    handed = rows.groupBy(*key, BLOCK).agg(*(s.handed(F.struct(*order)).alias(f"__h_{n}") for n, s in steps.items()))
    carried = handed.select(*(F.col(k).alias(f"__k_{k}") for k in key), F.col(BLOCK).alias("__b"), *(s.carried(F.col(f"__h_{n}"), over).alias(f"__c_{n}") for n, s in steps.items()), F.count("*").over(Window.partitionBy(*key)).alias("__n"))
    carried = F.broadcast(carried.filter("__n > 1").drop("__n"))  # a block's edges cut one key each, so these are two rows a block at most
    same = F.col(BLOCK) == F.col("__b")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    both = rows.withColumns({f"__i_{n}": s.inside(w) for n, s in steps.items()}).join(carried, same, "left")
    return both.select(*rows.columns, *(s.joined(F.col(f"__i_{n}"), F.col(f"__c_{n}")).alias(n) for n, s in steps.items()))
